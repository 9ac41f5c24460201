import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.functions import urls
from siltstone.operators import chains, clusters, integrity, items, ledger, media, members, orphans, ranking, recall, skew
from siltstone.plans import reference
from siltstone.streaming import inbox


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("most", [10**9, 500, 0])
def test_row_numbers_of_a_hot_group(spark, monkeypatch, most):
    monkeypatch.setattr(ranking, "GROUP_ROWS", most)
    random.seed(1)
    data = [("hot" if i % 3 else f"k{i % 7}", random.randrange(50), i) for i in range(3000)]
    got = rows(ranking.distributed_row_number(spark.createDataFrame(data, "k string, v int, i int"), ["k"], ["v", "i"], "n"))
    seen, want = {}, []
    for k, v, i in sorted(data):
        seen[k] = seen.get(k, 0) + 1
        want.append((k, v, i, seen[k]))
    assert got == sorted(want)


def test_row_numbers_of_nothing(spark):
    assert rows(ranking.distributed_row_number(spark.createDataFrame([], "k string, v int"), ["k"], ["v"], "n")) == []


def test_carry_last_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 5)
    data = [("a", n, n * 10 if n % 7 == 3 else None) for n in range(1, 40)] + [("b", 1, None), ("b", 2, 5)]
    df = spark.createDataFrame(data, "k string, n int, v int")
    for before in (False, True):
        got = {(r.k, r.n): r.out for r in ranking.carry_last(df, ["k"], "n", F.col("v"), "out", before=before).collect()}
        last = {}
        for k, n, v in data:
            if not before and v is not None:
                last[k] = v
            assert got[k, n] == last.get(k)
            if before and v is not None:
                last[k] = v


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_of_hot_keys(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    left = spark.createDataFrame([("hot" if i % 2 else f"k{i % 9}" if i % 5 else None, i) for i in range(200)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("k4", 3), ("unused", 4)], "k string, v int")
    assert rows(skew.lookup_join(left, right, ["k"], how).select(F.coalesce("k", F.lit("-")), "i")) == rows(left.join(right, ["k"], how).select(F.coalesce("k", F.lit("-")), "i"))


def test_chains_end_circles_and_gaps(spark):
    n = 300
    state = [("c", f"m{i}", f"m{i - 1}" if i else None, "m0" if i == 0 else None) for i in range(n)]
    state += [("c", "x", "y", None), ("c", "y", "x", None), ("c", "z", "x", None), ("c", "lost", "nowhere", None), ("d", "m1", "m0", None)]
    got = rows(chains.follow_pointers(spark.createDataFrame(state, "channel string, id string, ptr string, root string"), ["channel"]).select("channel", "id", "root"))
    assert got == sorted(("c", f"m{i}", "m0") for i in range(n))


def test_orphans_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(orphans, "BLOCK", 4)
    random.seed(4)
    days = [f"2024-{m:02d}-{d:02d}" for m in (1, 2, 3) for d in (1, 9, 17, 25)]
    ids = [f"i{n:03d}" for n in range(60)]
    parents = [(random.choice(ids[:40]) if random.random() > 0.1 else None, random.choice(days)) for _ in range(60)]
    gone = [(random.choice(ids), random.choice([*days, None])) for _ in range(15)]
    wrap = ["{}", " {} ", "`{}`", "corpus/2024/{}.md", "{}.md", "'{}'"]
    pages = [
        (f"p{n % 9}", random.choice([*days, None]), [random.choice([None, "", "  ", random.choice(wrap).format(random.choice(ids))]) for _ in range(6)] if n % 8 else None, n)
        for n in range(40)
    ]
    wiki = spark.createDataFrame(pages, "name string, generated string, id array<string>, item_id int")
    refs = orphans.references(wiki, "wiki", "name", "generated", "id")
    found = orphans.orphan_references(
        refs, spark.createDataFrame([(a, b + " 10:00:00") for a, b in parents], "id string, t string").withColumn("t", F.col("t").cast("timestamp_ntz")), "id", "t",
        spark.createDataFrame(gone, "id string, on string"), "id", "on",
    )
    want = set()
    for name, day, listed, _ in pages:
        for x in listed or []:
            x = (x or "").strip().strip("`'").split("/")[-1].removesuffix(".md")
            if not x or not day:
                continue
            since = min((d for i, d in parents if i == x), default=None)
            if since is None or since > day or any(i == x and d and d <= day for i, d in gone):
                want.add(("wiki", name, day, x))
    assert set(rows(found)) == want and found.count() == len(want)
    report = rows(orphans.orphan_report(found))
    assert sum(r[2] for r in report) == len(want)


def test_runs_decide_what_exists(spark, monkeypatch):
    monkeypatch.setattr(orphans, "BLOCK", 4)
    keys = spark.createDataFrame([(k,) for k in (1, 2, 3, 5, 6, 9)], "k bigint")
    runs = orphans.parent_runs(keys)
    assert rows(runs.select("run_start", "run_end")) == [(1, 3), (5, 6), (9, 9)]
    asked = spark.createDataFrame([(k,) for k in (2, 4, 5, 8, 10)], "k bigint")
    assert rows(orphans.placed_in_runs(asked, runs)) == [(2, True), (4, False), (5, True), (8, False), (10, False)]
    wiki = spark.createDataFrame([("p", "2024-01-01", ["x", "y"])], "name string, generated string, id array<string>")
    parents = spark.createDataFrame([("x", "2023-01-01 00:00:00"), ("y", "2023-01-01 00:00:00")], "id string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    removed = spark.createDataFrame([], "id string, on string")
    refs = orphans.references(wiki, "wiki", "name", "generated", "id")
    assert orphans.orphan_references(refs, parents, "id", "t", removed, "id", "on").count() == 0
    empty = orphans.parent_runs(keys.limit(0))
    monkeypatch.setattr(orphans, "parent_runs", lambda _: empty)
    assert orphans.orphan_references(refs, parents, "id", "t", removed, "id", "on").count() == 2


def test_orphans_of_empty_tables(spark):
    none = spark.createDataFrame([], "name string, generated string, id array<string>")
    parents = spark.createDataFrame([], "id string, t timestamp_ntz")
    removed = spark.createDataFrame([], "id string, on string")
    assert orphans.orphan_references(orphans.references(none, "wiki", "name", "generated", "id"), parents, "id", "t", removed, "id", "on").count() == 0
    one = spark.createDataFrame([("p", "2024-01-01", ["x", "x"])], "name string, generated string, id array<string>")
    assert rows(orphans.orphan_references(orphans.references(one, "wiki", "name", "generated", "id"), parents, "id", "t", removed, "id", "on")) == [("wiki", "p", "2024-01-01", "x")]


def fold(posts):
    """Clusters of one channel in order: the definition, one message after the other."""
    made, where = [], {}
    for m in posts:
        if m["type"] == "Reply" and m["ref"] in where:
            c = where[m["ref"]]
        elif made and made[-1][-1]["author"] == m["author"] and m["author"] is not None and m["at"] - made[-1][-1]["at"] <= 900:
            c = made[-1]
        else:
            c = []
            made.append(c)
        c.append(m)
        where[m["id"]] = c
    return {m["id"]: c[0]["id"] for c in made for m in c}


@pytest.mark.parametrize("seed", range(6))
def test_clusters_against_the_sequential_definition(spark, monkeypatch, seed):
    monkeypatch.setattr(ranking, "BLOCK", 7)
    monkeypatch.setattr(clusters, "PART", 2 if seed % 2 else 4096)
    random.seed(seed)
    data, want = [], {}
    for channel in ("a", "b"):
        t, posts = 0, []
        for n in range(120):
            t += random.choice([0, 60, 300, 900, 901, 4000, -30])
            reply = random.random() < (0.45 if channel == "a" else 0.0)
            ref = random.choice([f"{channel}{random.randrange(max(1, n - 12), n + 2)}", "none"]) if reply else None
            posts.append({"id": f"{channel}{n}", "type": "Reply" if reply else "Default", "ref": ref, "author": random.choice("xyz"), "at": t})
        want |= {(channel, k): v for k, v in fold(posts).items()}
        data += [(channel, p["id"], n + 1, p["type"], p["author"], p["at"] * 1_000_000, p["ref"]) for n, p in enumerate(posts)]
    df = spark.createDataFrame(data, "channel string, id string, n bigint, type string, author string, at bigint, ref string")
    got = clusters.by_replies(df).join(df.select("channel", F.col("n").alias("cluster"), F.col("id").alias("first")), ["channel", "cluster"])
    assert {(r.channel, r.id): r.first for r in got.collect()} == want
    plain = df.where("channel = 'b'")
    gap = clusters.by_gap(plain).join(plain.select(F.col("n").alias("cluster"), F.col("id").alias("first")), "cluster")
    assert {("b", r.id): r.first for r in gap.collect()} == {k: v for k, v in want.items() if k[0] == "b"}


def test_a_long_segment_is_folded_in_parts():
    random.seed(11)
    passed_on = 0
    for _ in range(200):
        size, part = random.randrange(1, 40), random.randrange(1, 9)
        ns = sorted(random.sample(range(1, 200), size))
        rows = []
        for i, n in enumerate(ns):
            # a message before may be the root of several answers; the one before is always among them
            roots = {ns[i - 1], *random.sample(ns[:i], min(i, random.randrange(4)))} if i else set()
            seen = [{"root": r, "at_n": at, "ok": random.random() < 0.6} for r, at in zip(roots, random.sample(range(n), len(roots)))]
            sure = bool(seen) and all(c["ok"] for c in seen)
            rows.append(("c", ns[0], n, sure, None if sure else seen, i // part))
        whole = pd.DataFrame(rows, columns=["channel", "segment", "n", "joins", "seen", "part"])
        want = clusters._fold(whole.assign(start=None))
        parts = [p for _, p in whole.sample(frac=1, random_state=1).groupby("part")]
        given = clusters._chain(pd.concat([clusters._outcomes(p) for p in parts])).set_index("part")["start"]
        got = pd.concat([clusters._fold(p.assign(start=given[p["part"].iloc[0]])) for p in parts])
        assert dict(zip(got["n"], got["cluster"])) == dict(zip(want["n"], want["cluster"]))
        passed_on += sum(want["cluster"].iloc[i] < ns[i - i % part] for i in range(size))
    assert passed_on > 100


def test_items_from_clusters(spark):
    schema = (
        "channel string, pos int, id string, type string, timestamp string, content string, author struct<id:string,name:string,nickname:string>, reference struct<messageId:string>,"
        " attachments array<struct<url:string,fileName:string>>, embeds array<struct<url:string,title:string>>, reactions array<struct<count:int>>, ingested_at timestamp_ntz"
    )
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    link = "https://a.example/x"
    data = [
        ("c", 0, "1", "Default", "2024-01-01T23:30:00-05:00", f"look {link}, https://own.example/y", ("u", "name", ""), None, [], [(link, "A: Title"), (None, "no")], [(2,), (None,)], day),
        ("c", 1, "2", "Default", "2024-01-01T23:40:00-05:00", None, ("u", "name", "Nick"), None, [("files/p.png", "p.png"), ("https://z/q", "q")], None, None, day),
        ("c", 2, "3", "Default", "2024-01-03T00:00:00Z", "short", ("v", "other", None), None, None, None, None, day),
        ("c", 3, "4", "Call", "2024-01-03T00:00:00Z", "call", ("v", "other", None), None, None, None, None, day),
        ("c", 4, "5", "Default", "2024-01-04T00:00:00Z", "", ("v", "other", None), None, [], None, None, day),
    ]
    messages = spark.createDataFrame(data, schema)
    made = {r.channel + r.date: r for r in clusters.items(messages, clusters.by_replies(clusters.posts(messages)), ["own.example"]).collect()}
    first, second = made["c2024-01-01"], made["c2024-01-03"]
    assert first.kept and not second.kept
    assert first.id.startswith("2024-01-01-a-title-") and first.urls == [link] and first.kinds == ["blog"]
    assert first.attachments == ["raw/discord/c/files/p.png"] and first.reactions == 2 and first.shared_by == "name" and first.messages == 2
    assert first.body == f"**name** (2024-01-01 23:30):\nlook {link}, https://own.example/y\n> unfurl: A: Title\n\n**Nick** (2024-01-01 23:40):\n*[attached: p.png]*\n*[attached: q]*\n"
    assert second.kinds == ["text"]
    out = spark.createDataFrame([(first.id.replace("a-title", "other-slug"),)], "id string")
    assert rows(clusters.cluster_counters(clusters.items(messages, clusters.by_replies(clusters.posts(messages)), []), out)) == [("c", 0, 2)]


def test_ledger_resumes(spark):
    corpus = spark.createDataFrame([("b", ["https://x.example/1", "https://x.example/2"]), ("a", ["http://www.x.example/1/", None]), ("c", None)], "id string, urls array<string>")
    lines = spark.createDataFrame([], "hash string, url string, kind string, status string, seq bigint")
    work = ledger.worklist(corpus, lines)
    assert sorted((r.item, r.url) for r in work.collect()) == [("a", "http://www.x.example/1/"), ("b", "https://x.example/2")]
    done = work.select("hash", "url", "kind", F.lit("error").alias("status"), F.lit(1).cast("bigint").alias("seq"))
    assert ledger.worklist(corpus, done).count() == 2
    settled = done.unionByName(work.select("hash", "url", "kind", F.lit("done").alias("status"), F.lit(2).cast("bigint").alias("seq")))
    assert ledger.worklist(corpus, settled).count() == 0
    assert rows(ledger.counts_by_status(settled)) == [("done", 2)]


def test_upsert_keeps_what_the_enricher_owns_and_repeats(spark):
    schema = "id string, status string, enrichment array<string>, body string"
    old = spark.createDataFrame([("a", "enriched", ["x.md"], "old"), ("b", "raw", [], "b")], schema)
    new = spark.createDataFrame([("a", "raw", [], "new"), ("c", None, None, "c")], schema)
    once = items.upsert(new, old)
    want = [("a", "enriched", ["x.md"], "new"), ("b", "raw", [], "b"), ("c", "raw", [], "c")]
    assert rows(once) == want and rows(items.upsert(new, once)) == want


def test_exclusions_outlive_a_change_of_slug(spark):
    corpus = spark.createDataFrame([("2024-01-01-new-slug-abc123",), ("2024-01-01-other-fff000",)], "id string")
    out = spark.createDataFrame([("2024-01-01-old-slug-abc123", None), (None, "x")], "id string, reason string")
    assert rows(items.exclude(corpus, out)) == [("2024-01-01-other-fff000",)]
    request = spark.createDataFrame([("p", None), ("p", None), ("q", "why"), ("2024-01-01-old-slug-abc123", "again")], "id string, reason string")
    assert rows(items.new_exclusions(request, out)) == [("p", "out of scope"), ("q", "why")]


def test_integrity_findings(spark):
    wiki = spark.createDataFrame(
        [
            ("one", "topics", "t1", "2024-01-05", None, "[[two]] [[soon]] [[gone]] `2024-01-02-a-000001` `2024-01-02-b-000009`"),
            ("one", "topics", "t1", "2024-01-01", None, "old"), ("two", "entities", None, None, None, None), ("two", "topics", "t1", "2024-01-09", None, "hidden"),
        ],
        "name string, section string, topic string, generated string, id array<string>, text string",
    )
    tax = spark.createDataFrame(
        [("t1", 1, "topics", None, None, None, ["2024-01-06-x-00000a", "2024-01-05-y-00000b", None]), ("soon", 1, "topics", None, None, None, None), ("uncategorized-shares", 1, "topics", None, None, None, ["2024-01-03-c-000003"])],
        "name string, wave int, section string, description string, kind string, raw array<string>, items array<string>",
    )
    corpus = spark.createDataFrame([("2024-01-02-a-000001",), ("2024-01-03-c-000003",), ("2024-01-04-d-000004",), (None,)], "id string")
    pages, entries = integrity.current_pages(wiki), integrity.current_taxonomy(tax)
    assert rows(integrity.classified_links(pages, entries)) == [("one", "gone", "broken"), ("one", "soon", "reserved"), ("one", "two", "ok")]
    assert rows(integrity.bad_citations(pages, corpus)) == [("one", "2024-01-02-b-000009")]
    assert rows(integrity.uncited(pages, entries, corpus)) == [("2024-01-04-d-000004",)]
    assert rows(integrity.stale_pages(pages, entries)) == [("one", 1)]
    index = spark.createDataFrame([("[[one]] [[ghost]] [[soon]]",)], "text string")
    assert rows(integrity.unindexed(pages, index)) == [("two",)]
    assert rows(integrity.ghost_entries(pages, entries, index)) == [("ghost",)]
    found = integrity.summary(pages, entries, corpus, index)
    assert dict(rows(found))["orphans"] == 1 and rows(integrity.verdict(found)) == [(False,)]
    assert rows(integrity.ingest_state(corpus, entries.limit(0))) == [("stranded",)]
    assert rows(integrity.ingest_state(corpus.limit(0), entries.limit(0))) == [("fresh",)]


def test_members(spark):
    entries = spark.createDataFrame([("e1", "entities", ["Foo", "foo", None], None), ("e2", "entities", ["bar"], None)], "name string, section string, raw array<string>, items array<string>")
    corpus = spark.createDataFrame([("i1", "Foo and bar, foo"), ("i2", "bar"), ("i3", None)], "id string, body string")
    assert rows(members.inverted_index(members.entity_mentions(corpus, entries))) == [("e1", 1, "i1", "i1"), ("e2", 2, "i1", "i2")]


def test_fetchers_by_kind(spark):
    work = spark.createDataFrame([("h1", "u1", "blog", "i"), ("h2", "u2", "paper", "i"), ("h3", "u3", "tweet", "i")], "hash string, url string, kind string, item string")

    def good(url):
        return "done", {"title": url}, "text"

    def bad(url):
        raise OSError("x" * 200)

    got = {r.hash: r for r in inbox.fetch(work, {"blog": good, "paper": bad}).collect()}
    assert (got["h1"].status, got["h1"].meta["title"]) == ("done", "u1")
    assert got["h2"].status == "error" and len(got["h2"].meta["error"]) == 150 and got["h3"].status == "skipped"


def test_inbox_is_drained_once(spark, tmp_path):
    box = tmp_path / "inbox"
    box.mkdir()
    (box / "20240101-000000.md").write_text("see https://a.example/x?utm_source=y.")
    (box / "20240101-000001.md").write_text("---\nasset: https://api.github.com/repos/o/r/releases/assets/7\nname: p.png\n---\nnote")
    (box / "20240101-000002.md").write_text("---\nasset: nonsense\n---\n")
    args = [spark, str(box), str(tmp_path / "out"), str(tmp_path / "state")]
    assert inbox.drain(*args) == 1 and inbox.drain(*args) == 0
    (box / "20240101-000003.md").write_text("later")
    assert inbox.drain(*args) == 1
    got = {r.file: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 4 and got["20240101-000000.md"].url == "https://a.example/x?utm_source=y"
    assert got["20240101-000001.md"].sound and not got["20240101-000002.md"].sound


def test_assets(spark):
    base = "https://api.github.com/repos/o/r/releases/assets/"
    captures = spark.createDataFrame(
        [("a", base + "1", "x.png"), ("b", base + "2", None), ("c", "nonsense", "n"), ("d", base + "4", None), ("e", base + "5", "gone"), ("f", base + "6", "kept"), ("g", None, None), ("h", base + "7", "n")],
        "file string, asset string, name string",
    )
    assets = spark.createDataFrame(
        [(1, base + "1", 200, "x.png", 10), (2, base + "2", 200, "y.png", 5), (4, base + "4", 404, None, None), (5, base + "5", 404, None, None), (6, base + "6", 404, None, None), (9, base + "9", 200, "z", 1)],
        "id bigint, url string, status int, name string, size bigint",
    )
    stored = captures.where("file IN ('a', 'f')").select(F.concat(F.lit("media/"), F.left(F.sha1(F.concat(F.lit("media/"), "name")), F.lit(6)), F.lit("/"), "name").alias("media"), F.lit(10).cast("bigint").alias("size"))
    got = media.asset_outcomes(captures, assets, stored)
    assert {r.file: r.outcome for r in got.collect()} == {"a": "present", "b": "download", "c": "malformed", "d": "nameless", "e": "gone", "f": "present", "h": "unreachable"}
    assert [r.id for r in media.stray_assets(assets, captures).collect()] == [9]
    assert rows(media.inbox_counts(captures, got)) == [(7, 1, 4)]


def test_lengths_and_states(spark):
    df = spark.createDataFrame([("youtube", "x" * 200, 1), ("blog", "x" * 300, 24_000_001), ("blog", "x" * 301, None), ("paper", "x" * 2001, 24_000_000), ("tweet", "", 1)], "k string, b string, n int")
    got = df.select(media.long_enough(F.col("k"), F.col("b")).alias("l"), media.sound_state(F.col("n")).alias("s"), media.first_answer(F.lit(None).cast("string"), F.col("b")).isNotNull().alias("f")).collect()
    assert [r.l for r in got] == [True, False, True, True, False] and [r.s for r in got] == [None, "toolong", "error", None, None]
    assert [r.f for r in got] == [False, False, True, True, False]


def test_work_of_several_kinds(spark):
    corpus = spark.createDataFrame([("a", ["https://m.tubelane.example/1", "https://x.example/2"]), ("b", ["https://tubelane.example/1"]), ("c", ["https://codenest.example/u/r", "https://tubelane.example/9"])], "id string, urls array<string>")
    # an entry of the link as it is given settles it
    settled = urls.link_hash(F.lit("https://tubelane.example/9")).alias("hash")
    lines = spark.range(1).select(settled, F.lit("u").alias("url"), F.lit("youtube").alias("kind"), F.lit("done").alias("status"), F.lit(1).cast("bigint").alias("seq"))
    work = ledger.worklist(corpus, lines, reference.SITE_KINDS, reference._real_hosts)
    # the first mention of tubelane's link is of another kind
    assert sorted((r.item, r.kind) for r in work.collect()) == [("b", "youtube"), ("c", "github")]


def test_hot_kinds_and_months_are_numbered_in_parts(spark, monkeypatch):
    cut = []
    in_parts = ranking._in_parts
    monkeypatch.setattr(ranking, "GROUP_ROWS", 20)
    monkeypatch.setattr(ranking, "_in_parts", lambda df, by, *more: cut.append(by) or in_parts(df, by, *more))
    work = spark.createDataFrame([("blog" if i % 5 else "paper", f"i{i:03}", 0, f"h{i}") for i in range(100)], "kind string, item string, pos int, hash string")
    assert rows(ledger.progress(work, 25)) == [("blog", 25, "h31"), ("blog", 50, "h62"), ("blog", 75, "h93")]
    posts = [(c, d, f"{c}{i:03}") for c in ("a", None, "") for d in ("2024-01-02", None) for i in range(30 if c is None else 3)]
    got = recall.waves(spark.createDataFrame(posts, "channel string, date string, id string"), 20)
    assert sorted((str(r.channel), str(r.month), r.part, r["items"], r.first[-3:], r.last[-3:]) for r in got.select("channel", "month", "part", "items", "first", "last").collect()) == sorted(
        [(c, m, 0, 3, "000", "002") for c in ("a", "") for m in ("2024-01", "None")]
        + [("None", m, p, n, a, b) for m in ("2024-01", "None") for p, n, a, b in ((0, 20, "000", "019"), (1, 10, "020", "029"))]
    )
    assert cut == [["kind"], ["channel_key", "month_key"]]
