import json

from pyspark.sql import functions as F

from siltstone.operators import digests
from siltstone.sources import readers, writers


def test_chat_export(spark, tmp_path):
    for channel in ("a", "b"):
        (tmp_path / channel).mkdir()
        messages = [{"id": f"{channel}{i}", "type": "Default", "timestamp": "2024-01-01T00:00:00Z", "content": "x", "author": {"id": "u", "name": "n"}, "extra": 1} for i in range(2)]
        (tmp_path / channel / "messages.json").write_text(json.dumps({"guild": {}, "messages": messages}))
    got = readers.chat_export(spark, str(tmp_path))
    assert sorted((r.channel, r.pos, r.id, r.author.nickname) for r in got.collect()) == [(c, i, f"{c}{i}", None) for c in "ab" for i in (0, 1)]


def test_notes_and_pages(spark, tmp_path):
    for section, body in (("topics", "from topics"), ("entities", "from entities")):
        (tmp_path / "wiki" / section).mkdir(parents=True)
        (tmp_path / "wiki" / section / "same.md").write_text(f"---\ntopic: t\ngenerated: 2024-01-02\n---\n{body}")
    (tmp_path / "wiki" / "topics" / "one.md").write_text("no front matter")
    got = {r.name: r for r in readers.wiki_notes(spark, str(tmp_path / "wiki")).collect()}
    assert got["same"].section == "entities" and got["same"].generated == "2024-01-02" and got["one"].topic is None


def test_corpus_notes_round_trip(spark, tmp_path):
    (tmp_path / "2024").mkdir()
    item = spark.createDataFrame(
        [("2024-01-01-a-000000", "discord", "c", "N", "2024-01-01", ["https://a.example/x", "https://b.example"], ["blog"], [], "body")],
        "id string, source string, channel string, shared_by string, date string, urls array<string>, kinds array<string>, enrichment array<string>, body string",
    )
    note = writers.item_notes(item).first()
    (tmp_path / note.path).write_text(note.value)
    got = readers.corpus_notes(spark, str(tmp_path)).first()
    assert got.id == "2024-01-01-a-000000" and got.urls == ["https://a.example/x", "https://b.example"]
    assert [r.id for r in readers.item_ids(spark, str(tmp_path)).collect()] == ["2024-01-01-a-000000"]


def test_ledger_exclusions_taxonomy_log(spark, tmp_path):
    (tmp_path / "ledger.jsonl").write_text('{"hash": "h", "status": "done"}\n\n{"hash": "h", "status": "error", "error": "x"}\n')
    assert readers.ledger_lines(spark, str(tmp_path / "ledger.jsonl")).count() == 2
    (tmp_path / "ex.tsv").write_text('a-1\twhy "quoted"\n\nb-2\tno\n')
    assert sorted(r.id for r in readers.exclusion_lines(spark, str(tmp_path / "ex.tsv")).collect()) == ["a-1", "b-2"]
    (tmp_path / "req.json").write_text('[{"id": "a"}, {"id": "b", "reason": "r"}]')
    assert sorted((r.id, r.reason) for r in readers.exclusion_request(spark, str(tmp_path / "req.json")).collect()) == [("a", None), ("b", "r")]
    (tmp_path / "tax.json").write_text('{"topics": {"t": {"description": "d", "items": ["i"]}}, "entities": {"e": {"kind": "tool", "raw": ["E"]}}}')
    got = sorted((r.name, r.section, r["items"], r.raw) for r in readers.taxonomy_entries(spark, str(tmp_path / "tax.json")).collect())
    assert got == [("e", "entities", None, ["E"]), ("t", "topics", ["i"], None)]
    (tmp_path / "log.md").write_text("# Log\n## [2024-01-02] lint | ok\ntext\n")
    assert [tuple(r) for r in readers.log_lines(spark, str(tmp_path / "log.md")).collect()] == [("2024-01-02", "lint", "ok")]
    assert readers.config(str(tmp_path / "none.json")) == {}


def test_sinks_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "items")
    df = spark.createDataFrame([("2024-a", 1), ("2024-c", 3), ("2023-b", 2)], "id string, v int")
    read = lambda p, *c: sorted(tuple(r[x] for x in c) for r in spark.read.parquet(p).collect())
    for _ in range(2):
        writers.write_items(df, path)
    for _ in range(2):
        writers.write_items(df.where("v = 1").withColumn("v", F.lit(5)), path)
    # a year's other items stay
    assert read(path, "id", "v") == [("2023-b", 2), ("2024-a", 5), ("2024-c", 3)]
    owned = str(tmp_path / "owned")
    item = spark.createDataFrame([("2024-a", "raw", ["x"])], "id string, status string, enrichment array<string>")
    writers.write_items(item, owned)
    assert read(owned, "id", "status") == [("2024-a", "raw")]
    item.selectExpr("id", "'enriched' AS status", "array('a.md') AS enrichment", "'2024' AS year").write.mode("overwrite").partitionBy("year").parquet(owned)
    writers.write_items(item, owned)
    got = spark.read.parquet(owned).first()
    assert (got.status, got.enrichment) == ("enriched", ["a.md"])


def test_changed_rows_take_the_place_of_old_ones(spark, tmp_path):
    path = str(tmp_path / "changed")
    df = spark.createDataFrame([(f"k{i}", i) for i in range(40)], "id string, v int")
    assert [writers.write_changed(df, "id", path), writers.write_changed(df, "id", path)] == [40, 0]
    assert writers.write_changed(df.where("v < 2").withColumn("v", F.col("v") * 10 + 1), "id", path) == 2
    got = {r.id: r.v for r in spark.read.parquet(path).collect()}
    assert len(got) == 40 == spark.read.parquet(path).count() and (got["k0"], got["k1"], got["k2"]) == (1, 11, 2)


def test_enrichment_is_written_over_by_item_and_file(spark, tmp_path):
    path, schema = str(tmp_path / "enr"), "item_id string, file string, kind string, meta map<string,string>, body string"
    fetched = spark.createDataFrame([("2024-i", "a.md", "blog", {"a": "1", "b": "", "_c": "x"}, " body \n"), ("2024-i", "b.md", "blog", {}, "other")], schema)
    for _ in range(2):
        writers.write_enrichment(fetched, path)
    got = {r.file: (r.meta, r.body) for r in spark.read.parquet(path).collect()}
    assert got == {"a.md": ({"a": "1"}, "body\n"), "b.md": ({}, "other\n")} and spark.read.parquet(path).count() == 2
    writers.write_enrichment(spark.createDataFrame([("2024-i", "a.md", "paper", {}, "new")], schema), path)
    assert sorted((r.file, r.kind, r.body) for r in spark.read.parquet(path).collect()) == [("a.md", "paper", "new\n"), ("b.md", "blog", "other\n")]


def test_report(spark, tmp_path):
    lists = spark.createDataFrame([("a", 1, "page", "target"), ("a", 2, "page", None)], "finding string, place int, subject string, detail string")
    writers.write_report(spark.createDataFrame([("b", 2), ("a", 1)], "finding string, n int"), str(tmp_path / "report"), lists)
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ["a: 1", "   page -> target", "   page", "b: 2"]


def test_digests(spark, tmp_path):
    schema = "id string, date string, signal string, topics array<string>, entities array<string>, media array<string>, facts array<string>"
    rows = [(f"d{n}", "2024-01-02", "high" if n != 16 else "huge", ["t", "u"], ["e"], ["media/1"] if n == 3 else [], [f"fact {i}" for i in range(n)]) for n in (2, 3, 15, 16)]
    notes = writers.digest_notes(spark.createDataFrame(rows, schema))
    for note in notes.collect():
        (tmp_path / note.path).write_text(note.value)
    read = readers.digest_notes(spark, str(tmp_path))
    assert sorted((r.id, r.date, r.signal, r.topics, r.entities, r.media, r.facts) for r in read.collect()) == sorted(rows)
    assert sorted(map(tuple, digests.faults(read).collect())) == [("d16", "facts"), ("d16", "signal"), ("d2", "facts")]
    entries = spark.createDataFrame([("t", "topics"), ("u", "entities")], "name string, section string")
    assert digests.faults(read, entries).where("fault = 'topics'").count() == 4
    assert digests.with_signal(read).count() == 3 and digests.recall_facts(read, ["FACT 14", "fact 2"]).select("id").count() == 2
    members = spark.createDataFrame([("t", "d3"), ("uncategorized-shares", "d2"), ("uncategorized-shares", "x")], "topic string, item string")
    got = digests.placements(read.where("signal = 'high'"), members, spark.createDataFrame([("t",), ("uncategorized-shares",)], "topic string"))
    assert sorted(map(tuple, got.collect())) == [("t", "d15"), ("t", "d2"), ("t", "d3"), ("uncategorized-shares", "x")]
    finer = spark.createDataFrame([("t", "d3", "t-new")], "topic string, item string, to string")
    assert sorted(map(tuple, digests.split_topic(members, finer).collect())) == [("t-new", "d3"), ("uncategorized-shares", "d2"), ("uncategorized-shares", "x")]
    assert readers.index_names(spark, str(tmp_path / "none.md")).count() == 0


def test_item_note_has_all_fields(spark):
    item = spark.createDataFrame(
        [("2024-a", "s", "c", None, "2024-01-01", ["https://a.example"], ["blog"], ["raw/x.png"], 3, None, None, "b \n\n")],
        "id string, source string, channel string, shared_by string, date string, urls array<string>, kinds array<string>, attachments array<string>,"
        " reactions bigint, status string, enrichment array<string>, body string",
    )
    assert writers.item_notes(item).first().value == (
        "---\nid: 2024-a\nsource: s\nchannel: c\ndate: 2024-01-01\nurls:\n  - https://a.example\nkinds: [blog]\nattachments:\n  - raw/x.png\n"
        "reactions: 3\nstatus: raw\nenrichment: []\n---\n\nb\n"
    )
    assert "reactions" not in writers.item_notes(item.withColumn("reactions", F.lit(0))).first().value
