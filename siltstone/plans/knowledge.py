"""Registered queries over digests, the index, reports and files written and read again, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import markup, urls
from siltstone.operators import digests, integrity, items, ledger, media, members, recall
from siltstone.plans import reference as core
from siltstone.session import materialize, scratch_path, table
from siltstone.sources import readers, writers
from siltstone.streaming import inbox

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- digests -------------------------------------------------------------
# Digests are written by hand; here the last version of every item stands for one: its lines are the facts, its kinds
# the topics, its channel the entity, and its reactions the signal.

_DIGESTS = r"""dig AS (
  SELECT id, date, CASE WHEN reactions >= 10 THEN 'high' WHEN reactions >= 3 THEN 'medium' WHEN reactions >= 0 THEN 'low' END AS signal,
    list_filter(list_transform(coalesce(kinds, []), lambda k: trim(k)), lambda k: k <> '') AS topics,
    list_filter(list_transform(regexp_extract_all(replace(coalesce(body, ''), chr(13), chr(10)), '[^\n]*[^\s\x{0085}\x{00A0}\x{2028}\x{2029}][^\n]*'), lambda f: f), lambda f: f IS NOT NULL) AS facts
  FROM last)"""


def _digests(spark: SparkSession, d: str) -> DataFrame:
    """Written as notes and read again."""
    last = items.latest(table(spark, d, "corpus"))
    facts = F.regexp_extract_all(F.replace(F.coalesce("body", F.lit("")), F.lit("\r"), F.lit("\n")), F.lit(r"[^\n]*[^\s\x{85}\x{A0}\x{2028}\x{2029}][^\n]*"), F.lit(0))
    signal = F.when(F.col("reactions") >= 10, "high").when(F.col("reactions") >= 3, "medium").when(F.col("reactions") >= 0, "low")
    made = last.select("id", "date", signal.alias("signal"), F.col("kinds").alias("topics"), F.array("channel").alias("entities"), "media", facts.alias("facts"))
    return digests.parsed(writers.digest_notes(made))


@query(f"WITH {core._LAST}, {_DIGESTS} SELECT id, date, signal, topics, len(facts)::INT AS facts FROM dig")
def digests_read(spark: SparkSession, d: str) -> DataFrame:
    return _digests(spark, d).select("id", "date", "signal", "topics", F.size("facts").alias("facts"))


@query(f"""WITH {core._LAST}, {_DIGESTS} SELECT fault, count(*) AS digests FROM (
SELECT 'signal' AS fault FROM dig WHERE signal IS NULL UNION ALL SELECT 'facts' FROM dig WHERE len(facts) NOT BETWEEN 3 AND 15
UNION ALL SELECT 'topics' FROM dig WHERE len(topics) NOT BETWEEN 2 AND 5) GROUP BY 1""")
def digest_faults(spark: SparkSession, d: str) -> DataFrame:
    return digests.faults(_digests(spark, d)).groupBy("fault").agg(F.count(F.lit(1)).alias("digests"))


@query(f"WITH {core._LAST}, {core._TAX}, {_DIGESTS} SELECT count(DISTINCT id) AS digests FROM (SELECT id, unnest(topics) AS t FROM dig) WHERE t NOT IN (SELECT name FROM entries WHERE section = 'topics')")
def digest_topics_unknown(spark: SparkSession, d: str) -> DataFrame:
    found = digests.faults(_digests(spark, d), core._entries(spark, d)).where("fault = 'topics'")
    return found.agg(F.count_distinct("id").alias("digests"))


@query(f"WITH {core._LAST}, {_DIGESTS} SELECT id FROM dig WHERE signal IN ('high', 'medium')")
def digests_of_signal(spark: SparkSession, d: str) -> DataFrame:
    return digests.with_signal(_digests(spark, d), "medium").select("id")


@query(f"""WITH {core._LAST}, {_DIGESTS} SELECT id, date, array_to_string(list_filter(facts, lambda f: contains(lower(f), 'index') OR contains(lower(f), 'passage')), chr(10)) AS facts
FROM dig WHERE len(list_filter(facts, lambda f: contains(lower(f), 'index'))) > 0 AND len(list_filter(facts, lambda f: contains(lower(f), 'passage'))) > 0 AND date >= '2024-01-01'""")
def recall_facts(spark: SparkSession, d: str) -> DataFrame:
    found = digests.recall_facts(_digests(spark, d), ["Index", "passage"], since="2024-01-01")
    return found.select("id", "date", F.array_join("facts", "\n").alias("facts"))


_PLACED = f"""WITH {core._LAST}, {core._TAX}, {_DIGESTS}, topics AS (SELECT name AS topic FROM entries WHERE section = 'topics' UNION SELECT 'github' UNION SELECT 'paper'),
placed AS (SELECT DISTINCT t AS topic, id AS item FROM (SELECT id, unnest(topics) AS t FROM dig) WHERE t IN (SELECT topic FROM topics) AND t <> 'uncategorized-shares'),
now AS (SELECT topic, item FROM members WHERE topic <> 'uncategorized-shares' UNION SELECT topic, item FROM members WHERE topic = 'uncategorized-shares' AND item NOT IN (SELECT item FROM placed)
  UNION SELECT topic, item FROM placed)"""


@query(_PLACED + " SELECT topic, count(*) AS items FROM now GROUP BY 1")
def topic_placements(spark: SparkSession, d: str) -> DataFrame:
    """Members after the sweep for two new topics."""
    entries = core._entries(spark, d)
    topics = entries.where("section = 'topics'").select(F.col("name").alias("topic")).unionByName(spark.createDataFrame([("github",), ("paper",)], "topic string"))
    now = digests.placements(_digests(spark, d), integrity.topic_members(entries), topics)
    return now.groupBy("topic").agg(F.count(F.lit(1)).alias("items"))


@query(f"""WITH {core._LAST}, {core._TAX}, {_DIGESTS}, finer AS (SELECT id AS item, min(t) AS kind FROM (SELECT id, unnest(topics) AS t FROM dig) GROUP BY 1),
now AS (SELECT DISTINCT CASE WHEN f.item IS NULL THEN m.topic ELSE m.topic || '-' || f.kind END AS topic, m.item FROM members m LEFT JOIN finer f ON m.item = f.item)
SELECT topic, count(*) AS items FROM now GROUP BY 1""")
def topics_split(spark: SparkSession, d: str) -> DataFrame:
    """Every topic split by the first kind of its items; items without a digest stay."""
    have = integrity.topic_members(core._entries(spark, d))
    kinds = _digests(spark, d).where("size(topics) > 0").select(F.col("id").alias("item"), F.array_min("topics").alias("kind"))
    finer = have.select("topic", "item").distinct().join(kinds, "item").select("topic", "item", F.concat_ws("-", "topic", "kind").alias("to"))
    return digests.split_topic(have, finer).groupBy("topic").agg(F.count(F.lit(1)).alias("items"))


# ---- the index, reports and recall ---------------------------------------

# an index that names the channels that items come from, and pages that have a version without a date
_IDX = "idx AS (SELECT DISTINCT name FROM (SELECT channel AS name FROM corpus UNION SELECT name FROM wiki WHERE generated IS NULL) WHERE regexp_matches(name, '^[a-z0-9-]+$'))"


def _written_index(spark: SparkSession, d: str) -> DataFrame:
    """Channels and pages without a date, written as an index of one line each and read again."""
    path = scratch_path(spark, "index")
    named = table(spark, d, "corpus").select(F.col("channel").alias("name")).unionByName(table(spark, d, "wiki").where("generated IS NULL").select("name"))
    named.where("name IS NOT NULL").distinct().select(F.concat(F.lit("- [["), "name", F.lit("]]")).alias("value")).write.text(path)
    return readers.index_names(spark, path)


@query(core._INTEGRITY + f", {_IDX} SELECT name FROM idx WHERE name NOT IN (SELECT name FROM pages UNION SELECT name FROM entries)")
def index_ghosts_read(spark: SparkSession, d: str) -> DataFrame:
    return integrity.ghost_entries(core._pages(spark, d), core._entries(spark, d), _written_index(spark, d))


@query(core._INTEGRITY + f", {_IDX} SELECT name FROM pages WHERE name NOT IN (SELECT name FROM idx)")
def pages_unindexed_read(spark: SparkSession, d: str) -> DataFrame:
    return integrity.unindexed(core._pages(spark, d), _written_index(spark, d))


_LISTED = {
    "broken_links": ("SELECT page AS subject, target AS detail FROM classed WHERE state = 'broken'", "subject, detail", 20),
    "bad_citations": ("SELECT page AS subject, item AS detail FROM cited WHERE item NOT IN (SELECT id FROM corpus WHERE id IS NOT NULL)", "subject, detail", 20),
    "orphans": (f"SELECT DISTINCT id AS subject, NULL AS detail FROM corpus WHERE id IS NOT NULL AND id NOT IN (SELECT item FROM ({core._FILED}))", "subject", 20),
    "unindexed": ("SELECT name AS subject, NULL AS detail FROM pages WHERE name NOT IN (SELECT name FROM idx)", "subject", 10),
    "ghost_entries": ("SELECT name AS subject, NULL AS detail FROM idx WHERE name NOT IN (SELECT name FROM pages UNION SELECT name FROM entries)", "subject", 10),
    "stale_pages": (f"SELECT page AS subject, newer::VARCHAR AS detail FROM ({core._STALE})", "detail::BIGINT DESC, subject", 15),
}


@query(core._INTEGRITY + f", {_IDX} " + " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{name}' AS finding, (row_number() OVER (ORDER BY {order}))::INT AS place, subject, detail::VARCHAR AS detail FROM ({sql})) WHERE place <= {k}"
    for name, (sql, order, k) in _LISTED.items()))
def integrity_lists(spark: SparkSession, d: str) -> DataFrame:
    pages, entries = materialize(core._pages(spark, d), "pages"), materialize(core._entries(spark, d), "entries")
    return integrity.report_lists(pages, entries, table(spark, d, "corpus"), _written_index(spark, d))


@query(core._INTEGRITY + " SELECT DISTINCT page FROM (SELECT name AS page FROM pages WHERE section = 'topics' UNION SELECT target FROM wl JOIN pages p ON wl.page = p.name WHERE p.section = 'topics') WHERE page IN (SELECT name FROM pages)")
def pages_one_step_of_topics(spark: SparkSession, d: str) -> DataFrame:
    pages = core._pages(spark, d)
    return members.linked_pages(pages, pages.where("section = 'topics'").select(F.col("name").alias("page")))


@query(f"WITH {core._LAST} SELECT id, date FROM last WHERE contains(lower(body), 'index') ORDER BY date DESC NULLS LAST, id LIMIT 20")
def recall_newest(spark: SparkSession, d: str) -> DataFrame:
    found = recall.recall(items.latest(table(spark, d, "corpus")), core._pages(spark, d), ["index"])
    return recall.newest(found, 20).select("id", "date")


# ---- items, ledger and files ---------------------------------------------


@query("SELECT kind, count(*) AS rows FROM enrichment WHERE item_id IS NULL OR item_id NOT IN (SELECT id FROM exclusions WHERE id IS NOT NULL) GROUP BY 1")
def enrichment_excluded(spark: SparkSession, d: str) -> DataFrame:
    left = items.exclude_enrichment(table(spark, d, "enrichment"), table(spark, d, "exclusions"))
    return left.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT hash, url, kind, status, date, title, error, path, via FROM enrichment_ledger WHERE hash IS NOT NULL")
def ledger_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Ledger lines appended to files and read again."""
    path = scratch_path(spark, "ledger")
    writers.append_ledger(table(spark, d, "enrichment_ledger").drop("seq", "batch"), path)
    return readers.ledger_lines(spark, path)


@query("SELECT id, reason FROM exclusions WHERE trim(id) <> ''")
def exclusions_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "exclusions")
    table(spark, d, "exclusions").select("id", "reason").write.csv(path, sep="\t", quote="", emptyValue="", nullValue="")
    return readers.exclusion_lines(spark, path)


@query("""SELECT kind AS op, date, count(*) AS lines FROM enrichment_ledger WHERE regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}$') AND kind IS NOT NULL GROUP BY 1, 2""")
def log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The ledger's lines as entries of a log of operations, written and read again."""
    path = scratch_path(spark, "log")
    line = F.concat(F.lit("## ["), "date", F.lit("] "), "kind", F.lit(" | "), F.coalesce(F.regexp_replace("title", r"[\r\n]+", " "), F.lit("")))
    table(spark, d, "enrichment_ledger").select(line.alias("value")).where("value IS NOT NULL").write.text(path)
    return readers.log_lines(spark, path).groupBy("op", "date").agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT seq, least(length(body), 150)::INT AS kept, length(body) > 150 AS cut FROM enrichment WHERE body IS NOT NULL")
def bodies_capped(spark: SparkSession, d: str) -> DataFrame:
    """Bodies cut as long errors are."""
    rows = table(spark, d, "enrichment").where("body IS NOT NULL")
    kept = F.length(media.capped(F.col("body"), "error"))
    return rows.select("seq", kept.alias("kept"), (F.length("body") > kept).alias("cut"))


@query(core._WORK_OF_KINDS + f""", stored AS (SELECT DISTINCT left(sha1({core._canon('url')}), 10) AS hash FROM enrichment WHERE body IS NOT NULL AND url IS NOT NULL),
lines AS (SELECT kind, hash, CASE WHEN hash IN (SELECT hash FROM stored) THEN 'done' ELSE 'dead' END AS status, row_number() OVER (PARTITION BY kind ORDER BY item, pos) AS i FROM work)
SELECT kind, ((i - 1) // 25 + 1)::BIGINT * 25 AS upto, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'dead') AS dead FROM lines GROUP BY 1, 2""")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    """What a run reports: outcomes of every 25 links of a kind, in the order of the work list."""
    work = core._work_of_kinds(spark, d)
    return ledger.run_counters(inbox.fetch_from(work, table(spark, d, "enrichment")), work, ["done", "dead"])


@query("SELECT DISTINCT f AS file FROM (SELECT unnest(attachments) AS f FROM corpus) WHERE f IS NOT NULL AND f NOT IN (SELECT 'raw/discord/' || channel || '/' || u FROM (SELECT channel, unnest(attachments).url AS u FROM messages) WHERE u IS NOT NULL AND channel IS NOT NULL)")
def assets_stray(spark: SparkSession, d: str) -> DataFrame:
    """Stored files as assets of a release, those of the messages as what captures point to."""
    release = F.lit("https://api.github.com/repos/o/r/releases/assets/")
    number = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 62)).cast("string")
    files = table(spark, d, "corpus").select(F.explode("attachments").alias("file")).where("file IS NOT NULL").distinct()
    used = table(spark, d, "messages").select("channel", F.explode("attachments.url").alias("u")).where("u IS NOT NULL").select(
        F.concat(F.lit("raw/discord/"), "channel", F.lit("/"), "u").alias("file")).where("file IS NOT NULL")
    assets = files.select(number("file").alias("id"), F.col("file").alias("name"))
    captures = used.select(F.concat(release, number("file")).alias("asset"))
    return media.stray_assets(assets, captures).select(F.col("name").alias("file"))


_SQUEEZED = core._TRIM.format(r"regexp_replace(regexp_replace(text, '[&<>]', '', 'g'), '[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')")


@query(f"SELECT doc_id, replace({_SQUEEZED}, ':', ' -') AS title, {_SQUEEZED} AS abstract, strftime(created_at, '%Y-%m-%d') AS published FROM documents WHERE kind = 'abstract' AND text IS NOT NULL")
def feed_fields(spark: SparkSession, d: str) -> DataFrame:
    """Abstracts set as the entry of a feed, and its fields taken out again."""
    rows = table(spark, d, "documents").where("kind = 'abstract' AND text IS NOT NULL")
    plain = F.regexp_replace("text", "[&<>]", "")
    date = F.concat(F.lit("<published>"), F.date_format("created_at", "yyyy-MM-dd"), F.lit("T00:00:00Z</published>"))
    feed = F.concat_ws("", F.lit("<feed><title>feed</title><entry><title>"), plain, F.lit("</title>"), date, F.lit("<summary>"), plain, F.lit("</summary></entry></feed>"))
    return rows.select("doc_id", markup.paper_fields(feed).alias("f")).select("doc_id", "f.*")


@query("""SELECT seq, CASE WHEN coalesce(body, '') = '' THEN coalesce(title, '') ELSE body END || coalesce(chr(10) || chr(10) || '> Quoting @' || shared || ': ' || coalesce(title, ''), '') AS text
FROM (SELECT seq, body, meta['title'] AS title, meta['channel'] AS shared FROM enrichment WHERE kind = 'tweet')""")
def post_texts(spark: SparkSession, d: str) -> DataFrame:
    """Fetched short posts with the post they quote below."""
    rows = table(spark, d, "enrichment").where("kind = 'tweet'")
    title = F.col("meta")["title"]
    return rows.select("seq", markup.post_text(F.col("body"), title, F.col("meta")["channel"], title).alias("text"))


@query("SELECT DISTINCT url, nullif(regexp_extract(real, 'github[.]com[:/]([^/]+/[^/]+?)([.]git)?$', 1), '') AS repo FROM (SELECT url, " + core._real("url") + " AS real FROM (SELECT unnest(urls) AS url FROM corpus)) WHERE url IS NOT NULL")
def repos_of_links(spark: SparkSession, d: str) -> DataFrame:
    each = core._corpus_urls(spark, d)
    return each.select("url", urls.repo_of_remote(core._real_hosts(F.col("url"))).alias("repo"))
