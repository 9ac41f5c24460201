"""Registered queries of the core, each over whole tables, with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import markup, text, urls
from siltstone.operators import clusters, integrity, items, ledger, media, members, recall
from siltstone.session import materialize, scratch_path, spread, table
from siltstone.sources import writers
from siltstone.streaming import inbox

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The tables' hosts are invented; links take the places of the real hosts here.
HOSTS = {
    "tubelane": "youtube.com", "codenest": "github.com", "papershelf": "arxiv.org", "chirper": "x.com",
}
#: Kinds that these hosts stand for.
SITE_KINDS = ["youtube", "github", "paper", "tweet"]
#: Domains that count as one's own in these queries.
DOMAINS = ["amberjournal.example", "kelpledger.example"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- SQL building blocks -------------------------------------------------


def _canon(u: str) -> str:
    path = f"regexp_extract({u}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[.]', ''), '^m[.]', '')"
    drop = ", ".join(f"'{p}'" for p in urls.TRACKING)
    kept = (
        f"list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '=.') AND"
        f" split_part(p, '=', 1) NOT IN ({drop}) AND ({host} <> 'youtube.com' OR split_part(p, '=', 1) = 'v'))"
    )
    return (
        f"('https://' || {host} || regexp_replace({path}, '/+$', '') ||"
        f" CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END)"
    )


def _real(u: str) -> str:
    for fake, true in HOSTS.items():
        u = f"regexp_replace({u}, '{fake}[.]example', '{true}', 'i')"
    return u


_LINKS = f"""links AS (
  SELECT id AS item, pos, url, left(sha1({_canon('url')}), 10) AS hash, {_canon('url')} AS canon FROM (
    SELECT id, unnest(urls) AS url, unnest(range(len(urls))) AS pos FROM corpus) WHERE url IS NOT NULL
)"""
_COMPACT = "state AS (SELECT hash, max_by(kind, seq) AS kind, max_by(status, seq) AS status, max_by(url, seq) AS url FROM enrichment_ledger WHERE hash IS NOT NULL GROUP BY hash)"
_OWNERS = "owners AS (SELECT hash, arg_min(item, (item, pos, url)) AS item, arg_min(pos, (item, pos, url)) AS pos, min((item, pos, url)) AS k FROM links GROUP BY hash)"
_WORK = f"""WITH {_LINKS}, {_COMPACT}, {_OWNERS}, work AS (
  SELECT o.hash, o.item, o.pos, 'blog' AS kind FROM owners o
  WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.hash = o.hash AND s.status IN ('done', 'dead', 'skipped', 'nocaptions', 'manual'))
)"""
# the same for some kinds, told by the real hosts; hashes are of the links as given, as in the ledger
_SITE = f"regexp_replace(lower(regexp_extract({_real('url')}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[.]', '')"
_WORK_OF_KINDS = f"""WITH {_LINKS}, {_COMPACT}, kinds AS (
  SELECT *, CASE WHEN {_SITE} IN ('youtube.com', 'youtu.be') THEN 'youtube' WHEN {_SITE} IN ('github.com', 'gist.github.com') THEN 'github'
    WHEN {_SITE} IN ('arxiv.org', 'openreview.net') OR contains({_real('url')}, 'huggingface.co/papers') THEN 'paper'
    WHEN {_SITE} IN ('x.com', 'twitter.com') THEN 'tweet' ELSE 'blog' END AS kind FROM links
), owners AS (
  SELECT hash, arg_min(item, (item, pos, url)) AS item, arg_min(pos, (item, pos, url)) AS pos, arg_min(kind, (item, pos, url)) AS kind
  FROM kinds WHERE kind IN ('youtube', 'github', 'paper', 'tweet') GROUP BY hash
), work AS (
  SELECT hash, item, pos, kind FROM owners o
  WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.hash = o.hash AND s.status IN ('done', 'dead', 'skipped', 'nocaptions', 'manual'))
)"""
_PAGES = """pages AS (
  SELECT name, max_by(section, k) AS section, max_by(coalesce(topic, '~'), k) AS topic, max_by(coalesce(generated, '~'), k) AS generated,
    max_by(coalesce(text, ''), k) AS text
  FROM (SELECT *, (CASE section WHEN 'topics' THEN 1 WHEN 'syntheses' THEN 2 WHEN 'entities' THEN 3 ELSE 0 END, coalesce(generated, '')) AS k FROM wiki)
  WHERE name IS NOT NULL GROUP BY name
)"""
_TAX = """tax AS (SELECT name, max(wave) AS wave FROM taxonomy WHERE name IS NOT NULL GROUP BY name),
entries AS (SELECT DISTINCT t.name, t.section, t.items, t.raw FROM taxonomy t JOIN tax USING (name, wave)),
members AS (SELECT name AS topic, item FROM (SELECT name, unnest(items) AS item FROM entries WHERE section = 'topics') WHERE item IS NOT NULL)"""
_CITED = r"""cited AS (SELECT DISTINCT name AS page, unnest(regexp_extract_all(text, '`(\d{4}-\d{2}-\d{2}-[a-z0-9-]+-[0-9a-f]{6})`', 1)) AS item FROM pages)"""
_WIKILINKS = r"""wl AS (SELECT DISTINCT name AS page, unnest(regexp_extract_all(text, '\[\[([a-z0-9-]+)\]\]', 1)) AS target FROM pages),
classed AS (SELECT page, target, CASE WHEN target IN (SELECT name FROM pages) THEN 'ok'
  WHEN target IN (SELECT name FROM entries) THEN 'reserved' ELSE 'broken' END AS state FROM wl)"""
_INTEGRITY = f"WITH {_PAGES}, {_TAX}, {_CITED}, {_WIKILINKS}"
_FILED = "SELECT item FROM cited UNION SELECT item FROM members WHERE topic = 'uncategorized-shares'"
# the index of these queries: what syntheses link to
_INDEX = r"idx AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\[\[([a-z0-9-]+)\]\]', 1)) AS name FROM wiki WHERE section = 'syntheses')"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return integrity.current_pages(table(spark, d, "wiki"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return integrity.current_taxonomy(table(spark, d, "taxonomy"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wiki").where("section = 'syntheses'").select("text")


def _corpus_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus").select(F.explode("urls").alias("url")).where("url IS NOT NULL").distinct()


def _real_hosts(url):
    for fake, true in HOSTS.items():
        url = F.regexp_replace(url, f"(?i){fake}[.]example", true)
    return url


# ---- links ---------------------------------------------------------------


@query(f"SELECT DISTINCT url, {_canon('url')} AS canonical, left(sha1({_canon('url')}), 10) AS hash FROM (SELECT unnest(urls) AS url FROM corpus) WHERE url IS NOT NULL")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    each = _corpus_urls(spark, d)
    known = each.select("url", urls.canonical(F.col("url")).alias("canonical"))
    return known.select("url", "canonical", urls.hash_of(F.col("canonical")).alias("hash"))


@query(f"""WITH u AS (SELECT DISTINCT {_real('url')} AS url FROM (SELECT unnest(urls) AS url FROM corpus) WHERE url IS NOT NULL),
h AS (SELECT url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[.]', '') AS f,
  regexp_replace(lower(split_part(regexp_replace(url, '^https?://', ''), '/', 1)), '^www[.]', '') AS s FROM u)
SELECT CASE WHEN f IN ('youtube.com', 'youtu.be') THEN 'youtube' WHEN f IN ('github.com', 'gist.github.com') THEN 'github'
    WHEN f IN ('arxiv.org', 'openreview.net') OR contains(url, 'huggingface.co/papers') THEN 'paper' WHEN f IN ('x.com', 'twitter.com') THEN 'tweet' ELSE 'blog' END AS fetch_kind,
  CASE WHEN s IN ('youtube.com', 'youtu.be', 'm.youtube.com') THEN 'youtube' WHEN s = 'github.com' THEN 'github'
    WHEN s IN ('arxiv.org', 'openreview.net') OR contains(url, 'huggingface.co/papers') THEN 'paper' WHEN s IN ('x.com', 'twitter.com') THEN 'tweet' ELSE 'blog' END AS share_kind,
  count(*) AS links FROM h GROUP BY 1, 2""")
def url_kinds(spark: SparkSession, d: str) -> DataFrame:
    real = _corpus_urls(spark, d).select(_real_hosts(F.col("url")).alias("url")).distinct()
    kinds = real.select(urls.fetch_kind(F.col("url")).alias("fetch_kind"), urls.share_kind(F.col("url")).alias("share_kind"))
    return kinds.groupBy("fetch_kind", "share_kind").agg(F.count(F.lit(1)).alias("links"))


@query(f"""WITH u AS (SELECT DISTINCT {_real('url')} AS url FROM (SELECT unnest(urls) AS url FROM corpus) WHERE url IS NOT NULL),
p AS (SELECT url, list_filter(string_split(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM u
  WHERE regexp_matches(lower(url), '^https?://(www[.]|m[.])?github[.]com'))
SELECT CASE WHEN len(parts) = 1 THEN 'user' WHEN len(parts) < 2 THEN 'skipped' WHEN len(parts) >= 4 AND parts[3] = 'blob' THEN 'blob'
  WHEN len(parts) >= 4 AND parts[3] IN ('issues', 'pull') THEN 'issue' ELSE 'repo' END AS route, count(*) AS links FROM p GROUP BY 1""")
def github_routes(spark: SparkSession, d: str) -> DataFrame:
    real = _corpus_urls(spark, d).select(_real_hosts(F.col("url")).alias("url")).distinct()
    code = real.where(F.lower("url").rlike(r"^https?://(www[.]|m[.])?github[.]com"))
    return code.groupBy(urls.github_route(F.col("url")).alias("route")).agg(F.count(F.lit(1)).alias("links"))


@query(f"""WITH u AS (SELECT DISTINCT regexp_replace(regexp_replace(url, 'papershelf[.]example', 'arxiv.org', 'i'), '/abs/[^/?#]*', '/abs/2101.0' || length(url)::VARCHAR || 'v2') AS url
  FROM (SELECT unnest(urls) AS url FROM corpus) WHERE lower(url) LIKE '%papershelf.example/abs/%')
SELECT regexp_extract({_canon('url')}, 'arxiv\\.org/(?:abs|pdf|html)/([\\d.]+?)(?:v\\d+)?(?:\\.pdf)?/?$', 1) AS paper, count(*) AS links FROM u GROUP BY 1""")
def paper_ids(spark: SparkSession, d: str) -> DataFrame:
    """Preprint numbers; the invented paper codes give place to numbers made of the link's length."""
    shelf = _corpus_urls(spark, d).where("lower(url) LIKE '%papershelf.example/abs/%'")
    number = F.concat(F.lit("/abs/2101.0"), F.length("url").cast("string"), F.lit("v2"))
    real = shelf.select(F.regexp_replace(F.regexp_replace("url", "(?i)papershelf[.]example", "arxiv.org"), F.lit("/abs/[^/?#]*"), number).alias("url")).distinct()
    return real.groupBy(F.coalesce(urls.arxiv_id(F.col("url")), F.lit("")).alias("paper")).agg(F.count(F.lit(1)).alias("links"))


@query("""WITH a AS (SELECT unnest(attachments) AS f FROM corpus), p AS (SELECT lower(split_part('https://h.example/' || f, '/', -1)) AS leaf FROM a WHERE f IS NOT NULL),
e AS (SELECT CASE WHEN contains(leaf, '.') THEN split_part(leaf, '.', -1) ELSE '/' END AS x FROM p)
SELECT CASE WHEN x = '' OR length(x) > 4 OR contains(x, '/') THEN 'jpg' ELSE x END AS ending, count(*) AS files FROM e GROUP BY 1""")
def media_endings(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "corpus").select(F.explode("attachments").alias("f")).where("f IS NOT NULL")
    ending = urls.media_extension(F.concat(F.lit("https://h.example/"), F.col("f")))
    return files.groupBy(ending.alias("ending")).agg(F.count(F.lit(1)).alias("files"))


@query(f"""SELECT id, list_filter(urls, lambda u: NOT (regexp_matches(lower(split_part(regexp_replace(u, '^https?://', ''), '/', 1)), '(^|[.])({'|'.join(x.replace('.', '[.]') for x in DOMAINS)})$'))) AS outside
FROM (SELECT DISTINCT id, urls FROM corpus WHERE len(urls) > 0)""")
def outside_links(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "corpus").where("size(urls) > 0").select("id", "urls").distinct()
    return rows.select("id", F.filter("urls", lambda u: ~urls.is_internal(u, DOMAINS)).alias("outside"))


# ---- text and ids --------------------------------------------------------


@query("""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(lower(substr(text, 1, 80)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, coalesce(nullif(regexp_replace(substr(s, 1, 40), '-+$', ''), ''), 'untitled') AS slug, left(sha1('documents/' || doc_id::VARCHAR), 6) AS short_id FROM t""")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select(
        "doc_id", text.slugify(F.substring("text", 1, 80)).alias("slug"), text.short_id(F.lit("documents"), F.col("doc_id").cast("string")).alias("short_id")
    )


@query(r"""WITH x AS (SELECT channel, trim(regexp_replace(regexp_replace(content, 'https?://[^\s>\)\]]+', '', 'g'), '[\s\x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]+', ' ', 'g')) AS t,
  len(regexp_extract_all(content, 'https?://[^\s>\)\]]+')) AS n FROM messages WHERE content IS NOT NULL)
SELECT channel, count(*) AS messages, sum(n)::BIGINT AS links, count(*) FILTER (WHERE length(t) >= 200) AS substantial FROM x GROUP BY 1""")
def message_substance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "messages").where("content IS NOT NULL")
    return rows.groupBy("channel").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(F.size(urls.links_in(F.col("content")))).alias("links"),
        F.count_if(text.substance(F.col("content")) >= clusters.SUBSTANCE).alias("substantial"),
    )


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS x, unnest(range(len(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))))) AS i
  FROM documents WHERE kind = 'transcript' AND text IS NOT NULL),
c AS (SELECT doc_id, i, regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '^[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g') AS x FROM l),
k AS (SELECT * FROM c WHERE x <> '' AND NOT contains(x, '-->') AND NOT regexp_matches(x, '^(WEBVTT|Kind:|Language:|NOTE|align:)') AND NOT regexp_matches(x, '^\d+$')),
p AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM k)
SELECT d.doc_id, coalesce(sum(length(p.x)), 0)::BIGINT AS characters, count(p.x) AS spoken FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id AND (p.prev IS NULL OR p.prev <> p.x)
WHERE d.kind = 'transcript' AND d.text IS NOT NULL GROUP BY 1""")
def spoken_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("kind = 'transcript' AND text IS NOT NULL")
    said = text.caption_text(F.col("text"))
    lines = F.filter(F.split(said, "\n"), lambda x: x != "")
    return rows.select(
        "doc_id", F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("characters"), F.size(lines).cast("bigint").alias("spoken")
    )


_TRIM = r"regexp_replace({0}, '^[\s\x{{0085}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[\s\x{{0085}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '', 'g')"


@query("SELECT DISTINCT " + ", ".join(_TRIM.format(c) + f" AS {c}" for c in ("id", "source", "channel", "shared_by", "status")) + r""",
  nullif(coalesce(reactions, 0), 0)::VARCHAR AS reactions, coalesce(array_to_string(urls, ' '), '') AS urls,
  regexp_replace(regexp_replace(replace(replace(coalesce(body, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', ''), '^\n+', '') AS body
FROM (SELECT * REPLACE (coalesce(status, 'raw') AS status) FROM corpus)""")
def front_matter_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Items written as notes and read again: white space around values and after the body goes, missing values stay missing."""
    notes = writers.item_notes(table(spark, d, "corpus"))
    read = notes.select(text.front_matter(F.col("value")).alias("n"), F.regexp_extract_all("value", F.lit(r"(?dm)^  - (https?://\S+)$"), F.lit(1)).alias("u"))
    return read.select(
        *[F.col("n.fields")[c].alias(c) for c in ("id", "source", "channel", "shared_by", "status", "reactions")],
        F.array_join("u", " ").alias("urls"), F.regexp_replace("n.body", "\n$", "").alias("body"),
    ).distinct()


@query(r"SELECT seq, regexp_replace(body, '\s+', ' ', 'g') AS body FROM (SELECT seq, trim(regexp_replace(body, '[\s\x{00A0}\x{0085}\x{2000}-\x{200A}\x{202F}\x{3000}]+', ' ', 'g')) AS body FROM enrichment WHERE body IS NOT NULL)")
def article_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Bodies set as pages, and their article text taken out again."""
    rows = table(spark, d, "enrichment").where("body IS NOT NULL").select("seq", "body")
    escaped = F.replace(F.replace(F.replace("body", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><title>t</title><script>var x = 1;</script></head><body><nav>Home | About</nav><article><p>"),
                    escaped, F.lit("</p></article><footer>Imprint</footer></body></html>"))
    return spread(rows).select("seq", markup.article_text(page).alias("body"))


@query("SELECT (seq % 2)::INT AS attributes, count(*) AS pages, count(DISTINCT url) AS pictures FROM enrichment WHERE url IS NOT NULL GROUP BY 1")
def preview_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Preview pictures of pages made from links, with the attributes in either order."""
    rows = table(spark, d, "enrichment").where("url IS NOT NULL").select("seq", "url")
    one = F.concat(F.lit('<meta property="og:image" content="'), F.col("url"), F.lit('">'))
    two = F.concat(F.lit('<meta content="'), F.col("url"), F.lit('" name="og:image">'))
    pages = rows.select((F.col("seq") % 2).cast("int").alias("attributes"), F.when(F.col("seq") % 2 == 0, one).otherwise(two).alias("page"))
    return pages.groupBy("attributes").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct(markup.og_image(F.col("page"))).alias("pictures"))


@query("SELECT seq, CASE WHEN m % 60 = 30 AND (m // 60) % 2 = 1 THEN m // 60 + 1 WHEN m % 60 > 30 THEN m // 60 + 1 ELSE m // 60 END AS minutes FROM (SELECT seq, seq * 15 AS m FROM enrichment WHERE kind = 'youtube')")
def video_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Whole minutes of quarter minutes, halves to the even number."""
    return table(spark, d, "enrichment").where("kind = 'youtube'").select("seq", markup.minutes(F.col("seq") * 15).alias("minutes"))


# ---- ledger and work -----------------------------------------------------


@query(f"WITH {_LINKS}, {_OWNERS} SELECT hash, item, pos::INT AS pos FROM owners")
def first_owner(spark: SparkSession, d: str) -> DataFrame:
    return ledger.first_owners(ledger.item_links(table(spark, d, "corpus"))).select("hash", "item", "pos")


@query(f"WITH {_COMPACT} SELECT hash, kind, status, url FROM state")
def ledger_compact(spark: SparkSession, d: str) -> DataFrame:
    return ledger.compact(table(spark, d, "enrichment_ledger")).select("hash", "kind", "status", "url")


@query(f"WITH {_COMPACT} SELECT status, count(*) AS links FROM state GROUP BY 1")
def ledger_by_status(spark: SparkSession, d: str) -> DataFrame:
    return ledger.counts_by_status(table(spark, d, "enrichment_ledger"))


@query(f"WITH {_COMPACT} SELECT kind, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in [*ledger.TERMINAL, 'error', 'toolong']) + " FROM state GROUP BY 1")
def kind_status_matrix(spark: SparkSession, d: str) -> DataFrame:
    return ledger.kind_status_matrix(table(spark, d, "enrichment_ledger"))


@query(_WORK + " SELECT kind, count(*) AS pending FROM work GROUP BY 1")
def pending_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return ledger.pending_by_kind(table(spark, d, "corpus"), table(spark, d, "enrichment_ledger"))


@query(_WORK + " SELECT hash, item, kind FROM work")
def worklist(spark: SparkSession, d: str) -> DataFrame:
    return ledger.worklist(table(spark, d, "corpus"), table(spark, d, "enrichment_ledger")).select("hash", "item", "kind")


@query(_WORK + " SELECT hash, item FROM work ORDER BY item, pos LIMIT 25")
def first_work(spark: SparkSession, d: str) -> DataFrame:
    return ledger.first_work(table(spark, d, "corpus"), table(spark, d, "enrichment_ledger"), 25).select("hash", "item")


@query(f"WITH {_LINKS}, {_COMPACT}, {_OWNERS} SELECT s.hash, o.item, s.url AS ledger_url FROM state s JOIN owners o ON s.hash = o.hash WHERE s.status = 'nocaptions'")
def caption_queue(spark: SparkSession, d: str) -> DataFrame:
    return ledger.caption_queue(table(spark, d, "corpus"), table(spark, d, "enrichment_ledger"))


@query(_WORK + f""", stored AS (SELECT DISTINCT left(sha1({_canon('url')}), 10) AS hash FROM enrichment WHERE body IS NOT NULL AND url IS NOT NULL)
SELECT CASE WHEN hash IN (SELECT hash FROM stored) THEN 'done' ELSE 'dead' END AS status, count(*) AS links FROM work GROUP BY 1""")
def fetch_offline(spark: SparkSession, d: str) -> DataFrame:
    work = ledger.worklist(table(spark, d, "corpus"), table(spark, d, "enrichment_ledger"))
    return inbox.fetch_from(work, table(spark, d, "enrichment")).groupBy("status").agg(F.count(F.lit(1)).alias("links"))


@query(_WORK + " SELECT kind, count(*) // 25 AS reports FROM work GROUP BY 1 HAVING count(*) >= 25")
def fetch_progress(spark: SparkSession, d: str) -> DataFrame:
    work = ledger.worklist(table(spark, d, "corpus"), table(spark, d, "enrichment_ledger"))
    return ledger.progress(work).groupBy("kind").agg(F.count(F.lit(1)).alias("reports"))


def _work_of_kinds(spark: SparkSession, d: str) -> DataFrame:
    return ledger.worklist(table(spark, d, "corpus"), table(spark, d, "enrichment_ledger"), SITE_KINDS, _real_hosts)


@query(_WORK_OF_KINDS + " SELECT kind, count(*) AS pending FROM work GROUP BY 1")
def pending_of_kinds(spark: SparkSession, d: str) -> DataFrame:
    return ledger.pending_by_kind(table(spark, d, "corpus"), table(spark, d, "enrichment_ledger"), SITE_KINDS, _real_hosts)


@query(_WORK_OF_KINDS + " SELECT hash, item, kind FROM work")
def worklist_of_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _work_of_kinds(spark, d).select("hash", "item", "kind")


@query(_WORK_OF_KINDS + " SELECT hash, item, kind FROM work ORDER BY item, pos LIMIT 25")
def first_work_of_kinds(spark: SparkSession, d: str) -> DataFrame:
    first = ledger.first_work(table(spark, d, "corpus"), table(spark, d, "enrichment_ledger"), 25, SITE_KINDS, _real_hosts)
    return first.select("hash", "item", "kind")


@query(_WORK_OF_KINDS + f""", stored AS (SELECT DISTINCT left(sha1({_canon('url')}), 10) AS hash FROM enrichment WHERE body IS NOT NULL AND url IS NOT NULL)
SELECT kind, CASE WHEN hash IN (SELECT hash FROM stored) THEN 'done' ELSE 'dead' END AS status, count(*) AS links FROM work GROUP BY 1, 2""")
def fetch_offline_of_kinds(spark: SparkSession, d: str) -> DataFrame:
    fetched = inbox.fetch_from(_work_of_kinds(spark, d), table(spark, d, "enrichment"))
    return fetched.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("links"))


@query(_WORK_OF_KINDS + " SELECT kind, count(*) // 25 AS reports FROM work GROUP BY 1 HAVING count(*) >= 25")
def fetch_progress_of_kinds(spark: SparkSession, d: str) -> DataFrame:
    return ledger.progress(_work_of_kinds(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("reports"))


# ---- clusters and items --------------------------------------------------

_POSTS = """raw AS (SELECT channel, id, pos, type, author.id AS author, ingested_at, reference.messageId AS ref, content,
  try_cast(CASE WHEN regexp_matches(trim("timestamp"), '(Z|[+-]\\d\\d:?\\d\\d)$') THEN trim("timestamp") ELSE trim("timestamp") || 'Z' END AS TIMESTAMPTZ) AS moment
  , attachments, embeds, reactions, author AS who, "timestamp" AS stamp
  FROM messages WHERE id IS NOT NULL AND channel IS NOT NULL),
last_copy AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY channel, id ORDER BY ingested_at DESC, pos DESC) = 1),
one AS (SELECT * FROM last_copy WHERE type IN ('Default', 'Reply') AND (length(content) > 0 OR len(attachments) > 0)),
posts AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY pos, id) AS n FROM one)"""


@query(f"""WITH {_POSTS}, f AS (SELECT channel, id, n, coalesce(author = lag(author) OVER w AND moment - lag(moment) OVER w <= INTERVAL 15 MINUTE, false) AS follows
  FROM posts WINDOW w AS (PARTITION BY channel ORDER BY n))
SELECT channel, id, n, max(CASE WHEN NOT follows THEN n END) OVER (PARTITION BY channel ORDER BY n) AS cluster FROM f""")
def cluster_by_gap(spark: SparkSession, d: str) -> DataFrame:
    return clusters.by_gap(clusters.posts(table(spark, d, "messages")))


# one message after the other, as the definition has it: ``seen`` are the clusters of a channel's messages so far
_CLUSTERS = f"""WITH RECURSIVE {_POSTS}, fold AS (
  SELECT channel, n, id, n AS cluster, n AS newest, author AS last_author, moment AS last_moment, MAP {{id: n}} AS seen FROM posts WHERE n = 1
  UNION ALL
  SELECT channel, n, id, target, greatest(newest, target), CASE WHEN target >= newest THEN author ELSE last_author END,
    CASE WHEN target >= newest THEN moment ELSE last_moment END, map_concat(seen, MAP {{id: target}})
  FROM (SELECT p.channel, p.n, p.id, p.author, p.moment, f.newest, f.last_author, f.last_moment, f.seen,
      CASE WHEN p.type = 'Reply' AND f.seen[p.ref] IS NOT NULL THEN f.seen[p.ref]
        WHEN coalesce(p.author = f.last_author AND p.moment - f.last_moment <= INTERVAL 15 MINUTE, false) THEN f.newest ELSE p.n END AS target
    FROM fold f JOIN posts p ON p.channel = f.channel AND p.n = f.n + 1)
), clusters AS (SELECT channel, id, n, cluster FROM fold)"""
_URL = r"https?://[^\s>\)\]]+"
_OUTSIDE = "NOT regexp_matches(lower(split_part(regexp_replace(u, '^https?://', ''), '/', 1)), '(^|[.])(" + "|".join(x.replace(".", "[.]") for x in DOMAINS) + ")$')"
_BLANKS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_SHARE_KIND = """CASE WHEN h IN ('youtube.com', 'youtu.be', 'm.youtube.com') THEN 'youtube' WHEN h = 'github.com' THEN 'github'
  WHEN h IN ('arxiv.org', 'openreview.net') OR contains(u, 'huggingface.co/papers') THEN 'paper' WHEN h IN ('x.com', 'twitter.com') THEN 'tweet' ELSE 'blog' END"""
_ITEMS = _CLUSTERS + rf""", m AS (
  SELECT c.channel, c.cluster, c.n, c.id, l.stamp, l.content, l.attachments, l.embeds, l.reactions,
    coalesce(nullif(l.who.nickname, ''), l.who.name) AS display
  FROM clusters c JOIN last_copy l ON c.channel = l.channel AND c.id = l.id
), g AS (
  SELECT channel, cluster, arg_min(id, n) AS first_id, left(first(stamp ORDER BY n), 10) AS date, first(display ORDER BY n) AS shared_by,
    string_agg(coalesce(content, ''), chr(10) ORDER BY n) AS content, flatten(list(coalesce(attachments, []) ORDER BY n)) AS files,
    list_filter(flatten(list(coalesce(embeds, []) ORDER BY n)), lambda e: e.title <> '' AND e.url <> '') AS embeds,
    list_sum(list_transform(flatten(list(coalesce(reactions, []))), lambda r: coalesce(r.count, 0))) AS reactions, count(*) AS messages
  FROM m GROUP BY 1, 2
), h AS (
  SELECT *, list_filter(list_transform(regexp_extract_all(content, '{_URL}'), lambda u: rtrim(u, '.,')), lambda u: {_OUTSIDE}) AS found FROM g
), i AS (
  SELECT *, list_filter(found, lambda u, k: list_position(found, u) = k) AS urls,
    list_transform(list_filter(files, lambda a: NOT starts_with(a.url, 'http')), lambda a: 'raw/discord/' || channel || '/' || a.url) AS stored,
    left(sha1(channel || '/' || first_id), 6) AS short_id FROM h
), slugged AS (
  SELECT *, regexp_replace(regexp_replace(lower(coalesce(list_filter(embeds, lambda e: e.url = urls[1])[-1].title,
    substr(regexp_replace(content, '{_URL}', '', 'g'), 1, 80))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s,
    list_transform(list_filter(embeds, lambda e, k: list_position(list_transform(embeds, lambda x: x.url), e.url) = k),
      lambda e: '> unfurl: ' || list_filter(embeds, lambda x: x.url = e.url)[-1].title) AS unfurls FROM i
), kinds AS (
  SELECT channel, cluster, list_sort(list(DISTINCT {_SHARE_KIND})) AS kinds FROM (
    SELECT channel, cluster, u, regexp_replace(lower(split_part(regexp_replace(u, '^https?://', ''), '/', 1)), '^www[.]', '') AS h
    FROM (SELECT channel, cluster, unnest(urls) AS u FROM i)) GROUP BY 1, 2
), said AS (
  SELECT m.channel, m.cluster, string_agg(concat_ws(chr(10), '**' || display || '** (' || replace(left(stamp, 16), 'T', ' ') || '):', nullif(m.content, ''),
    nullif(array_to_string(list_transform(attachments, lambda a: '*[attached: ' || a.fileName || ']*'), chr(10)), ''),
    CASE WHEN n = m.cluster THEN nullif(array_to_string(unfurls, chr(10)), '') END, ''), chr(10) ORDER BY n) AS body
  FROM m JOIN slugged s ON m.channel = s.channel AND m.cluster = s.cluster GROUP BY 1, 2
), items AS (
  SELECT concat_ws('-', date, coalesce(nullif(regexp_replace(substr(s.s, 1, 40), '-+$', ''), ''), 'untitled'), short_id) AS id, short_id, s.channel, shared_by, date, urls,
    coalesce(kinds.kinds, ['text']) AS kinds, stored AS attachments, coalesce(reactions, 0)::BIGINT AS reactions, messages::INT AS messages, said.body,
    len(urls) > 0 OR len(stored) > 0 OR length(trim(regexp_replace(regexp_replace(content, '{_URL}', '', 'g'), '{_BLANKS}', ' ', 'g'))) >= 200 AS kept
  FROM slugged s JOIN said ON s.channel = said.channel AND s.cluster = said.cluster
    LEFT JOIN kinds ON s.channel = kinds.channel AND s.cluster = kinds.cluster
)"""


@query(_CLUSTERS + " SELECT * FROM clusters")
def cluster_by_replies(spark: SparkSession, d: str) -> DataFrame:
    return clusters.by_replies(clusters.posts(table(spark, d, "messages")))


@query(_ITEMS + " SELECT * EXCLUDE (kept) FROM items WHERE kept")
def items_from_messages(spark: SparkSession, d: str) -> DataFrame:
    messages = table(spark, d, "messages")
    made = clusters.items(messages, clusters.by_replies(clusters.posts(messages)), DOMAINS)
    return made.where("kept").drop("kept")


@query(_ITEMS + """ SELECT channel, count(*) FILTER (WHERE kept AND x.short IS NULL) AS written, count(*) FILTER (WHERE NOT (kept AND x.short IS NULL)) AS skipped
FROM items LEFT JOIN (SELECT DISTINCT split_part(id, '-', -1) AS short FROM exclusions WHERE id IS NOT NULL) x ON short_id = x.short GROUP BY 1""")
def cluster_counters(spark: SparkSession, d: str) -> DataFrame:
    messages = table(spark, d, "messages")
    made = clusters.items(messages, clusters.by_replies(clusters.posts(messages)), DOMAINS)
    return clusters.cluster_counters(made, table(spark, d, "exclusions"))


_LAST = "last AS (SELECT * FROM corpus WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"


@query(f"""WITH {_LAST}, f AS (SELECT item_id AS id, list(DISTINCT file ORDER BY file) AS files FROM enrichment WHERE file LIKE '%.md' GROUP BY 1)
SELECT i.id, CASE WHEN f.id IS NULL THEN 'raw' ELSE 'enriched' END AS status, coalesce(array_to_string(f.files, ' '), '') AS files FROM (SELECT DISTINCT id FROM corpus) i LEFT JOIN f ON i.id = f.id""")
def item_status(spark: SparkSession, d: str) -> DataFrame:
    view = items.status_view(table(spark, d, "corpus"), table(spark, d, "enrichment"))
    return view.select("id", "status", F.array_join("enrichment", " ").alias("files"))


@query(f"""WITH {_LAST}, split AS (SELECT *, batch = (SELECT max(batch) FROM corpus) AS fresh FROM last),
first AS (SELECT * FROM corpus WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1)
SELECT l.id, CASE WHEN l.batch > 300 THEN coalesce(CASE WHEN f.batch <= 300 THEN f.status END, 'raw') ELSE l.status END AS status, l.reactions
FROM last l JOIN first f ON l.id = f.id""")
def items_upserted(spark: SparkSession, d: str) -> DataFrame:
    """Items of later batches written over those of the first ones, status kept."""
    corpus = table(spark, d, "corpus").where("id IS NOT NULL")
    first = items.latest(corpus.withColumn("seq", -F.col("seq"))).where("batch <= 300")
    last = items.latest(corpus)
    # an item known from the first batches keeps the status it had there
    known = last.where("batch <= 300").unionByName(first.join(last.where("batch > 300").select("id"), "id", "left_semi"))
    return items.upsert(last.where("batch > 300"), known).select("id", "status", "reactions")


@query("""WITH x AS (SELECT DISTINCT split_part(id, '-', -1) AS short FROM exclusions WHERE id IS NOT NULL)
SELECT DISTINCT id FROM corpus WHERE split_part(id, '-', -1) NOT IN (SELECT short FROM x) AND id IS NOT NULL""")
def items_excluded(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "corpus").where("id IS NOT NULL").select("id").distinct()
    return items.exclude(rows, table(spark, d, "exclusions"))


@query("""SELECT count(*) AS requested, count(*) FILTER (WHERE id IN (SELECT id FROM corpus WHERE id IS NOT NULL)) AS removed,
  count(*) FILTER (WHERE id NOT IN (SELECT id FROM corpus WHERE id IS NOT NULL)) AS missing FROM exclusions WHERE id IS NOT NULL""")
def exclusion_counts(spark: SparkSession, d: str) -> DataFrame:
    return items.exclusion_counts(table(spark, d, "exclusions").where("id IS NOT NULL"), table(spark, d, "corpus"))


@query("""SELECT id, coalesce(min(reason), 'out of scope') AS reason FROM exclusions WHERE excluded_on >= '2025-01-01'
AND id NOT IN (SELECT id FROM exclusions WHERE excluded_on < '2025-01-01') GROUP BY 1""")
def exclusions_added(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "exclusions")
    return items.new_exclusions(rows.where("excluded_on >= '2025-01-01'"), rows.where("excluded_on < '2025-01-01'"))


@query("""SELECT DISTINCT file FROM (SELECT 'raw/discord/' || channel || '/' || u AS file FROM (SELECT channel, unnest(attachments).url AS u FROM messages) WHERE u IS NOT NULL AND NOT starts_with(u, 'http'))
WHERE file NOT IN (SELECT f FROM (SELECT unnest(attachments) AS f FROM corpus) WHERE f IS NOT NULL)""")
def files_unreferenced(spark: SparkSession, d: str) -> DataFrame:
    return media.unreferenced_files(table(spark, d, "messages"), table(spark, d, "corpus"))


@query("""SELECT kind, count(*) AS texts, count(*) FILTER (WHERE CASE kind WHEN 'youtube' THEN length(body) >= 200 WHEN 'blog' THEN length(body) > 300
  WHEN 'paper' THEN length(body) > 2000 ELSE length(body) > 0 END) AS enough FROM enrichment WHERE body IS NOT NULL GROUP BY 1""")
def texts_long_enough(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "enrichment").where("body IS NOT NULL")
    return rows.groupBy("kind").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(media.long_enough(F.col("kind"), F.col("body"))).alias("enough")
    )


@query("""SELECT hash, max(length(error)) FILTER (WHERE error IS NOT NULL) > 60 AS shortened, count(*) AS lines FROM enrichment_ledger WHERE error IS NOT NULL AND hash IS NOT NULL GROUP BY 1""")
def errors_shortened(spark: SparkSession, d: str) -> DataFrame:
    """Per link: error lines, and whether one of them is longer than a report line."""
    rows = table(spark, d, "enrichment_ledger").where("error IS NOT NULL AND hash IS NOT NULL")
    return rows.groupBy("hash").agg(
        F.max(F.length(media.capped(F.col("error"), "error")) > 60).alias("shortened"), F.count(F.lit(1)).alias("lines")
    )


# ---- integrity -----------------------------------------------------------


@query(_INTEGRITY + " SELECT page, target, state FROM classed")
def links_classified(spark: SparkSession, d: str) -> DataFrame:
    return integrity.classified_links(_pages(spark, d), _entries(spark, d))


@query(_INTEGRITY + " SELECT page, item FROM cited WHERE item NOT IN (SELECT id FROM corpus WHERE id IS NOT NULL)")
def citations_bad(spark: SparkSession, d: str) -> DataFrame:
    return integrity.bad_citations(_pages(spark, d), table(spark, d, "corpus"))


@query(_INTEGRITY + f" SELECT DISTINCT id FROM corpus WHERE id IS NOT NULL AND id NOT IN (SELECT item FROM ({_FILED}))")
def items_uncited(spark: SparkSession, d: str) -> DataFrame:
    return integrity.uncited(_pages(spark, d), _entries(spark, d), table(spark, d, "corpus"))


@query(_INTEGRITY + " SELECT DISTINCT id FROM corpus WHERE id IS NOT NULL AND id NOT IN (SELECT item FROM members)")
def items_unplaced(spark: SparkSession, d: str) -> DataFrame:
    return integrity.unplaced(_entries(spark, d), table(spark, d, "corpus"))


@query(_INTEGRITY + f", {_INDEX} SELECT name FROM pages WHERE name NOT IN (SELECT name FROM idx)")
def pages_unindexed(spark: SparkSession, d: str) -> DataFrame:
    return integrity.unindexed(_pages(spark, d), _index(spark, d))


@query(_INTEGRITY + f", {_INDEX} SELECT name FROM idx WHERE name NOT IN (SELECT name FROM pages UNION SELECT name FROM entries)")
def index_ghosts(spark: SparkSession, d: str) -> DataFrame:
    return integrity.ghost_entries(_pages(spark, d), _entries(spark, d), _index(spark, d))


_STALE = "SELECT p.name AS page, count(*) AS newer FROM pages p JOIN members m ON p.topic = m.topic AND substr(m.item, 1, 10) > p.generated WHERE p.generated <> '~' GROUP BY 1"


@query(_INTEGRITY + " " + _STALE)
def pages_stale(spark: SparkSession, d: str) -> DataFrame:
    return integrity.stale_pages(_pages(spark, d), _entries(spark, d))


@query(_INTEGRITY + f" SELECT * FROM ({_STALE}) ORDER BY newer DESC, page LIMIT 15")
def pages_stalest(spark: SparkSession, d: str) -> DataFrame:
    return recall.top(integrity.stale_pages(_pages(spark, d), _entries(spark, d)), "newer", "page", 15)


_SUMMARY = _INTEGRITY + f""", {_INDEX}, ids AS (SELECT DISTINCT id FROM corpus WHERE id IS NOT NULL), found AS (
SELECT 'items' AS finding, count(*) AS n FROM ids UNION ALL SELECT 'pages', count(*) FROM pages
UNION ALL SELECT 'cited', count(DISTINCT item) FROM cited WHERE item IN (SELECT id FROM ids)
UNION ALL SELECT 'broken_links', count(*) FROM classed WHERE state = 'broken'
UNION ALL SELECT 'reserved_links', count(*) FROM classed WHERE state = 'reserved'
UNION ALL SELECT 'bad_citations', count(*) FROM cited WHERE item NOT IN (SELECT id FROM ids)
UNION ALL SELECT 'orphans', count(*) FROM ids WHERE id NOT IN (SELECT item FROM ({_FILED}))
UNION ALL SELECT 'unindexed', count(*) FROM pages WHERE name NOT IN (SELECT name FROM idx)
UNION ALL SELECT 'ghost_entries', count(*) FROM idx WHERE name NOT IN (SELECT name FROM pages UNION SELECT name FROM entries)
UNION ALL SELECT 'stale_pages', count(*) FROM ({_STALE}))"""


@query(_SUMMARY + " SELECT * FROM found")
def integrity_summary(spark: SparkSession, d: str) -> DataFrame:
    pages, entries = materialize(_pages(spark, d), "pages"), materialize(_entries(spark, d), "entries")
    return integrity.summary(pages, entries, table(spark, d, "corpus"), _index(spark, d))


@query(_SUMMARY + " SELECT sum(n) FILTER (WHERE finding IN ('broken_links', 'bad_citations')) = 0 AS passed FROM found")
def integrity_verdict(spark: SparkSession, d: str) -> DataFrame:
    return integrity.verdict(integrity_summary(spark, d))


@query("SELECT CASE WHEN (SELECT count(*) FROM taxonomy) > 0 THEN 'placed' WHEN (SELECT count(*) FROM corpus) > 0 THEN 'stranded' ELSE 'fresh' END AS state")
def ingest_state(spark: SparkSession, d: str) -> DataFrame:
    return integrity.ingest_state(table(spark, d, "corpus"), table(spark, d, "taxonomy"))


# ---- members and recall --------------------------------------------------

_ALIAS = "alias AS (SELECT lower(a) AS alias, min(name) AS entity FROM (SELECT name, unnest(raw) AS a FROM entries WHERE section = 'entities') WHERE a IS NOT NULL GROUP BY 1)"
_MENTIONS = "mentions AS (SELECT DISTINCT a.entity, w.item FROM (SELECT id AS item, unnest(string_split_regex(lower(body), '[^a-z0-9-]+')) AS w FROM corpus) w JOIN alias a ON w.w = a.alias WHERE w.w <> '')"


@query(f"WITH {_TAX}, {_ALIAS} SELECT alias, entity FROM alias")
def entity_aliases(spark: SparkSession, d: str) -> DataFrame:
    return members.alias_table(_entries(spark, d))


@query(f"WITH {_TAX}, {_ALIAS}, {_MENTIONS} SELECT entity, count(DISTINCT item) AS items, min(item) AS first, max(item) AS last FROM mentions GROUP BY 1")
def entity_index(spark: SparkSession, d: str) -> DataFrame:
    return members.inverted_index(members.entity_mentions(table(spark, d, "corpus"), _entries(spark, d)))


@query(f"WITH {_TAX} SELECT topic, count(DISTINCT item) AS items FROM members WHERE topic <> 'uncategorized-shares' GROUP BY 1 HAVING count(DISTINCT item) >= 20")
def topics_large(spark: SparkSession, d: str) -> DataFrame:
    return members.large_topics(_entries(spark, d), 20)


@query("""SELECT DISTINCT name, generated, items AS stated, len(list_distinct(list_filter(coalesce(id, []), lambda x: x IS NOT NULL)))::INT AS counted FROM wiki
WHERE items IS NULL OR items <> len(list_distinct(list_filter(coalesce(id, []), lambda x: x IS NOT NULL)))""")
def page_item_counts(spark: SparkSession, d: str) -> DataFrame:
    return members.page_item_counts(table(spark, d, "wiki"))


@query(f"WITH {_TAX} SELECT DISTINCT item FROM members WHERE topic = 'uncategorized-shares' AND item IN (SELECT item FROM members WHERE topic <> 'uncategorized-shares')")
def items_moved_out(spark: SparkSession, d: str) -> DataFrame:
    return members.moved_out(_entries(spark, d))


@query(f"WITH {_PAGES}, {_CITED} SELECT page, count(*) AS items FROM cited WHERE item IN (SELECT id FROM corpus WHERE batch >= 2000) GROUP BY 1")
def pages_affected(spark: SparkSession, d: str) -> DataFrame:
    return members.pages_of_items(_pages(spark, d), table(spark, d, "corpus").where("batch >= 2000"))


@query(f"""SELECT DISTINCT item, {_canon('url')} AS url FROM (SELECT id AS item, unnest(urls) AS url FROM corpus UNION ALL
SELECT item_id, rtrim(unnest(regexp_extract_all(body, 'https?://[^\\s>\\)\\]]+')), '.,') FROM enrichment) WHERE url IS NOT NULL""")
def links_harvested(spark: SparkSession, d: str) -> DataFrame:
    return members.harvested_links(table(spark, d, "corpus"), table(spark, d, "enrichment"))


@query(_INTEGRITY + " SELECT DISTINCT page FROM (SELECT name AS page FROM pages WHERE section = 'syntheses' UNION SELECT target FROM wl JOIN pages p ON wl.page = p.name WHERE p.section = 'syntheses') WHERE page IN (SELECT name FROM pages)")
def pages_one_step(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    return members.linked_pages(pages, pages.where("section = 'syntheses'").select(F.col("name").alias("page")))


@query(f"""WITH {_LAST}, {_PAGES}, {_CITED}, f AS (SELECT item, count(*) AS pages FROM cited GROUP BY 1)
SELECT id, date, urls[1] AS url, coalesce(f.pages, 0) AS pages FROM last LEFT JOIN f ON id = f.item
WHERE contains(lower(body), 'index') AND contains(lower(body), 'passage') AND date >= '2024-06-01' AND date <= '2025-06-30'""")
def recall_keywords(spark: SparkSession, d: str) -> DataFrame:
    return recall.recall(items.latest(table(spark, d, "corpus")), _pages(spark, d), ["index", "passage"], "2024-06-01", "2025-06-30")


@query(f"WITH {_LAST} SELECT id, reactions FROM last ORDER BY reactions DESC NULLS LAST, id LIMIT 15")
def items_most_liked(spark: SparkSession, d: str) -> DataFrame:
    return recall.top(items.latest(table(spark, d, "corpus")).select("id", "reactions"), "reactions", "id", 15)


@query("SELECT kind AS op, max(date) AS last, coalesce(date_diff('day', max(date)::DATE, DATE '2025-12-31') > 7, true) AS due FROM enrichment_ledger WHERE kind IS NOT NULL GROUP BY 1")
def kinds_due(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of links without a ledger line in the week before the year's end."""
    log = table(spark, d, "enrichment_ledger").where("kind IS NOT NULL").select("date", F.col("kind").alias("op"))
    return recall.checks_due(log, "2025-12-31")


@query(f"""WITH {_LAST}, n AS (SELECT channel, substr(date, 1, 7) AS month, id, (row_number() OVER (PARTITION BY channel, substr(date, 1, 7) ORDER BY date NULLS FIRST, id) - 1) // 20 AS part FROM last)
SELECT channel, month, part, count(*) AS items, min(id) AS first, max(id) AS last FROM n GROUP BY 1, 2, 3""")
def bulk_waves(spark: SparkSession, d: str) -> DataFrame:
    return recall.waves(items.latest(table(spark, d, "corpus")), 20)


# ---- streaming -----------------------------------------------------------


@query("SELECT count(DISTINCT id) AS captures FROM corpus WHERE channel = 'inbox' AND id IS NOT NULL AND body IS NOT NULL")
def inbox_stream(spark: SparkSession, d: str) -> DataFrame:
    """The inbox items as captures that arrive by batch, drained by a stream, twice; the second run finds nothing new."""
    rows = table(spark, d, "corpus").where("channel = 'inbox' AND id IS NOT NULL AND body IS NOT NULL")
    folder, out = scratch_path(spark, "inbox"), scratch_path(spark, "captures")
    note = F.concat(F.lit("---\nname: "), F.col("id"), F.lit("\n---\n"), F.col("body"))
    rows.select(F.col("id").alias("path"), note.alias("value"), "batch").repartition("batch").write.partitionBy("batch").parquet(f"{folder}/new")
    arriving = spark.readStream.schema("path string, value string, batch int").parquet(f"{folder}/new")

    def write(batch: DataFrame, number: int) -> None:
        inbox.captures(batch.dropDuplicates(["path"])).write.mode("overwrite").parquet(f"{out}/batch={number}")

    for _ in range(2):
        arriving.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).agg(F.count_distinct("file").alias("captures"))
