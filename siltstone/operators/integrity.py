"""Integrity of pages, taxonomy and items, as queries that return what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text

#: Topic of items that fit nowhere; being in it counts as being filed.
LEDGER_TOPIC = "uncategorized-shares"
#: Where two sections have a page of one name, the one named later counts.
SECTIONS = ["topics", "syntheses", "entities"]


def current_pages(wiki: DataFrame) -> DataFrame:
    """The page of each name: by section, then the newest version."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")), F.lit(0))
    row = F.struct(rank.alias("rank"), F.coalesce("generated", F.lit("")).alias("g"), "section", "topic", "generated", "id", "text")
    return wiki.where("name IS NOT NULL").groupBy("name").agg(F.max(row).alias("p")).select(
        "name", "p.section", "p.topic", "p.generated", F.col("p.id").alias("ids"), "p.text"
    )


def current_taxonomy(taxonomy: DataFrame) -> DataFrame:
    """The newest snapshot's entry of each name."""
    row = F.struct("wave", "section", "description", "kind", "raw", "items")
    return taxonomy.where("name IS NOT NULL").groupBy("name").agg(F.max(row).alias("t")).select("name", "t.*")


def topic_members(entries: DataFrame) -> DataFrame:
    """(topic, item) pairs, as often as they are listed."""
    return entries.where("section = 'topics'").select(F.col("name").alias("topic"), F.explode("items").alias("item")).where("item IS NOT NULL")


def classified_links(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """(page, target, state) of every distinct link: ok, reserved (a name without a page yet) or broken."""
    links = pages.select(F.col("name").alias("page"), F.explode(text.wikilinks(F.col("text"))).alias("target"))
    built = pages.select(F.col("name").alias("target"), F.lit(1).alias("built"))
    named = entries.select(F.col("name").alias("target"), F.lit(1).alias("named"))
    state = F.when(F.col("built").isNotNull(), "ok").when(F.col("named").isNotNull(), "reserved").otherwise("broken")
    return links.join(built, "target", "left").join(named, "target", "left").select("page", "target", state.alias("state"))


def cited(pages: DataFrame) -> DataFrame:
    """(page, item) of every distinct citation."""
    return pages.select(F.col("name").alias("page"), F.explode(text.citations(F.col("text"))).alias("item"))


def bad_citations(pages: DataFrame, items: DataFrame) -> DataFrame:
    return cited(pages).join(items.select(F.col("id").alias("item")).distinct(), "item", "left_anti").select("page", "item")


def uncited(pages: DataFrame, entries: DataFrame, items: DataFrame) -> DataFrame:
    """Items that no page cites and that the ledger topic does not list."""
    filed = topic_members(entries).where(F.col("topic") == LEDGER_TOPIC).select(F.col("item").alias("id"))
    named = cited(pages).select(F.col("item").alias("id")).unionByName(filed).distinct()
    return items.select("id").where("id IS NOT NULL").distinct().join(named, "id", "left_anti")


def unplaced(entries: DataFrame, items: DataFrame) -> DataFrame:
    """Items in no topic at all."""
    return items.select("id").where("id IS NOT NULL").distinct().join(
        topic_members(entries).select(F.col("item").alias("id")).distinct(), "id", "left_anti"
    )


def unindexed(pages: DataFrame, index: DataFrame) -> DataFrame:
    """Pages that no text of ``index`` (text) links to."""
    linked = index.select(F.explode(text.wikilinks(F.col("text"))).alias("name")).distinct()
    return pages.select("name").join(linked, "name", "left_anti")


def ghost_entries(pages: DataFrame, entries: DataFrame, index: DataFrame) -> DataFrame:
    """Names that the index links to and that are neither page nor taxonomy entry."""
    linked = index.select(F.explode(text.wikilinks(F.col("text"))).alias("name")).distinct()
    known = pages.select("name").unionByName(entries.select("name")).distinct()
    return linked.join(known, "name", "left_anti")


def stale_pages(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """(page, newer): pages whose topic lists items dated after the page."""
    dated = pages.where("generated IS NOT NULL AND topic IS NOT NULL").select(F.col("name").alias("page"), "topic", "generated")
    newer = dated.join(topic_members(entries), "topic").where(F.substring("item", 1, 10) > F.col("generated"))
    return newer.groupBy("page").agg(F.count(F.lit(1)).alias("newer"))


def summary(pages: DataFrame, entries: DataFrame, items: DataFrame, index: DataFrame) -> DataFrame:
    """One row per finding: name and number."""
    ids = items.select("id").where("id IS NOT NULL").distinct()
    links = classified_links(pages, entries)
    good = cited(pages).select(F.col("item").alias("id")).distinct().join(ids, "id", "left_semi")
    parts = {
        "items": ids, "pages": pages, "cited": good, "broken_links": links.where("state = 'broken'"),
        "reserved_links": links.where("state = 'reserved'"), "bad_citations": bad_citations(pages, items),
        "orphans": uncited(pages, entries, items), "unindexed": unindexed(pages, index),
        "ghost_entries": ghost_entries(pages, entries, index), "stale_pages": stale_pages(pages, entries),
    }
    out = None
    for name, found in parts.items():
        row = found.agg(F.lit(name).alias("finding"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


#: Rows a report shows of each finding.
SHOWN = {"broken_links": 20, "bad_citations": 20, "orphans": 20, "unindexed": 10, "ghost_entries": 10, "stale_pages": 15}


def report_lists(pages: DataFrame, entries: DataFrame, items: DataFrame, index: DataFrame) -> DataFrame:
    """(finding, place, subject, detail): the first rows of each finding, stale pages by how many items are newer."""
    none = F.lit(None).cast("string")
    parts = {
        "broken_links": classified_links(pages, entries).where("state = 'broken'").select(F.col("page").alias("subject"), F.col("target").alias("detail")),
        "bad_citations": bad_citations(pages, items).select(F.col("page").alias("subject"), F.col("item").alias("detail")),
        "orphans": uncited(pages, entries, items).select(F.col("id").alias("subject"), none.alias("detail")),
        "unindexed": unindexed(pages, index).select(F.col("name").alias("subject"), none.alias("detail")),
        "ghost_entries": ghost_entries(pages, entries, index).select(F.col("name").alias("subject"), none.alias("detail")),
        "stale_pages": stale_pages(pages, entries).select(F.col("page").alias("subject"), F.col("newer").cast("string").alias("detail")),
    }
    out = None
    for name, found in parts.items():
        order = [F.col("detail").cast("bigint").desc(), F.col("subject")] if name == "stale_pages" else [F.col("subject"), F.col("detail")]
        first = found.orderBy(*order).limit(SHOWN[name])
        # no more rows than are shown
        numbered = first.select(F.lit(name).alias("finding"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("place"), "subject", "detail")
        out = numbered if out is None else out.unionByName(numbered)
    return out


def verdict(found: DataFrame) -> DataFrame:
    """One row (passed): links and citations are sound; other findings are reports."""
    wrong = F.sum(F.when(F.col("finding").isin("broken_links", "bad_citations"), F.col("n")).otherwise(0))
    return found.agg((wrong == 0).alias("passed"))


def ingest_state(items: DataFrame, entries: DataFrame) -> DataFrame:
    """One row (state): placed, fresh (nothing at all), or stranded (items, but no taxonomy)."""
    n = items.where("id IS NOT NULL").agg(F.count(F.lit(1)).alias("items"))
    t = entries.agg(F.count(F.lit(1)).alias("entries"))
    state = F.when(F.col("entries") > 0, "placed").when(F.col("items") > 0, "stranded").otherwise("fresh")
    return n.crossJoin(t).select(state.alias("state"))
