"""Topics, entities and the items that belong to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text, urls
from siltstone.operators.integrity import LEDGER_TOPIC, cited, topic_members


def alias_table(entries: DataFrame) -> DataFrame:
    """(alias, entity): raw spellings of entities in lower case; of several entities the first by name."""
    each = entries.where("section = 'entities'").select(F.col("name").alias("entity"), F.explode("raw").alias("alias"))
    return each.where("alias IS NOT NULL").groupBy(F.lower("alias").alias("alias")).agg(F.min("entity").alias("entity"))


def entity_mentions(items: DataFrame, entries: DataFrame) -> DataFrame:
    """(entity, item): items whose text has an alias of the entity as a word."""
    words = items.select(F.col("id").alias("item"), F.explode(F.array_distinct(F.split(F.lower("body"), "[^a-z0-9-]+"))).alias("alias"))
    return words.where("alias <> ''").join(alias_table(entries), "alias").select("entity", "item").distinct()


def inverted_index(mentions: DataFrame) -> DataFrame:
    """Per entity: number of items, and the first and last item by id."""
    return mentions.groupBy("entity").agg(
        F.count_distinct("item").alias("items"), F.min("item").alias("first"), F.max("item").alias("last")
    )


def large_topics(entries: DataFrame, least: int) -> DataFrame:
    """(topic, items): topics with at least ``least`` different items, the ledger topic aside."""
    return (
        topic_members(entries).where(F.col("topic") != LEDGER_TOPIC).groupBy("topic")
        .agg(F.count_distinct("item").alias("items")).where(F.col("items") >= least)
    )


def page_item_counts(wiki: DataFrame) -> DataFrame:
    """(name, generated, stated, counted): pages whose stated number of items is not that of their ids."""
    return wiki.select(
        "name", "generated", F.col("items").alias("stated"),
        F.size(F.array_distinct(F.filter(F.coalesce("id", F.array().cast("array<string>")), lambda x: x.isNotNull()))).alias("counted"),
    ).where("stated IS NULL OR stated <> counted").distinct()


def moved_out(entries: DataFrame) -> DataFrame:
    """(item): items of the ledger topic that another topic lists as well, to be taken out of it."""
    members = topic_members(entries)
    filed = members.where(F.col("topic") == LEDGER_TOPIC).select("item").distinct()
    return filed.join(members.where(F.col("topic") != LEDGER_TOPIC).select("item"), "item", "left_semi")


def pages_of_items(pages: DataFrame, items: DataFrame) -> DataFrame:
    """(page, items): pages to be written again because they cite one of ``items`` (id)."""
    return cited(pages).join(items.select(F.col("id").alias("item")).distinct(), "item", "left_semi").groupBy("page").agg(
        F.count(F.lit(1)).alias("items")
    )


def harvested_links(items: DataFrame, enrichment: DataFrame) -> DataFrame:
    """(item, url): an item's links and those found in what was fetched for it, one step and no further."""
    own = items.select(F.col("id").alias("item"), F.explode("urls").alias("url"))
    found = enrichment.select(F.col("item_id").alias("item"), F.explode(urls.links_in(F.col("body"))).alias("url"))
    return own.unionByName(found).where("url IS NOT NULL").select("item", urls.canonical(F.col("url")).alias("url")).distinct()


def linked_pages(pages: DataFrame, start: DataFrame) -> DataFrame:
    """(page): the pages ``start`` (page) and those they link to, one step."""
    links = pages.join(start.withColumnRenamed("page", "name"), "name", "left_semi").select(
        F.explode(text.wikilinks(F.col("text"))).alias("page")
    )
    there = pages.select(F.col("name").alias("page"))
    return start.select("page").unionByName(links).distinct().join(there, "page", "left_semi")
