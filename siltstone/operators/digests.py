"""Digests: the facts kept of each item, their shape, recall over them, and placing items by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators.integrity import LEDGER_TOPIC

#: How a digest may be rated, and how many facts and candidate topics it may have.
SIGNALS = ["high", "medium", "low"]
FACTS, CANDIDATES = (3, 15), (2, 5)
BULLET = r"(?m)^- (.+)$"


def parsed(notes: DataFrame) -> DataFrame:
    """(id, date, signal, topics, entities, media, facts) of whole notes (value)."""
    note = notes.select(text.front_matter(F.col("value")).alias("n"))
    listed = lambda k: F.coalesce(text.inline_list(F.col("n.fields")[k]), F.array().cast("array<string>")).alias(k)
    return note.select(
        *[F.col("n.fields")[k].alias(k) for k in ("id", "date", "signal")], *[listed(k) for k in ("topics", "entities", "media")],
        F.regexp_extract_all("n.body", F.lit(BULLET), F.lit(1)).alias("facts"),
    )


def _outside(n: Column, bounds: tuple[int, int]) -> Column:
    return (n < bounds[0]) | (n > bounds[1])


def faults(digests: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(id, fault) of digests that are not as they should be.

    Faults: signal, facts (too few or too many), topics: without a taxonomy
    their number, with one (``entries``: name, section) any that it lacks.
    """
    wrong = F.coalesce(~F.col("signal").isin(SIGNALS), F.lit(True))
    checks = [F.when(wrong, "signal"), F.when(_outside(F.size("facts"), FACTS), "facts")]
    if entries is None:
        checks.append(F.when(_outside(F.size("topics"), CANDIDATES), "topics"))
    found = digests.select("id", F.explode(F.array_compact(F.array(*checks))).alias("fault"))
    if entries is None:
        return found
    named = entries.where("section = 'topics'").select(F.col("name").alias("topic")).distinct()
    unknown = digests.select("id", F.explode("topics").alias("topic")).join(named, "topic", "left_anti")
    return found.unionByName(unknown.select("id", F.lit("topics").alias("fault")).distinct())


def with_signal(digests: DataFrame, least: str = "medium") -> DataFrame:
    """Digests rated ``least`` or better."""
    return digests.where(F.col("signal").isin(SIGNALS[:SIGNALS.index(least) + 1]))


def recall_facts(digests: DataFrame, keywords: list[str], since: str | None = None, until: str | None = None) -> DataFrame:
    """(id, date, facts): digests that have all keywords in their facts, with the facts that have one."""
    def has(word: str):
        return lambda fact: F.contains(F.lower(fact), F.lit(word.lower()))

    found = digests
    for word in keywords:
        found = found.where(F.exists("facts", has(word)))
    found = found.where(F.col("date") >= since) if since else found
    found = found.where(F.col("date") <= until) if until else found

    def any_of(f: Column) -> Column:
        out = F.lit(False)
        for word in keywords:
            out = out | has(word)(f)
        return out

    return found.select("id", "date", F.filter("facts", any_of).alias("facts"))


def placements(digests: DataFrame, members: DataFrame, topics: DataFrame) -> DataFrame:
    """Members (topic, item) after placing ``digests``: items are added to each of their topics that exists.

    ``topics`` (topic) are all there are, new ones included; an item that so
    finds a place leaves the ledger topic.  Members listed twice count once.
    """
    placed = digests.select(F.col("id").alias("item"), F.explode("topics").alias("topic")).join(topics.distinct(), "topic", "left_semi")
    placed = placed.where(F.col("topic") != LEDGER_TOPIC).select("topic", "item").distinct()
    stay = members.where(F.col("topic") != LEDGER_TOPIC).select("topic", "item")
    waiting = members.where(F.col("topic") == LEDGER_TOPIC).select("topic", "item").join(placed.select("item").distinct(), "item", "left_anti")
    return stay.unionByName(waiting.select("topic", "item")).unionByName(placed).distinct()


def split_topic(members: DataFrame, finer: DataFrame) -> DataFrame:
    """Members (topic, item) after reassigning: items of a topic that ``finer`` (topic, item, to) names move there."""
    moved = members.select("topic", "item").distinct().join(finer.select("topic", "item", "to").distinct(), ["topic", "item"], "left")
    return moved.select(F.coalesce("to", "topic").alias("topic"), "item").distinct()
