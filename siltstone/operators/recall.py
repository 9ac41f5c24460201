"""Recall over items, pages and the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.integrity import cited
from siltstone.operators.ranking import distributed_row_number
from siltstone.session import materialize


def recall(items: DataFrame, pages: DataFrame, keywords: list[str], since: str | None = None, until: str | None = None) -> DataFrame:
    """Items that have all keywords in their text, within dates, with where they are filed.

    Columns id, date, url (the first), pages (number citing it); in no order,
    see ``newest``.
    """
    found = items
    for word in keywords:
        found = found.where(F.contains(F.lower("body"), F.lit(word.lower())))
    if since:
        found = found.where(F.col("date") >= since)
    if until:
        found = found.where(F.col("date") <= until)
    filed = cited(pages).groupBy(F.col("item").alias("id")).agg(F.count(F.lit(1)).alias("pages"))
    return found.join(filed, "id", "left").select("id", "date", F.get("urls", F.lit(0)).alias("url"), F.coalesce("pages", F.lit(0)).alias("pages"))


def check_due(entries: DataFrame, today: str, op: str, days: int = 7) -> DataFrame:
    """One row (last, due): whether log entries (date, op) have no ``op`` within ``days`` of ``today``."""
    last = entries.where(F.col("op") == op).agg(F.max("date").alias("last"))
    gap = F.datediff(F.lit(today).cast("date"), F.col("last").cast("date"))
    return last.select("last", F.coalesce(gap > days, F.lit(True)).alias("due"))


def newest(found: DataFrame, k: int | None = None) -> DataFrame:
    """Newest first, ties by id; the first ``k`` where that is asked, which needs no full sort."""
    ordered = found.orderBy(F.col("date").desc_nulls_last(), "id")
    return ordered if k is None else ordered.limit(k)


def checks_due(entries: DataFrame, today: str, days: int = 7) -> DataFrame:
    """(op, last, due) for every operation of the log (date, op), as ``check_due`` has it."""
    last = entries.where("op IS NOT NULL").groupBy("op").agg(F.max("date").alias("last"))
    gap = F.datediff(F.lit(today).cast("date"), F.col("last").cast("date"))
    return last.select("op", "last", F.coalesce(gap > days, F.lit(True)).alias("due"))


def top(df: DataFrame, metric: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows of largest ``metric``, ties by ``key``."""
    return df.orderBy(F.desc(metric), key).limit(k)


def waves(items: DataFrame, size: int) -> DataFrame:
    """(wave, items, first, last): items of each channel cut into waves of ``size`` by date and id."""
    # null channels and months are groups too, other than blank ones
    keyed = items.select("channel", F.substring("date", 1, 7).alias("month"), "date", "id").withColumns(
        {f"{c}_key": F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in ("channel", "month")}
    )
    numbered = distributed_row_number(materialize(keyed, "waves"), ["channel_key", "month_key"], ["date", "id"], "i")
    return numbered.groupBy("channel", "month", F.floor((F.col("i") - 1) / size).alias("part")).agg(
        F.count(F.lit(1)).alias("items"), F.min("id").alias("first"), F.max("id").alias("last")
    )
