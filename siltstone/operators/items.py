"""Items: keeping what the enricher owns, status as a view, exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reason of an exclusion that states none.
NO_REASON = "out of scope"


def latest(items: DataFrame) -> DataFrame:
    """The last row of each item id, by seq."""
    columns = [c for c in items.columns if c not in ("id", "seq")]
    return (
        items.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("seq", *columns)).alias("last")).select("id", "last.*")
    )


def upsert(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing items with ``new`` ones written over them, by id.

    ``status`` and ``enrichment`` belong to the enricher: a known item keeps
    them, an unknown one starts raw and empty.  Both sides have the same
    columns and unique ids.
    """
    kept = existing.select("id", F.col("status").alias("old_status"), F.col("enrichment").alias("old_enrichment"))
    over = new.join(kept, "id", "left").withColumn("status", F.coalesce("old_status", F.lit("raw"))).withColumn(
        "enrichment", F.coalesce("old_enrichment", F.array().cast("array<string>"))
    ).select(existing.columns)
    return over.unionByName(existing.join(new.select("id"), "id", "left_anti"))


def status_view(items: DataFrame, enrichment: DataFrame) -> DataFrame:
    """(id, status, enrichment) from the files that are there; never stored, so never stale."""
    files = (
        enrichment.where(F.col("file").endswith(".md")).select(F.col("item_id").alias("id"), "file").distinct()
        .groupBy("id").agg(F.array_sort(F.collect_list("file")).alias("files"))
    )
    return items.select("id").distinct().join(files, "id", "left").select(
        "id", F.when(F.col("files").isNotNull(), "enriched").otherwise("raw").alias("status"),
        F.coalesce("files", F.array().cast("array<string>")).alias("enrichment"),
    )


def exclude(items: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Items that no exclusion names by its short id, which outlives changes of the slug."""
    out = exclusions.where("id IS NOT NULL").select(F.substring_index("id", "-", -1).alias("short")).distinct()
    return items.withColumn("short", F.substring_index("id", "-", -1)).join(out, "short", "left_anti").drop("short")


def exclude_enrichment(enrichment: DataFrame, exclusions: DataFrame) -> DataFrame:
    """What was fetched, without that of excluded items (by full id); rows without an item stay."""
    out = exclusions.where("id IS NOT NULL").select(F.col("id").alias("item_id")).distinct()
    return enrichment.join(out, "item_id", "left_anti")


def new_exclusions(request: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(id, reason) lines to add: ids not excluded before, once each, with a reason."""
    asked = request.where("id IS NOT NULL").groupBy("id").agg(F.min("reason").alias("reason"))
    return asked.join(exclusions.select("id").distinct(), "id", "left_anti").select(
        "id", F.coalesce("reason", F.lit(NO_REASON)).alias("reason")
    )


def exclusion_counts(request: DataFrame, items: DataFrame) -> DataFrame:
    """One row: exclusions requested, items removed, and requests whose item was gone already."""
    there = items.select("id").distinct().withColumn("there", F.lit(True))
    return request.join(there, "id", "left").agg(
        F.count(F.lit(1)).alias("requested"), F.count_if(F.col("there").isNotNull()).alias("removed"),
        F.count_if(F.col("there").isNull()).alias("missing"),
    )
