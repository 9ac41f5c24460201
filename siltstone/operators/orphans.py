"""References to records that do not exist, per table and period.

String keys are replaced by integers in the order of the keys, parent keys
are compressed into contiguous runs, and every referenced key is matched
as-of to the run that starts at or before it: a key beyond that run's end has
no parent.  Nothing else tells whether a parent exists; the dates of a parent
are looked up for keys inside a run only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.ranking import distributed_row_number
from siltstone.operators.skew import lookup_join
from siltstone.session import materialize

#: Integer keys in one block of the as-of match.
BLOCK = 4096


def clean_reference(ref):
    """A written id without blanks, quoting marks, path and file ending; null if nothing is left."""
    bare = F.regexp_replace(ref, r"""^[\s\p{Z}`'"“”‘’«»<>\[\]()]+|[\s\p{Z}`'"“”‘’«»<>\[\]()]+$""", "")
    leaf = F.regexp_replace(bare, r"^.*[/\\]", "")
    plain = F.regexp_replace(leaf, r"(?i)\.(md|markdown|txt|json|html?)$", "")
    return F.nullif(F.trim(plain), F.lit(""))


def references(df: DataFrame, table: str, key: str, date: str, ids: str) -> DataFrame:
    """Distinct (ref_table, ref_key, ref_date, item_id) from an array column of ids.

    Rows whose key or date is null and null, empty or blank ids give nothing.
    """
    return (
        df.where(F.col(key).isNotNull() & F.col(date).isNotNull())
        .select(
            F.lit(table).alias("ref_table"),
            F.col(key).alias("ref_key"),
            F.col(date).alias("ref_date"),
            F.explode(ids).alias("item_id"),
        )
        .withColumn("item_id", clean_reference("item_id"))
        .where("item_id IS NOT NULL")
        .distinct()
    )


def parent_runs(parents: DataFrame) -> DataFrame:
    """(run_start, run_end) of the contiguous integer keys ``k`` of ``parents``, which must differ.

    A run is cut where a block ends, so that a window never holds more than a
    block.
    """
    island = Window.partitionBy("block").orderBy("k")
    return (
        parents.select("k", F.floor(F.col("k") / BLOCK).alias("block"))
        .withColumn("island", F.col("k") - F.row_number().over(island))
        .groupBy("block", "island")
        .agg(F.min("k").alias("run_start"), F.max("k").alias("run_end"))
        .drop("island")
    )


def placed_in_runs(keys: DataFrame, runs: DataFrame) -> DataFrame:
    """(k, inside) of different ``keys`` (k): whether the run that starts at or before a key reaches it."""
    events = keys.select(F.floor(F.col("k") / BLOCK).alias("block"), "k", F.lit(None).cast("bigint").alias("run_end")).unionByName(
        runs.select("block", F.col("run_start").alias("k"), "run_end")
    )
    asof = (
        Window.partitionBy("block")
        .orderBy("k", F.col("run_end").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    reach = events.withColumn("end", F.last("run_end", ignorenulls=True).over(asof)).where("run_end IS NULL")
    return reach.select("k", F.coalesce(F.col("k") <= F.col("end"), F.lit(False)).alias("inside"))


def orphan_references(refs: DataFrame, parents: DataFrame, parent_id: str, arrived: str, removed: DataFrame,
                      removed_id: str, removed_on: str) -> DataFrame:
    """Rows of ``refs`` (see ``references``) that named no valid parent on their ``ref_date``.

    A parent is valid on a date if one of its rows arrived on or before that
    date and no row of ``removed`` names it on or before that date.  Parents
    with a null id, and removals with a null id or date, are left out; a
    parent whose rows all lack an arrival time is never valid.  Repeated rows
    change nothing; empty tables are allowed; dates are text as yyyy-MM-dd.
    """
    first = (
        parents.where(F.col(parent_id).isNotNull() & F.col(arrived).isNotNull())
        .groupBy(F.col(parent_id).alias("item_id"))
        .agg(F.date_format(F.min(arrived), "yyyy-MM-dd").alias("since"))
    )
    gone = (
        removed.where(F.col(removed_id).isNotNull() & F.col(removed_on).isNotNull())
        .groupBy(F.col(removed_id).alias("item_id"))
        .agg(F.min(removed_on).alias("until"))
    )
    refs, first = materialize(refs, "refs"), materialize(first, "parents")
    named = refs.groupBy("item_id").agg(F.lit(True).alias("asked"), F.lit(None).cast("string").alias("since"))
    ids = first.select("item_id", F.lit(False).alias("asked"), "since").unionByName(named).groupBy("item_id").agg(
        F.max("asked").alias("asked"), F.max("since").alias("since"), F.lit(0).alias("all")
    )
    keys = materialize(distributed_row_number(materialize(ids, "ids"), ["all"], ["item_id"], "k").drop("all"), "keys")
    placed = placed_in_runs(keys.where("asked").select("k"), parent_runs(keys.where("since IS NOT NULL").select("k")))
    known = (
        keys.where("asked").join(placed, "k")
        .join(gone, "item_id", "left")
        .select("item_id", F.when(F.col("inside"), F.col("since")).alias("since"), "inside", "until")
    )
    return (
        lookup_join(refs, known, ["item_id"], "inner")
        .where(
            ~F.col("inside")
            | (F.col("since") > F.col("ref_date"))
            | F.coalesce(F.col("until") <= F.col("ref_date"), F.lit(False))
        )
        .select("ref_table", "ref_key", "ref_date", "item_id")
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphan references per table and month of ``ref_date``."""
    return orphans.groupBy("ref_table", F.substring("ref_date", 1, 7).alias("month")).agg(
        F.count(F.lit(1)).alias("orphans"), F.countDistinct("item_id").alias("items")
    )
