"""Row numbers over groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize, width


#: Groups with more rows than this are numbered in parts.
GROUP_ROWS = 200_000


def distributed_row_number(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: 1, 2, ... within ``by`` in the order of ``order``.

    ``by`` columns must not be null.  ``by + order`` should identify a row;
    rows that tie get different numbers in no stated order.  ``df`` is read
    more than once and should be a table or cheap to make.

    Groups of up to GROUP_ROWS rows take an ordinary window.  The rows of
    larger ones are range-partitioned by (by, order), so that a group that
    holds a third of all rows is cut over many tasks.  A task's rows are
    numbered on their own; the count of a group's rows in the tasks before is
    added after.
    """
    plain = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")
    large = materialize(df.groupBy(*by).count().where(F.col("count") > GROUP_ROWS).select(*by), "large")
    if large.isEmpty():
        return df.withColumn(out, plain)
    some = _in_parts(df.join(large, by, "left_semi"), by, order, out)
    return some.unionByName(df.join(large, by, "left_anti").withColumn(out, plain).select(some.columns))


def _in_parts(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """Row numbers over range partitions.  Only a partition's first group can begin
    before it, so at most one row per partition is broadcast."""
    n = width(df.sparkSession)
    cut = materialize(
        df.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()), "ranked"
    )
    local = cut.withColumn("__n", F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order)).cast("bigint"))
    counts = cut.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__size"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        counts.withColumn("__off", F.sum("__size").over(earlier)).where("__off > 0").drop("__size")
    )
    return (
        local.join(F.broadcast(carried), [*by, "__part"], "left")
        .withColumn(out, F.col("__n") + F.coalesce("__off", F.lit(0)))
        .select(*df.columns, out)
    )


#: Rows in one block of ``carry_last``.
BLOCK = 4096


def carry_last(df: DataFrame, by: list[str], n: str, value, out: str, before: bool = False) -> DataFrame:
    """Add ``out``: the last non-null ``value`` at or before a row (``before``: strictly before).

    ``n`` numbers the rows of each group ``by`` from 1 on, as
    ``distributed_row_number`` does.  Rows are handled in blocks of numbers;
    what the blocks before leave behind is one row per block.
    """
    blocks = df.withColumn("__value", value).withColumn("__block", F.floor(F.col(n) / BLOCK))
    inside = Window.partitionBy(*by, "__block").orderBy(n)
    frame = inside.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    earlier = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        blocks.where("__value IS NOT NULL").groupBy(*by, "__block").agg(F.max_by("__value", n).alias("__end"))
    )
    carried = (
        blocks.select(*by, "__block").distinct().join(ends, [*by, "__block"], "left")
        .withColumn("__carried", F.last("__end", ignorenulls=True).over(earlier)).drop("__end")
    )
    return (
        blocks.join(carried, [*by, "__block"], "left")
        .withColumn(out, F.coalesce(F.last("__value", ignorenulls=True).over(frame), F.col("__carried")))
        .drop("__value", "__block", "__carried")
    )
