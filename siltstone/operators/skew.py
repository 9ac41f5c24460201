"""Joins to a side with one row per key, when some keys of the other are hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import materialize

#: A key is hot from this many rows and this share of all rows; the share
#: bounds the number of hot keys, and with it what is broadcast, at 1000.
HOT_ROWS = 100_000
HOT_SHARE = 1000


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """``left`` joined (``left``, ``inner``, ``left_semi``, ``left_anti``) with ``right``.

    ``right`` holds at most one row per key.  ``left`` should be a table or
    cheap to read, as it is read once more to count keys.  Rows of hot keys
    meet a broadcast of at most ``HOT_SHARE`` rows of ``right``; all others
    take the ordinary shuffled join.  Null keys match nothing.
    """
    total = left.count()
    if total < HOT_ROWS:
        return left.join(right, on, how)
    hot = materialize(
        left.groupBy(*on).count().where(F.col("count") >= max(HOT_ROWS, total // HOT_SHARE)).select(*on), "hot"
    )
    if hot.isEmpty():
        return left.join(right, on, how)
    hot = F.broadcast(hot)
    many = left.join(hot, on, "left_semi").join(F.broadcast(right.join(hot, on, "left_semi")), on, how)
    few = left.join(hot, on, "left_anti").join(right, on, how)
    return many.unionByName(few)
