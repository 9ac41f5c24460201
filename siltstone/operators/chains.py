"""Where chains of references end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.skew import lookup_join
from siltstone.session import materialize


#: Levels that are resolved from the roots down before chains are halved.
LEVELS = 4


def follow_pointers(state: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``state`` with ``root`` filled in; rows that reach none are left out.

    ``state``: ``by``, ``id``, ``ptr`` and ``root``, where a known root is
    given and ``ptr`` is the id of another row otherwise; other columns are
    kept.  Most chains are short: in the first rounds rows take the root of
    the rows resolved in the round before, so that only those and the rows
    left move.  What remains is resolved by pointer jumping: a row takes over
    the pointer of the row it points to, which halves its way, so a chain of
    n rows takes log2(n) rounds.  Chains into nothing and circles end with
    their rows left out.
    """
    rest = [c for c in state.columns if c not in (*by, "id", "ptr", "root")]
    state = materialize(state.select(*by, "id", "ptr", "root", *rest), "chain")
    done, left = state.where("root IS NOT NULL"), state.where("root IS NULL")
    newest, found = done, [done]
    for _ in range(LEVELS):
        if left.isEmpty():
            break
        roots = newest.select(*by, F.col("id").alias("ptr"), F.col("root").alias("new_root"))
        step = materialize(lookup_join(left.drop("root"), roots, [*by, "ptr"]), "level")
        newest = step.where("new_root IS NOT NULL").withColumnRenamed("new_root", "root").select(state.columns)
        left = step.where("new_root IS NULL").withColumnRenamed("new_root", "root").select(state.columns)
        found.append(newest)
    else:
        found.append(_jump(left, newest, by, rest))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _jump(left: DataFrame, newest: DataFrame, by: list[str], rest: list[str]) -> DataFrame:
    """Rows of ``left``, resolved, whose pointers lead to rows of ``left`` or of ``newest``."""
    known = newest.select(*by, "id", "ptr", "root", *rest)
    state, reach, last = left, 1, False
    n = left.count()
    while n and not last:
        # all unresolved ancestors of a row are among the unresolved rows, so
        # from here one more round resolves every chain that is not a circle
        last = reach >= n
        ahead = state.unionByName(known).select(
            *by, F.col("id").alias("ptr"), F.col("root").alias("a_root"), F.col("ptr").alias("a_ptr")
        )
        moved = lookup_join(state.where("root IS NULL").drop("root"), ahead, [*by, "ptr"], "inner").select(
            *by, "id", F.col("a_ptr").alias("ptr"), F.col("a_root").alias("root"), *rest
        )
        state = materialize(state.where("root IS NOT NULL").unionByName(moved), "chain")
        n, reach = state.where("root IS NULL").count(), 2 * reach
    return state.where("root IS NOT NULL")
