"""Problem 7: documents packed into containers of fixed capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.packing import fill_report, pack
from siltstone.llm.tokens import VOCABULARY, token_count
from siltstone.session import materialize, spread, table


def p7_packing(spark: SparkSession, d: str, path: str = VOCABULARY) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    sizes = materialize(docs.select("doc_id", token_count(F.col("text"), path).alias("n")), "sizes")
    kinds = [(r["container"], r["capacity"]) for r in table(spark, d, "containers").distinct().collect()]
    return pack(sizes, sorted(kinds))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p7_packing(spark, d))


def p7_sound(spark: SparkSession, d: str) -> DataFrame:
    """Per container kind: documents assigned, bins that hold more than they can, documents split without need."""
    packed = materialize(p7_packing(spark, d), "packed")
    over = packed.groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("t")).groupBy("container", "capacity").agg(
        F.count_if(F.col("t") > F.col("capacity")).alias("overfull"))
    each = packed.groupBy("container", "capacity", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("t"))
    split = (F.col("pieces") > 1) & (F.col("t") <= F.col("capacity"))
    return each.groupBy("container", "capacity").agg(F.count(F.lit(1)).alias("documents"), F.count_if(split).alias("split")).join(over, ["container", "capacity"])


QUERIES = {"p7_packing": p7_packing, "p7_fill": p7_fill, "p7_sound": p7_sound}
ORACLES = {"p7_sound": "SELECT DISTINCT container, capacity, (SELECT count(*) FROM documents) AS documents, 0 AS overfull, 0 AS split FROM containers"}
