"""Problem 6: token ids of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.tokens import VOCABULARY, token_ids, token_text
from siltstone.session import spread, table


def p6_ids(spark: SparkSession, d: str, path: str = VOCABULARY) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", token_ids(F.col("text"), path).alias("ids"))


def p6_round_trip(spark: SparkSession, d: str, path: str = VOCABULARY) -> DataFrame:
    """Per kind: documents, ids, and documents whose ids decode to their own text."""
    docs = spread(table(spark, d, "documents").select("kind", "text"))
    coded = docs.withColumn("ids", token_ids(F.col("text"), path))
    same = token_text(F.col("ids"), path) == F.coalesce("text", F.lit(""))
    return coded.groupBy("kind").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.size("ids")).alias("tokens"), F.count_if(same).alias("restored")
    )


def p6_restored(spark: SparkSession, d: str, path: str = VOCABULARY) -> DataFrame:
    """The texts that ids decode to, by their hash; null texts come back empty."""
    docs = p6_ids(spark, d, path)
    return docs.select("doc_id", F.md5(token_text(F.col("ids"), path)).alias("text"))


QUERIES = {"p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p6_restored": p6_restored}
ORACLES = {"p6_restored": "SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents"}
