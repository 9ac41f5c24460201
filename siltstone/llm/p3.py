"""Problem 3: rows of enrichment and of its ledger that hold residue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.residue import residue
from siltstone.session import spread, table


def judged(spark: SparkSession, d: str) -> DataFrame:
    """(ref_table, seq, reason, coverage) of all rows with residue."""
    bodies = spread(table(spark, d, "enrichment").where("body IS NOT NULL").select("seq", "body"))
    errors = spread(table(spark, d, "enrichment_ledger").where("error IS NOT NULL").select("seq", "error"))
    both = bodies.select(F.lit("enrichment").alias("ref_table"), "seq", residue(F.col("body")).alias("r")).unionByName(
        errors.select(F.lit("enrichment_ledger").alias("ref_table"), "seq", residue(F.col("error")).alias("r"))
    )
    return both.where("r.reason IS NOT NULL").select("ref_table", "seq", "r.reason", "r.coverage")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("ref_table", "seq")


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).groupBy("ref_table", "reason").agg(F.count(F.lit(1)).alias("rows"), F.min("coverage").alias("least"))


QUERIES = {"p3_found": p3_found, "p3_reasons": p3_reasons}
ORACLES = {}
