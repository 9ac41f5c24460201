"""Problem 4: spellings in corpus.shared_by and messages.author that mean the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.names import spelling_groups, spelling_pairs
from siltstone.session import table


def spellings(spark: SparkSession, d: str) -> DataFrame:
    author = table(spark, d, "messages").select(F.explode(F.array("author.name", "author.nickname")).alias("name"))
    return table(spark, d, "corpus").select(F.col("shared_by").alias("name")).unionByName(author)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return spelling_pairs(spelling_groups(spellings(spark, d)))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Per group with several spellings: their number, and the first in order of text."""
    sizes = spelling_groups(spellings(spark, d)).groupBy("label").agg(F.count(F.lit(1)).alias("spellings"), F.min("name").alias("first"))
    return sizes.where("spellings > 1").select("first", "spellings")


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
ORACLES = {}
