"""Problem 8: documents whose text was cut off, and how often per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.truncation import truncated, truncation_report
from siltstone.session import table


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(table(spark, d, "documents")).select("doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return truncation_report(documents, truncated(documents))


QUERIES = {"p8_found": p8_found, "p8_report": p8_report}
ORACLES = {}
