"""Problem 2: corpus rows that repeat something accepted before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.history import History, repeated
from siltstone.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """All rows, as one batch into an empty index."""
    return repeated(table(spark, d, "corpus"), table(spark, d, "enrichment_ledger"), History(spark))


def p2_last_batch(spark: SparkSession, d: str) -> DataFrame:
    """The last batch alone, against the index of the batches before it."""
    corpus, ledger = table(spark, d, "corpus"), table(spark, d, "enrichment_ledger")
    last = corpus.agg(F.max("batch")).first()[0]
    history = History(spark)
    repeated(corpus.where(F.col("batch") < last), ledger, history)
    return repeated(corpus.where(F.col("batch") == last), ledger, history)


QUERIES = {"p2_found": p2_found, "p2_last_batch": p2_last_batch}
ORACLES = {}
