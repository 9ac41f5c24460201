"""The capture inbox as a stream, and fetching behind a connector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text, urls
from siltstone.operators.media import CAPS
from siltstone.session import ship

#: (status, meta, body) of a link; what it raises becomes status error.
Fetcher = Callable[[str], tuple[str, dict[str, str], str]]
FETCHED = "hash string, url string, kind string, item string, status string, meta map<string,string>, body string"
FETCHED_COLUMNS = ["hash", "url", "kind", "item", "status", "meta", "body"]


def captures(files: DataFrame) -> DataFrame:
    """Captures from whole files (value, path): short id, first link, asset, note."""
    note = files.withColumn("note", text.front_matter(F.col("value"))).withColumn("file", F.regexp_extract("path", r"([^/]+)/?$", 1))
    link = F.get(urls.links_in(F.col("note.body")), F.lit(0))
    return note.select(
        "file", text.capture_id(link, F.col("file")).alias("short_id"), link.alias("url"),
        F.col("note.fields")["asset"].alias("asset"), F.col("note.fields")["name"].alias("name"),
        F.coalesce(F.col("note.fields")["asset"].rlike(urls.ASSET), F.lit(True)).alias("sound"), F.col("note.body").alias("body"),
    )


def drain(spark: SparkSession, inbox: str, out: str, checkpoint: str, archive: str | None = None) -> int:
    """Process every capture that is new in ``inbox``, once, and append it to ``out``.

    Returns the number of micro-batches that had rows.  What was read is kept
    in ``checkpoint``, so a run that was broken off goes on, and a capture
    whose file comes again is not processed twice: each batch replaces what it
    wrote before under its own number.
    """
    source = spark.readStream.format("text").option("wholetext", True).schema("value string")
    if archive:
        source = source.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    files = source.load(f"{inbox}/*.md").select("value", F.col("_metadata.file_path").alias("path"))
    batches = []

    def write(batch: DataFrame, number: int) -> None:
        rows = captures(batch).dropDuplicates(["file"])
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        batches.append(number)

    query = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(batches)


def outcome(link: pd.Series, fetchers: dict[str, Fetcher]) -> dict:
    """What became of one link, as a row of FETCHED.  Any failure of its fetcher is a state of the link."""
    row = {"hash": link["hash"], "url": link["url"], "kind": link["kind"], "item": link["item"], "status": "skipped", "meta": {}, "body": ""}
    if link["kind"] in fetchers:
        try:
            row["status"], row["meta"], row["body"] = fetchers[link["kind"]](link["url"])
        except Exception as failure:  # noqa: BLE001
            row |= {"status": "error", "meta": {"error": str(failure)[:CAPS["error"]]}}
    return row


def fetch(work: DataFrame, fetchers: dict[str, Fetcher], connections: int | None = None) -> DataFrame:
    """Fetch links (hash, url, kind, item) with the fetcher of their kind, on the executors.

    ``connections`` limits how many partitions fetch at a time, without
    narrowing the stages before.  A kind without fetcher is skipped.
    """
    ship(work.sparkSession)
    work = work.select("hash", "url", "kind", "item")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([outcome(link, fetchers) for _, link in batch.iterrows()], columns=FETCHED_COLUMNS)

    return (work.repartition(connections) if connections else work).mapInPandas(run, FETCHED)


def fetch_from(work: DataFrame, stored: DataFrame) -> DataFrame:
    """Offline connector: links answered from stored pages (url, meta, body); others are dead."""
    pages = stored.where("body IS NOT NULL AND url IS NOT NULL").groupBy(urls.link_hash(F.col("url")).alias("hash")).agg(
        F.max_by(F.struct("meta", "body"), "seq").alias("p")
    )
    return work.join(pages, "hash", "left").select(
        "hash", "url", "kind", "item", F.when(F.col("p").isNotNull(), "done").otherwise("dead").alias("status"),
        F.col("p.meta").alias("meta"), F.coalesce("p.body", F.lit("")).alias("body"),
    )
