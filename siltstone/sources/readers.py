"""Readers: files at the edge become typed tables; schemas are declared, never inferred."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators.digests import parsed

MESSAGE = (
    "id string, type string, timestamp string, content string, author struct<id:string,name:string,nickname:string>,"
    " reference struct<messageId:string>, attachments array<struct<url:string,fileName:string>>,"
    " embeds array<struct<url:string,title:string>>, reactions array<struct<count:int>>"
)
LEDGER = "hash string, url string, kind string, status string, date string, title string, error string, path string, via string"
TAXONOMY = (
    "topics map<string,struct<description:string,items:array<string>>>, entities map<string,struct<kind:string,raw:array<string>>>"
)


def chat_export(spark: SparkSession, root: str) -> DataFrame:
    """Messages of ``root``/<channel>/messages.json with channel and array position; an error if there are none."""
    files = spark.read.schema(f"messages array<struct<{_struct(MESSAGE)}>>").option("multiLine", True).json(f"{root}/*/messages.json")
    channel = F.regexp_extract("_metadata.file_path", r"([^/]+)/messages\.json$", 1)
    return files.select(channel.alias("channel"), F.posexplode("messages").alias("pos", "m")).select("channel", "pos", "m.*")


def _struct(columns: str) -> str:
    depth, out = 0, []
    for part in columns.split(" "):
        out.append(part)
        depth += part.count("<") - part.count(">")
    text_ = " ".join(out)
    # top-level "name type" pairs become "name:type"
    cols, depth, start = [], 0, 0
    for i, c in enumerate(text_ + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = text_[start:i].strip().split(" ", 1)
            cols.append(f"{name}:{kind.replace(' ', '')}")
            start = i + 1
    return ",".join(cols)


def notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes with front matter: path, stem, fields, body."""
    files = spark.read.text(path, wholetext=True).select("_metadata.file_path", "value")
    note = files.withColumn("note", text.front_matter(F.col("value")))
    return note.select(
        F.col("file_path").alias("path"), F.regexp_extract("file_path", r"([^/]+)\.md$", 1).alias("stem"),
        F.col("note.fields").alias("fields"), F.col("note.body").alias("body"), F.col("value").alias("text"),
    )


def corpus_notes(spark: SparkSession, root: str) -> DataFrame:
    """Items of ``root``/<year>/*.md: path, id, and all links listed in the note."""
    files = spark.read.text(f"{root}/*/*.md", wholetext=True).select("_metadata.file_path", "value")
    return files.select(
        F.col("file_path").alias("path"), text.field(F.col("value"), "id").alias("id"),
        F.regexp_extract_all("value", F.lit(r"(?dm)^  - (https?://\S+)$"), F.lit(1)).alias("urls"),
    )


def item_ids(spark: SparkSession, root: str) -> DataFrame:
    """Ids of items from their file names alone; contents are not read."""
    files = spark.read.format("binaryFile").load(f"{root}/*/*.md").select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("id"))


def wiki_notes(spark: SparkSession, root: str) -> DataFrame:
    """Pages of the three sections; of equal names that of entities counts, then of syntheses."""
    found = None
    for rank, section in enumerate(["topics", "syntheses", "entities"]):
        if spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{section}").getFileSystem(
            spark._jsc.hadoopConfiguration()
        ).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{section}")):
            part = notes(spark, f"{root}/{section}/*.md").withColumn("section", F.lit(section)).withColumn("rank", F.lit(rank))
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "name string, section string, topic string, generated string, text string")
    best = found.groupBy("stem").agg(F.max(F.struct("rank", "section", "text")).alias("p"))
    return best.select(
        F.col("stem").alias("name"), "p.section", text.field(F.col("p.text"), "topic").alias("topic"),
        text.field(F.col("p.text"), "generated", r"\d{4}-\d{2}-\d{2}").alias("generated"), "p.text",
    )


def index_names(spark: SparkSession, path: str) -> DataFrame:
    """(text): the index of the wiki, as lines; a missing file has none."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], "text string")
    return spark.read.text(path).select(F.col("value").alias("text"))


def digest_notes(spark: SparkSession, root: str) -> DataFrame:
    """Digests of ``root``/*.md, see ``digests.parsed``."""
    return parsed(spark.read.text(f"{root}/*.md", wholetext=True))


def ledger_lines(spark: SparkSession, path: str) -> DataFrame:
    """Ledger lines; blank lines are skipped."""
    return spark.read.schema(LEDGER).json(path).where("hash IS NOT NULL")


def exclusion_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, reason) of a tab-separated file; a missing file has no lines."""
    rows = spark.read.schema("id string, reason string").csv(path, sep="\t", quote="")
    return rows.where("trim(id) <> ''")


def exclusion_request(spark: SparkSession, path: str) -> DataFrame:
    """(id, reason) of a JSON array; a missing reason is null."""
    return spark.read.schema("id string, reason string").option("multiLine", True).json(path)


def taxonomy_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a taxonomy document: name, section, description, items, kind, raw."""
    doc = spark.read.schema(TAXONOMY).option("multiLine", True).json(path)
    topics = doc.select(F.explode("topics").alias("name", "t")).select(
        "name", F.lit("topics").alias("section"), "t.description", "t.items",
        F.lit(None).cast("string").alias("kind"), F.lit(None).cast("array<string>").alias("raw"),
    )
    entities = doc.select(F.explode("entities").alias("name", "e")).select(
        "name", F.lit("entities").alias("section"), F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("array<string>").alias("items"), "e.kind", "e.raw",
    )
    return topics.unionByName(entities)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(date, op, title) of the operations log."""
    entry = spark.read.text(path).select(text.log_entry(F.col("value")).alias("e"))
    return entry.select("e.*").where("date IS NOT NULL")


def config(path: str) -> dict:
    """Settings of an instance; a missing or broken file gives none."""
    try:
        with open(os.path.expanduser(path)) as f:
            return json.load(f)
    except (OSError, ValueError):
        return {}
