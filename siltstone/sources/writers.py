"""Writers: idempotent sinks for items, enrichment, ledger and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators.items import upsert
from siltstone.session import materialize

#: Parts into which ``write_changed`` cuts a table, so that a change rewrites few of its rows.
PARTS = 32


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _replace(new: DataFrame, path: str, part: str, merge) -> None:
    """Write ``new`` into the table at ``path``: the partitions ``part`` that occur become merge(new, old rows of them).

    What is written is cut loose from the table first, so that it can be
    replaced; run again, it gives the same table.
    """
    rows = new
    if exists(new.sparkSession, path):
        touched = new.select(part).distinct()
        rows = merge(new, new.sparkSession.read.parquet(path).join(touched, part, "left_semi"))
    materialize(rows, "merged").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def _over(key: list[str]):
    """New rows take the place of old ones with their ``key``."""
    def merge(new: DataFrame, old: DataFrame) -> DataFrame:
        return new.unionByName(old.join(new.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)

    return merge


def write_items(items: DataFrame, path: str) -> None:
    """Items as Parquet by year, written over those of the same id, which keep status and enrichment.

    Other items of a year stay; a re-run changes nothing.
    """
    rows = items
    if "status" in items.columns and "enrichment" in items.columns:
        start = {"status": F.lit("raw"), "enrichment": F.array().cast("array<string>")}
        rows, merge = items.withColumns(start), lambda new, old: upsert(new.select(old.columns), old)
    else:
        merge = _over(["id"])
    _replace(rows.withColumn("year", F.substring("id", 1, 4)), path, "year", merge)


def item_notes(items: DataFrame) -> DataFrame:
    """(path, value): items as notes with front matter; columns that are missing are left out, status starts raw."""
    none = F.array().cast("array<string>")
    has = lambda c: c in items.columns
    fields = [(k, "scalar", F.col(k)) for k in ("id", "source", "channel", "shared_by", "date")]
    fields += [("urls", "block", F.col("urls")), ("kinds", "inline", F.col("kinds"))]
    fields += [("attachments", "block", F.col("attachments"))] if has("attachments") else []
    fields += [("reactions", "scalar", F.nullif("reactions", F.lit(0)))] if has("reactions") else []
    fields += [
        ("status", "scalar", F.coalesce("status", F.lit("raw")) if has("status") else F.lit("raw")),
        ("enrichment", "inline", F.coalesce("enrichment", none) if has("enrichment") else none),
    ]
    value = text.front_matter_text(fields, F.coalesce("body", F.lit("")))
    return items.select(F.concat(F.substring("id", 1, 4), F.lit("/"), "id", F.lit(".md")).alias("path"), value.alias("value"))


def digest_notes(digests: DataFrame) -> DataFrame:
    """(path, value): digests (id, date, signal, topics, entities, media, facts) as notes, facts as bullets."""
    fields = [(k, "scalar", F.col(k)) for k in ("id", "date", "signal")]
    fields += [(k, "inline", F.coalesce(k, F.array().cast("array<string>"))) for k in ("topics", "entities")]
    fields += [("media", "inline", F.when(F.size("media") > 0, F.col("media")))]
    facts = F.array_join(F.transform("facts", lambda f: F.concat(F.lit("- "), f)), "\n")
    return digests.select(F.concat("id", F.lit(".md")).alias("path"), text.front_matter_text(fields, F.coalesce(facts, F.lit(""))).alias("value"))


def _tidy(meta: Column) -> Column:
    return F.map_filter(meta, lambda k, v: v.isNotNull() & (v != "") & ~k.startswith("_"))


def write_enrichment(rows: DataFrame, path: str) -> None:
    """Fetched bodies by the item's year, each written over what was there under its (item_id, file).

    Empty and private fields of meta are dropped, bodies are trimmed.  Of
    several rows of one (item_id, file) one is kept, by its values.
    """
    tidy = rows.withColumn("meta", F.map_entries(_tidy(F.col("meta")))).withColumn("body", F.concat(text.strip(F.col("body")), F.lit("\n")))
    rest = [c for c in tidy.columns if c not in ("item_id", "file")]
    one = tidy.groupBy("item_id", "file").agg(F.max(F.struct(*rest)).alias("r")).select("item_id", "file", "r.*")
    one = one.withColumn("meta", F.map_from_entries("meta")).withColumn("year", F.substring("item_id", 1, 4))
    _replace(one, path, "year", _over(["item_id", "file"]))


def append_ledger(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").option("ignoreNullFields", True).json(path)


def changed(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` that ``old`` does not hold just so."""
    columns = sorted(new.columns)
    same = old.select(key, F.xxhash64(F.struct(*columns)).alias("h"))
    return new.withColumn("h", F.xxhash64(F.struct(*columns))).join(same, [key, "h"], "left_anti").drop("h")


def write_changed(new: DataFrame, key: str, path: str) -> int:
    """Write the rows of ``new`` that differ from the table's over those of their ``key``; their number.

    Nothing is touched if nothing differs.
    """
    spark, part = new.sparkSession, F.pmod(F.xxhash64(key), F.lit(PARTS))
    fresh = new
    if exists(spark, path):
        fresh = changed(new, spark.read.parquet(path).drop("part"), key)
    fresh = materialize(fresh.withColumn("part", part), "changed")
    n = fresh.count()
    if n:
        _replace(fresh, path, "part", _over([key]))
    return n


def write_report(findings: DataFrame, path: str, lists: DataFrame | None = None) -> None:
    """A summary (finding, n) as one text file, each finding with the first rows of its list.

    ``lists`` as from ``integrity.report_lists``, which bounds them.
    """
    lines = findings.select("finding", F.lit(0).alias("place"), F.concat("finding", F.lit(": "), F.col("n").cast("string")).alias("value"))
    if lists is not None:
        entry = F.concat(F.lit("   "), F.concat_ws(" -> ", "subject", "detail"))
        lines = lines.unionByName(lists.select("finding", "place", entry.alias("value")))
    lines.orderBy("finding", "place").select("value").coalesce(1).write.mode("overwrite").text(path)
