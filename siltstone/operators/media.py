"""Captured files and what becomes of them, and the least a fetched text must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text, urls

#: Bytes of sound that can be transcribed, and characters a text must have.
MOST_SOUND = 24_000_000
LEAST_CAPTIONS, MORE_THAN_ARTICLE, MORE_THAN_PAPER = 200, 300, 2000
#: Characters kept of long texts and errors.
CAPS = {"gist": 20_000, "blob": 40_000, "readme": 60_000, "error": 150}


def asset_outcomes(captures: DataFrame, assets: DataFrame, stored: DataFrame) -> DataFrame:
    """(file, media, outcome) of captures (file, asset, name) that point to an asset.

    ``assets``: url, status (of its lookup), name, size.  ``stored``: media,
    size of the files that are there.  Outcomes: malformed, nameless, gone,
    unreachable, present (only the pointer is to be rewritten), download.
    """
    known = assets.select(F.col("url").alias("asset"), F.col("status").alias("code"), F.col("name").alias("asset_name"), F.col("size").alias("asset_size"))
    held = stored.select("media", F.col("size").alias("held"))
    name = F.coalesce(F.nullif("name", F.lit("")), F.when(F.col("code") == 200, F.nullif("asset_name", F.lit(""))))
    rows = captures.where("asset IS NOT NULL").join(known, "asset", "left").withColumn("name", name)
    rows = rows.withColumn("media", F.concat(F.lit("media/"), text.media_id(F.col("name")), F.lit("/"), F.col("name")))
    rows = rows.join(held, "media", "left")
    here = F.col("held").isNotNull()
    outcome = (
        F.when(~F.col("asset").rlike(urls.ASSET), "malformed").when(F.col("name").isNull(), "nameless")
        .when((F.col("code") == 404) & here, "present").when(F.col("code") == 404, "gone")
        .when(F.col("code").isNull() | (F.col("code") != 200), "unreachable")
        .when(here & (F.col("held") == F.col("asset_size")), "present").otherwise("download")
    )
    return rows.select("file", "media", outcome.alias("outcome"))


def stray_assets(assets: DataFrame, captures: DataFrame) -> DataFrame:
    """Assets (id, name, size, url) that no capture points to."""
    used = captures.select(urls.asset_id(F.col("asset")).alias("id")).where("id IS NOT NULL").distinct()
    return assets.join(used, "id", "left_anti")


def inbox_counts(captures: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: captures with assets, those that failed, and those that are text alone."""
    staged = captures.agg(F.count("asset").alias("staged"), F.count_if(F.col("asset").isNull()).alias("untouched"))
    failed = outcomes.agg(F.count_if(~F.col("outcome").isin("present", "download")).alias("failed"))
    return staged.crossJoin(failed)


def sound_state(size: Column) -> Column:
    """What becomes of a video without captions by the size of its sound; null if it can be transcribed."""
    return F.when(size.isNull(), "error").when(size > MOST_SOUND, "toolong")


def long_enough(kind: Column, body: Column) -> Column:
    """Whether a fetched text holds enough of its kind."""
    n = F.length(body)
    return (
        F.when(kind == "youtube", n >= LEAST_CAPTIONS).when(kind == "blog", n > MORE_THAN_ARTICLE)
        .when(kind == "paper", n > MORE_THAN_PAPER).otherwise(n > 0)
    )


def first_answer(*bodies: Column) -> Column:
    """The first of several sources whose text is long enough for an article."""
    return F.coalesce(*[F.when(F.length(b) > MORE_THAN_ARTICLE, b) for b in bodies])


def capped(body: Column, what: str) -> Column:
    return F.substring(body, 1, CAPS[what])


def unreferenced_files(messages: DataFrame, items: DataFrame) -> DataFrame:
    """(file): stored attachments of messages that no item lists."""
    each = messages.select("channel", F.explode("attachments.url").alias("u")).where("u IS NOT NULL AND NOT startswith(u, 'http')")
    files = each.select(F.concat(F.lit("raw/discord/"), "channel", F.lit("/"), "u").alias("file")).distinct()
    return files.join(items.select(F.explode("attachments").alias("file")).distinct(), "file", "left_anti")
