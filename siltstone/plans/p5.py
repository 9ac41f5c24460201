"""Problem 5: orphan references of wiki pages and taxonomy snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.operators import orphans
from siltstone.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    refs = orphans.references(table(spark, d, "wiki"), "wiki", "name", "generated", "id").unionByName(
        orphans.references(table(spark, d, "taxonomy"), "taxonomy", "name", "updated", "items")
    )
    return orphans.orphan_references(
        refs, table(spark, d, "corpus"), "id", "ingested_at", table(spark, d, "exclusions"), "id", "excluded_on"
    )


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p5_found(spark, d))


_FOUND = r"""
WITH raw AS (
  SELECT 'wiki' AS ref_table, name AS ref_key, generated AS ref_date, unnest(id) AS x FROM wiki
  UNION ALL
  SELECT 'taxonomy', name, updated, unnest(items) FROM taxonomy
), refs AS (
  SELECT DISTINCT ref_table, ref_key, ref_date,
    regexp_replace(regexp_replace(trim(x, ' `"''' || chr(9) || chr(10) || chr(13)), '^.*/', ''), '\.md$', '') AS item_id
  FROM raw WHERE ref_key IS NOT NULL AND ref_date IS NOT NULL AND x IS NOT NULL
), first AS (
  SELECT id, strftime(min(ingested_at), '%Y-%m-%d') AS since FROM corpus GROUP BY id
), gone AS (
  SELECT id, min(excluded_on) AS until FROM exclusions WHERE excluded_on IS NOT NULL GROUP BY id
), found AS (
  SELECT ref_table, ref_key, ref_date, item_id
  FROM refs LEFT JOIN first ON item_id = first.id LEFT JOIN gone ON item_id = gone.id
  WHERE item_id <> '' AND (since IS NULL OR since > ref_date OR coalesce(until <= ref_date, false))
)
"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
ORACLES = {
    "p5_found": _FOUND + "SELECT * FROM found",
    "p5_report": _FOUND
    + "SELECT ref_table, substr(ref_date, 1, 7) AS month, count(*) AS orphans, count(DISTINCT item_id) AS items"
    " FROM found GROUP BY 1, 2",
}
