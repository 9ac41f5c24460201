"""Problem 1: conversations of the messages table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import conversations
from siltstone.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = conversations.reply_conversations(table(spark, d, "messages"))
    return rows.select(F.col("root").alias("root_id"), "turn", "id")


def p1_roles(spark: SparkSession, d: str) -> DataFrame:
    rows = conversations.reply_conversations(table(spark, d, "messages"))
    return rows.groupBy("channel", "role").agg(
        F.count(F.lit(1)).alias("messages"), F.countDistinct("root").alias("conversations")
    )


def p1_gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    return conversations.gap_sessions(table(spark, d, "messages"))


def p1_gap_agreement(spark: SparkSession, d: str) -> DataFrame:
    return conversations.session_agreement(table(spark, d, "messages"))


# the table's removal notices, spelled out; a mark of edits (an asterisk) may stand beside them
_CHAINS = r"""
WITH RECURSIVE copies AS (
  SELECT channel, id, type, ingested_at, nullif(trim(author.id), '') AS author,
    try_cast(CASE WHEN regexp_matches(trim("timestamp"), '(Z|[+-]\d\d:?\d\d)$') THEN trim("timestamp")
      ELSE trim("timestamp") || 'Z' END AS TIMESTAMPTZ) AS moment,
    nullif(regexp_extract(coalesce(reference.messageId, ''), '(\d+)\s*$', 1), '') AS parent,
    coalesce(len(attachments), 0) > 0 OR coalesce(regexp_replace(content, '[\s\x{00A0}\x{200B}\x{2060}\x{FEFF}]+', '', 'g') <> ''
      AND trim(content, ' *') NOT IN ('— removed —', '⟨message deleted⟩', '[removed by moderator]', '~~deleted~~',
        'This message was deleted by its author.', '[message deleted by author]', 'Nachricht gelöscht',
        '(message removed)', '[deleted]', '(this post has been taken down)', '<deleted>', 'Message withdrawn'), false) AS filled
  FROM messages WHERE type IN ('Default', 'Reply')
), msg AS (
  SELECT * FROM copies QUALIFY row_number() OVER (PARTITION BY channel, id ORDER BY ingested_at DESC) = 1
), chain AS (
  SELECT channel, id, id AS root, author, moment, filled, true AS opens, false AS early
  FROM msg WHERE type = 'Default' AND parent IS NULL
  UNION ALL
  SELECT m.channel, m.id, c.root, m.author, m.moment, m.filled, false, coalesce(m.moment < c.moment, false)
  FROM chain c JOIN msg m ON m.channel = c.channel AND m.parent = c.id
), kept AS (
  SELECT channel, root, max(CASE WHEN opens THEN author END) AS opener FROM chain GROUP BY 1, 2
  HAVING bool_and(author IS NOT NULL AND moment IS NOT NULL AND NOT early) AND bool_or(opens AND filled)
    AND count(DISTINCT CASE WHEN filled THEN author END) > 1
), turns AS (
  SELECT c.channel, c.root, c.id, c.author = k.opener AS opened,
    row_number() OVER (PARTITION BY c.channel, c.root ORDER BY c.moment, c.id::HUGEINT) AS turn
  FROM chain c JOIN kept k ON c.channel = k.channel AND c.root = k.root WHERE c.filled
)
"""

_SESSIONS = _CHAINS + """, timed AS (
  SELECT channel, id, author, filled, epoch_us(moment) AS "at",
    epoch_us(moment) - lag(epoch_us(moment)) OVER w AS gap, row_number() OVER w AS pos
  FROM msg WHERE author IS NOT NULL AND moment IS NOT NULL WINDOW w AS (PARTITION BY channel ORDER BY epoch_us(moment), id)
), histogram AS (
  SELECT channel, length(bin(gap)) AS bits, count(*)::DOUBLE AS n FROM timed WHERE gap IS NOT NULL GROUP BY 1, 2
), sums AS (
  SELECT channel, bits, sum(n) OVER w AS w, sum(n * bits) OVER w AS m, sum(n) OVER (PARTITION BY channel) AS all_w, sum(n * bits) OVER (PARTITION BY channel) AS all_m
  FROM histogram WINDOW w AS (PARTITION BY channel ORDER BY bits)
), gaps AS (
  SELECT channel, bits FROM sums WHERE w < all_w
  QUALIFY row_number() OVER (PARTITION BY channel ORDER BY (all_m * w - all_w * m) * (all_m * w - all_w * m) / (w * (all_w - w)) DESC, bits) = 1
), begun AS (
  SELECT t.*, gap IS NULL OR coalesce(length(bin(gap)) > bits, false) AS opens FROM timed t LEFT JOIN gaps g ON t.channel = g.channel
), placed AS (
  SELECT *, max(CASE WHEN opens THEN pos END) OVER (PARTITION BY channel ORDER BY pos) AS session FROM begun
), worth AS (
  SELECT channel, session, max(CASE WHEN opens THEN author END) AS opener FROM placed GROUP BY 1, 2
  HAVING bool_or(opens AND filled) AND count(DISTINCT CASE WHEN filled THEN author END) > 1
), sessions AS (
  SELECT p.channel, p.session, row_number() OVER (PARTITION BY p.channel, p.session ORDER BY "at", id::HUGEINT, id)::INT AS turn, id,
    CASE WHEN author = opener THEN 'opener' ELSE 'replier' END AS role, author, "at"
  FROM placed p JOIN worth w ON p.channel = w.channel AND p.session = w.session WHERE filled
)
"""

QUERIES = {"p1_found": p1_found, "p1_roles": p1_roles, "p1_gap_sessions": p1_gap_sessions, "p1_gap_agreement": p1_gap_agreement}
ORACLES = {
    "p1_found": _CHAINS + "SELECT root AS root_id, turn::INT AS turn, id FROM turns",
    "p1_roles": _CHAINS
    + "SELECT channel, CASE WHEN opened THEN 'opener' ELSE 'replier' END AS role, count(*) AS messages,"
    " count(DISTINCT root) AS conversations FROM turns GROUP BY 1, 2",
    "p1_gap_sessions": _SESSIONS + "SELECT * FROM sessions",
    "p1_gap_agreement": _SESSIONS
    + "SELECT t.channel, count(*) AS replies, count(*) FILTER (WHERE s.session = o.session) AS together FROM turns t"
    " LEFT JOIN sessions s ON t.channel = s.channel AND t.id = s.id LEFT JOIN sessions o ON t.channel = o.channel AND t.root = o.id"
    " WHERE t.id <> t.root GROUP BY 1",
}
