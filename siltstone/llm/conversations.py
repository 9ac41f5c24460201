"""Conversations from message rows.

Two ways to say which rows belong together share everything else (order by
instant, roles, turn numbers, dropping of broken, empty and unanswered
sessions):

* ``reply_conversations``: the chain of references decides;
* ``gap_sessions``: per channel, a silence longer than a calibrated gap does.

``session_agreement`` tells how many replies the second puts with what they answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.chains import follow_pointers
from siltstone.operators.ranking import carry_last, distributed_row_number
from siltstone.operators.skew import lookup_join
from siltstone.session import materialize

#: White space and characters that show nothing.
BLANK = r"[\s\p{Z}\p{Cc}\p{Cf}⠀ㅤᅟᅠﾠ︎️]+"
#: What a removal notice is made of, in lower case.
REMOVED = (
    r"^(?:this |the |original |diese |este |ce )?(?:message|post|comment|content|nachricht|beitrag|mensaje|publicaci[oó]n)?"
    r" ?(?:was |has been |is |wurde |fue |ha sido |a été )?(?:deleted|removed|withdrawn|taken down|gelöscht|entfernt|supprimée?|eliminad[oa]|borrad[oa])"
    r"(?: by (?:its |the |a )?(?:author|user|moderators?|admin|owner|sender))?$"
)


def has_content(content, attachments):
    """An attachment, or text that is more than blanks or a removal notice."""
    words = F.trim(F.regexp_replace(F.lower(content), r"[^\p{L}\p{N}]+", " "))
    shown = F.regexp_replace(content, BLANK, "") != ""
    return (F.coalesce(F.size(attachments), F.lit(0)) > 0) | F.coalesce(shown & ~words.rlike(REMOVED), F.lit(False))


def instant(ts):
    """Microseconds of a written time; UTC where no offset is given; null if it can't be read."""
    t = F.trim(ts)
    dated = t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
    zoned = F.when(t.rlike(r"(?i)(z|utc|[+-]\d{2}(:?\d{2})?)$"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.when(dated, F.unix_micros(F.try_to_timestamp(zoned)))


def parent_id(message_id):
    """The id a reference means: plain, with blanks, or at the end of a link; null if blank."""
    t = F.regexp_replace(message_id, BLANK, "")
    return F.nullif(F.regexp_extract(t, r"([^/#?=]*)/?$", 1), F.lit(""))


def message_table(messages: DataFrame) -> DataFrame:
    """One narrow row per message: the copy with the latest ``ingested_at``.

    Only types Default and Reply count.  Rows with a null channel or id can
    be neither found nor referred to and are left out.  Copies that tie in
    time are told apart by their values, so the choice is always the same.
    """
    row = messages.where(F.col("type").isin("Default", "Reply") & F.col("id").isNotNull() & F.col("channel").isNotNull())
    narrow = row.select(
        "channel",
        "id",
        F.struct(
            F.col("ingested_at"),
            (F.col("type") == "Default").alias("plain"),
            F.nullif(F.trim("author.id"), F.lit("")).alias("author"),
            instant(F.col("timestamp")).alias("at"),
            parent_id(F.col("reference.messageId")).alias("parent"),
            has_content(F.col("content"), F.col("attachments")).alias("filled"),
        ).alias("m"),
    )
    return (
        narrow.groupBy("channel", "id")
        .agg(F.max("m").alias("m"))
        .select("channel", "id", "m.author", "m.at", "m.parent", "m.filled",
                (F.col("m.plain") & F.col("m.parent").isNull()).alias("opens"))
    )


def with_roots(messages: DataFrame) -> DataFrame:
    """Messages whose chain of references ends at an opening message, with ``root``.

    ``early`` tells that a message is older than the one it refers to.
    """
    facts = ["author", "at", "filled"]
    openers = messages.where("opens").select(
        "channel", "id", *facts, F.col("id").alias("root"), F.lit(False).alias("early"), F.lit(True).alias("opens")
    )
    target = messages.select(
        "channel",
        F.col("id").alias("parent"),
        F.col("at").alias("p_at"),
        F.col("opens").alias("p_opens"),
        F.col("parent").alias("p_parent"),
    )
    replies = messages.where("parent IS NOT NULL").select("channel", "id", "parent", *facts)
    step = (
        lookup_join(replies, target, ["channel", "parent"], "inner")
        .where("p_opens OR p_parent IS NOT NULL")
        .select(
            "channel", "id", *facts, F.coalesce(F.col("at") < F.col("p_at"), F.lit(False)).alias("early"),
            F.when(F.col("p_opens"), F.col("parent")).alias("root"), F.col("parent").alias("ptr"),
        )
    )
    found = follow_pointers(step, ["channel"]).drop("ptr").withColumn("opens", F.lit(False))
    return openers.unionByName(found)


def _assemble(rows: DataFrame, key: list[str], drop_broken: bool) -> DataFrame:
    """Turns and roles of the sessions ``key`` that are worth keeping.

    ``rows``: key columns, id, author, at, filled, opens, early.  A session is
    dropped if a row is broken (no account, no time, older than what it
    answers; with ``drop_broken``), if its opening message is empty, or if
    nobody but the opener has written content.
    """
    broken = F.col("author").isNull() | F.col("at").isNull() | F.col("early")
    facts = rows.groupBy(*key).agg(
        F.max(broken).alias("broken"),
        F.max(F.col("opens") & F.col("filled")).alias("said"),
        F.max(F.when(F.col("opens"), F.col("author"))).alias("opener"),
        F.min(F.when(F.col("filled"), F.col("author"))).alias("lo"),
        F.max(F.when(F.col("filled"), F.col("author"))).alias("hi"),
    )
    answered = (F.col("lo") != F.col("opener")) | (F.col("hi") != F.col("opener"))
    kept = facts.where(F.col("said") & answered)
    kept = (kept.where("NOT broken") if drop_broken else kept).select(*key, "opener")
    turns = materialize(
        lookup_join(rows.where("filled"), kept, key, "inner")
        .withColumn("number", F.col("id").try_cast("decimal(38,0)"))
        .withColumn("role", F.when(F.col("author") == F.col("opener"), "opener").otherwise("replier"))
        .drop("opener", "early", "filled", "opens"),
        "turns",
    )
    return distributed_row_number(turns, key, ["at", "number", "id"], "turn").withColumn("turn", F.col("turn").cast("int"))


def reply_conversations(messages: DataFrame) -> DataFrame:
    """Ordered conversations: channel, root, turn, id, role, author, at.

    A conversation is an opening message (a Default without a reference) and
    all messages of its channel that refer to it directly or through others.
    It is dropped if a message of it has no account id or readable time or is
    older than the one it refers to, if the opening message has no content,
    or if only the opener wrote content.  Messages without content (see
    ``has_content``) keep the chain but get no turn.  Copies of a message
    count once, by the latest ``ingested_at``; an empty table gives no rows.
    """
    rows = with_roots(materialize(message_table(messages), "messages"))
    return _assemble(rows, ["channel", "root"], True).select("channel", "root", "turn", "id", "role", "author", "at")


def calibrated_gaps(gaps: DataFrame) -> DataFrame:
    """(channel, bits): the silences between messages (channel, gap in microseconds) that end a session.

    Silences within a talk and between talks differ by orders of magnitude:
    per channel, the histogram of their lengths in powers of two is cut where
    the two sides differ most from each other (the most variance lies between
    them), so that channels of slow and of fast talk get gaps of their own.  A
    silence of more than ``bits`` binary digits ends a session; a channel whose
    silences are all alike has no row and is one session.
    """
    histogram = gaps.where("gap IS NOT NULL").groupBy("channel", F.length(F.bin("gap")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    # at most 64 rows a channel
    upto = Window.partitionBy("channel").orderBy("bits")
    every = Window.partitionBy("channel")
    number, lengths = F.col("n").cast("double"), (F.col("n") * F.col("bits")).cast("double")
    sums = histogram.select(
        "channel", "bits", F.sum(number).over(upto).alias("w"), F.sum(lengths).over(upto).alias("m"),
        F.sum(number).over(every).alias("all_w"), F.sum(lengths).over(every).alias("all_m"),
    ).where("w < all_w")
    apart = F.col("all_m") * F.col("w") - F.col("all_w") * F.col("m")
    return sums.withColumn("apart", apart * apart / (F.col("w") * (F.col("all_w") - F.col("w")))).groupBy("channel").agg(
        F.max_by("bits", F.struct("apart", -F.col("bits"))).alias("bits")
    )


def gap_sessions(messages: DataFrame) -> DataFrame:
    """Sessions by silence: channel, session, turn, id, role, author, at.

    Messages are sorted by instant per channel and split at silences of the
    channel's calibrated length.  Rows without account or readable time belong
    to no session.  The first message of a session opens it; sessions whose
    opening message is empty or without content from another account are
    dropped.
    """
    rows = materialize(message_table(messages).where("author IS NOT NULL AND at IS NOT NULL").drop("parent", "opens"), "messages")
    rows = distributed_row_number(rows, ["channel"], ["at", "id"], "pos")
    gaps = carry_last(rows, ["channel"], "pos", F.col("at"), "prior", before=True).withColumn("gap", F.col("at") - F.col("prior"))
    gaps = materialize(gaps, "gaps")
    limit = calibrated_gaps(gaps)
    begins = F.col("gap").isNull() | F.coalesce(F.length(F.bin("gap")) > F.col("bits"), F.lit(False))
    starts = materialize(gaps.join(limit, "channel", "left").withColumn("start", F.when(begins, F.col("pos"))), "starts")
    sessions = carry_last(starts, ["channel"], "pos", F.col("start"), "session").select(
        "channel", "session", "id", "author", "at", "filled", F.col("start").isNotNull().alias("opens"), F.lit(False).alias("early")
    )
    return _assemble(materialize(sessions, "sessions"), ["channel", "session"], False).select(
        "channel", "session", "turn", "id", "role", "author", "at"
    )


def session_agreement(messages: DataFrame) -> DataFrame:
    """Per channel: replies in kept conversations, and those that ``gap_sessions`` has in one session with their opening message."""
    chains = materialize(reply_conversations(messages).select("channel", "root", "id"), "chains")
    sessions = materialize(gap_sessions(messages).select("channel", "session", "id"), "sessions")
    replies = chains.where("id <> root").join(sessions, ["channel", "id"], "left")
    opening = sessions.select("channel", F.col("id").alias("root"), F.col("session").alias("opened"))
    both = lookup_join(materialize(replies, "replies"), opening, ["channel", "root"], "left")
    return both.groupBy("channel").agg(
        F.count(F.lit(1)).alias("replies"), F.count_if(F.coalesce(F.col("session") == F.col("opened"), F.lit(False))).alias("together")
    )
