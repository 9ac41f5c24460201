"""Texts cut off by field limits or in transfer.

``cut_at_limits``: per source the lengths of all texts, in characters and in
bytes, form histograms; a length that is far more frequent than its neighbours
is a limit.  Texts at a limit that do not end like a text are cut.

``cut_in_transfer``: texts cut in transfer have any length, so that no
histogram shows them; they are told by how they end: inside a word, or without
the full stop that the rest of the text uses.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize, spread, task_udf

#: A limit holds so many times the mean of its neighbours, and at least so many texts: fewer of one length are chance.
SPIKE_TEXTS, SPIKE_TIMES, NEIGHBOURS = 4, 5.0, 25
#: Shorter limits than this are no limits of texts.
SHORTEST = 60
#: Cutting between words, or for an appended mark, ends a text up to this far below its limit.
SLACK = 20
#: A word that ends a sentence or line more rarely than this did not end one here (at a limit: the second).
RARELY, RARELY_AT_LIMIT = 0.002, 0.05

#: A word must have been seen so often for its never ending a sentence to say anything.
KNOWN = 20
#: Rows of a table of words up to which it is sent to all tasks; beyond, words are counted first and joined after.
BROADCAST_ROWS = 200_000
#: Characters at the end of a text that can hold what is appended at a cut.
TAIL = 200

# What is appended where a text is cut.
APPENDED = regex.compile(
    r"(?i)(?:�+|[(\[]\s*(?:more|truncated|cut|continued|cont\.?|…|\.\.\.)\s*[)\]]|(?:…|\.\.\.)\s*[»›>]+"
    r"|(?:…|\.\.\.)?\s*(?:read more|see more|show more|continue reading|weiterlesen|mehr lesen|lire la suite|leer más|seguir leyendo)"
    r"\s*(?:…|\.\.\.|[»›>→]+)?)$"
)
# Lines that close a text without a full stop. Their first words begin sentences as well, so that
# without a colon only a short line is one, and one with "by" only before a name.
CLOSING = regex.compile(
    r"(?i)(?:tags?|filed under|next|previous|posted in|posted by|source|sources|see also|via|related|categor(?:y|ies)|labels?"
    r"|keywords|license|licence|published|author|by|cc|ps|sent from)\s*:.*"
    r"|(?:tags?|filed under|next|previous|posted in|posted by|source|sources|see also|via|related|categor(?:y|ies)|labels?"
    r"|keywords|license|licence|published|author|cc|ps|sent from)(?:\s+[^\s,;:.!?]+){0,4}"
    r"|by\s+(?:the\s+[^\s,;:.!?]+|(?-i:\p{Lu})[^\s,;:!?]*(?:\s+[^\s,;:!?]+){0,3})"
    r"|[—–]\s*\S.*|--\s+\S[^.!?]{0,40}"
)
BULLET = regex.compile(r"\s*(?:[-*•+‣◦]|\d{1,3}[.)])\s+\S")
END = r"[.!?。！？؟।︒]"
STOPPED = regex.compile(rf"{END}[\"'”’»)\]*_]*\s*$")
STOPS = regex.compile(rf"(?:[.!?؟।](?=[\"'”’»)\]*_]*(?:\s|$))|[。！？])")
EMOJI = regex.compile(r"[\p{So}\p{Cf}\uFE0F\u20E3\U0001F1E6-\U0001F1FF\U0001F3FB-\U0001F3FF]$")
LAST_WORD = regex.compile(r"[\p{L}\p{M}\p{N}'’-]+")

ENDING = "struct<state:string,word:string>"


def ending(text: str) -> tuple[str, str | None]:
    """How a text ends, and its last word where that decides.

    ``whole`` or ``cut`` are certain; ``prose`` lacks the full stop it should
    have; ``list``, ``informal``, ``dotted`` and ``name`` depend on the word.
    ``whole`` with a word is a closing line, which is certain only off a limit.
    """
    t = text.rstrip()
    if not t:
        return "whole", None
    if t.endswith("�"):
        return "cut", None
    mark = APPENDED.search(t[-TAIL:])
    if mark and (len(mark.group(0)) < len(t)):
        return "cut", None
    last = t[max(t.rfind("\n"), t.rfind("\r")) + 1:].strip()
    words = LAST_WORD.findall(last.rstrip("….") if last.endswith(("…", "...")) else last)
    word = regex.sub(r"\d", "9", words[-1]) if words else None
    if last.endswith(("…", "...")):
        return "dotted", word
    if STOPPED.search(last[-TAIL:]) or EMOJI.search(t[-1]):
        return "whole", None
    if t.count("```") % 2 or last.replace("```", "").count("`") % 2 or last.count("[[") > last.count("]]"):
        return "cut", None
    if (
        last.endswith(("```", "`", "|", "]"))
        or regex.search(r"(?:https?://|www\.)\S+$", last)
        or regex.search(r"(?:^|\s)[#@][\w-]+$", last)
        or regex.match(r"#{1,6}\s|[=\-*_]{3,}$|<[^>]+>$|(?i:free to copy)$", last)
        or not words
    ):
        return "whole", None
    if CLOSING.fullmatch(last):
        return "whole", word
    number = words[-1].isdigit()
    lines = [x for x in regex.split(r"\r\n|\r|\n", t) if x.strip()]
    bullets = [x for x in lines if BULLET.match(x)]
    if BULLET.match(lines[-1]):
        others = bullets[:-1]
        stopped = sum(bool(STOPPED.search(x)) for x in others)
        if others and 2 * stopped > len(others):
            return "prose", word
        return ("whole", None) if number else ("list", word)
    if not STOPS.search(t):
        first = regex.search(r"\p{L}", t)
        if first is None or first.group(0).islower():
            return ("whole", None) if number else ("informal", word)
    if len(lines) > 1 and len(words) == 1 and last == words[0] and last[0].isupper():
        # under a line of greeting, or on its own
        if len(lines[-2].split()) < 5 and not STOPPED.search(lines[-2]):
            return "whole", None
        if regex.search(r"\n[^\S\n]*\r?\n\s*\S+$", t):
            return "name", word
    return "prose", word


def _endings(text: Column) -> Column:
    @task_udf(ENDING)
    def of(texts: pa.Array) -> pa.Array:
        got = [("whole", None) if t is None else ending(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], ["state", "word"]
        )

    return of(text)


def length_limits(lengths: DataFrame) -> DataFrame:
    """Limits found in ``lengths`` (source, chars, bytes): (source, measure, limit, texts).

    ``lengths`` has one row per source and different text, as copies of one
    text are no sign of a limit.
    """
    both = lengths.select(
        "source",
        F.explode(F.array(
            F.struct(F.lit("chars").alias("measure"), F.col("chars").alias("length")),
            F.struct(F.lit("bytes").alias("measure"), F.col("bytes").alias("length")),
        )).alias("m"),
    ).select("source", "m.measure", "m.length")
    histogram = both.groupBy("source", "measure", "length").agg(F.count(F.lit(1)).alias("texts"))
    around = Window.partitionBy("source", "measure").orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    mean = (F.sum("texts").over(around) - F.col("texts")) / (2 * NEIGHBOURS)
    found = histogram.withColumn("mean", mean).withColumn("most", F.max("texts").over(around))
    return found.where(
        (F.col("length") >= SHORTEST) & (F.col("texts") >= SPIKE_TEXTS) & (F.col("texts") == F.col("most"))
        & (F.col("texts") > SPIKE_TIMES * F.col("mean") + 2)
    ).select("source", "measure", F.col("length").alias("limit"), "texts")


def word_endings(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(word, seen, final): how often a word of ``asked`` (word, different) occurs in ``texts`` (text), and ends a sentence or a line."""
    token = r"""[\p{L}\p{M}\p{N}'’-]+(?:["”»)\]]*[.!?…。！？؟]+(?=[\s"'”’»)\]]|$)|[ \t]*[\r\n])?"""
    tokens = texts.select(F.explode(F.regexp_extract_all(F.regexp_replace("text", r"\d", "9"), F.lit(token), F.lit(0))).alias("token"))
    words = tokens.select(F.rtrim("token", F.lit(" \t\r\n\"”»)].!?…。！？؟")).alias("word"), F.col("token"))
    words = words.select("word", (F.length("word") < F.length("token")).alias("ends"))
    if asked.count() <= BROADCAST_ROWS:
        words = words.join(F.broadcast(asked.select("word")), "word", "left_semi")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("seen"), F.count_if("ends").alias("final"))


def endings(documents: DataFrame) -> DataFrame:
    """(doc_id, source, src, chars, bytes, hash, state, word) of all documents with a text; see ``ending``."""
    rows = spread(documents.select("doc_id", "text", "source")).where("text IS NOT NULL")
    return materialize(
        rows.select(
            "doc_id", "source", F.coalesce("source", F.lit("")).alias("src"), F.length("text").alias("chars"),
            F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("hash"), _endings(F.col("text")).alias("e"),
        ).select("doc_id", "source", "src", "chars", "bytes", "hash", "e.state", "e.word"),
        "endings",
    )


def placed_at_limits(judged: DataFrame) -> DataFrame:
    """Rows of ``endings`` that are open or may be, with ``below``: characters or bytes up to the nearest limit of
    their source, null if they are further than SLACK below each."""
    limits = length_limits(judged.select(F.col("src").alias("source"), "chars", "bytes", "hash").distinct())
    near = limits.select(
        F.col("source").alias("src"), "measure",
        F.explode(F.sequence(F.lit(0), F.lit(SLACK))).alias("below"), "limit",
    ).groupBy("src", "measure", (F.col("limit") - F.col("below")).alias("length")).agg(F.min("below").alias("below"))
    near = materialize(near, "limits")
    open_ends = judged.where("state <> 'whole' OR word IS NOT NULL")
    for measure in ("chars", "bytes"):
        own = near.where(F.col("measure") == measure).select("src", F.col("length").alias(measure), F.col("below").alias(f"{measure}_below"))
        open_ends = open_ends.join(own, ["src", measure], "left")
    return open_ends.withColumn("below", F.least("chars_below", "bytes_below")).drop("chars_below", "bytes_below")


def cut_at_limits(placed: DataFrame) -> DataFrame:
    """Rows of ``placed`` (with ``share`` and ``seen`` of their last word) at a spike of their source's lengths that do
    not end like a text.

    A length of exactly the limit proves more than one just below it, where
    whole texts of the kind are as likely.
    """
    state, exactly, unlikely = F.col("state"), F.col("below") == 0, F.col("share") < RARELY_AT_LIMIT
    cut = (
        state.isin("cut", "prose", "dotted", "name")
        | ((state == "list") & unlikely)
        # who types without full stops may end with any word; at the length of a limit an unknown one is a part of a word
        | ((state == "informal") & unlikely & (exactly | (F.col("seen") >= KNOWN)))
        | ((state == "whole") & unlikely & exactly)
    )
    return placed.where(F.col("below").isNotNull() & F.coalesce(cut, F.lit(False)))


def cut_in_transfer(placed: DataFrame) -> DataFrame:
    """Rows of ``placed`` (with ``share``, ``seen`` and ``last`` of their last word) off all limits that were cut nevertheless."""
    state, unlikely = F.col("state"), F.col("share") < RARELY
    cut = (
        state.isin("cut", "prose")
        | (state.isin("dotted", "list") & unlikely)
        | ((state == "informal") & unlikely & (F.col("seen") >= KNOWN))
        # a name that signs texts is seen at the end of texts only
        | ((state == "name") & (F.col("seen") > 2) & (F.col("last") * 2 < F.col("seen")))
    )
    return placed.where(F.col("below").isNull() & F.coalesce(cut, F.lit(False)))


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, at_limit) of the documents whose text was cut off, at a limit of their source or in transfer.

    ``documents``: doc_id, text, source, in which any value may be null; null
    and blank texts were not cut, equal texts are judged alike (save for
    their source's limits), and an empty table gives no rows.
    """
    placed = materialize(placed_at_limits(endings(documents)), "open")
    asked = placed.where("word IS NOT NULL AND state <> 'prose'").groupBy("word").agg(F.count(F.lit(1)).alias("last"))
    asked = materialize(asked, "asked")
    stats = word_endings(documents.where("text IS NOT NULL").select("text"), asked).join(asked, "word")
    placed = materialize(
        placed.join(stats, "word", "left").withColumn("share", F.coalesce(F.col("final") / F.col("seen"), F.lit(0.0))), "open"
    )
    at, off = cut_at_limits(placed), cut_in_transfer(placed)
    return at.select("doc_id", "source", F.lit(True).alias("at_limit")).unionByName(
        off.select("doc_id", "source", F.lit(False).alias("at_limit"))
    )


def truncation_report(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Per source: documents, cut documents, those cut at a limit and those cut in transfer, and the share cut."""
    cut = found.groupBy("source").agg(F.count_if("at_limit").alias("at_limit"), F.count_if(~F.col("at_limit")).alias("in_transfer"))
    every = documents.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    at, off = F.coalesce("at_limit", F.lit(0)), F.coalesce("in_transfer", F.lit(0))
    return every.join(cut, every["source"].eqNullSafe(cut["source"]), "left").select(
        every["source"], "documents", (at + off).alias("cut"), at.alias("at_limit"), off.alias("in_transfer"),
        ((at + off) / F.col("documents")).alias("share"),
    )
