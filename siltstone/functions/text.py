"""Text, id and front-matter functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.urls import LINK, canonical

#: White space as Unicode has it.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# How pages cite items and link to each other.
CITATION = r"`(\d{4}-\d{2}-\d{2}-[a-z0-9-]+-[0-9a-f]{6})`"
WIKILINK = r"\[\[([a-z0-9-]+)\]\]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def slugify(text: Column, length: int = 40) -> Column:
    """Lower-case words joined by hyphens, at most ``length`` characters; untitled if none are left."""
    words = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(words, 1, length), "-+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("untitled"))


def without_links(text: Column) -> Column:
    return F.regexp_replace(text, LINK, "")


def substance(text: Column) -> Column:
    """Number of characters that are left without links and repeated white space."""
    return F.length(strip(F.regexp_replace(without_links(text), f"{SPACE}+", " ")))


def short_id(*parts: Column) -> Column:
    """Six hexadecimal digits of the SHA-1 of the parts joined by slashes."""
    return F.left(F.sha1(F.concat_ws("/", *parts)), F.lit(6))


def capture_id(url: Column, file: Column) -> Column:
    """Short id of a captured link, or of the capture's file where it has no link."""
    return short_id(F.lit("manual"), F.coalesce(canonical(url), file))


def media_id(name: Column) -> Column:
    return short_id(F.lit("media"), name)


def item_id(date: Column, slug: Column, short: Column) -> Column:
    return F.concat_ws("-", date, slug, short)


def display_name(author: Column) -> Column:
    """Nickname, or the account's name where there is none."""
    return F.coalesce(F.nullif(author["nickname"], F.lit("")), author["name"])


def citations(text: Column) -> Column:
    """Distinct item ids in backticks."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)))


def wikilinks(text: Column) -> Column:
    """Distinct names in double brackets."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(1)))


def field(text: Column, name: str, pattern: str = ".+") -> Column:
    """First value of a ``name: value`` line; null if there is none."""
    return F.nullif(F.regexp_extract(text, rf"(?dm)^{name}: ({pattern})", 1), F.lit(""))


def front_matter(text: Column) -> Column:
    """Struct (fields, body) of a note; no fields if the block is missing or not closed.

    A byte-order mark is dropped and line ends become \\n; empty lines between
    block and body belong to neither.  Lines are split at the first colon; of
    repeated names the last counts.
    """
    t = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    shape = r"(?s)^---[^\n]*\n(.*?\n)??---(?:\n(.*))?$"
    has = t.rlike(shape) & t.startswith("---")
    lines = F.filter(F.split(F.regexp_extract(t, shape, 1), "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(
        lines,
        lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), strip(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("value")),
    )
    # the last pair of a name: no later one has the name
    last = F.filter(
        pairs,
        lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]),
    )
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.struct(
        F.when(has, F.map_from_entries(last)).otherwise(empty).alias("fields"),
        F.when(has, F.regexp_replace(F.regexp_extract(t, shape, 2), "^\n+", "")).otherwise(t).alias("body"),
    )


def front_matter_text(fields: list[tuple[str, str, Column]], body: Column) -> Column:
    """A note: ``fields`` (name, style, value) in order, then the body without white space at its end.

    Styles: ``scalar`` (left out if null), ``block`` (a list, one entry a
    line; left out if null or empty), ``inline`` (a list in brackets).
    """
    def line(name: str, style: str, value: Column) -> Column:
        if style == "block":
            return F.when(F.size(value) > 0, F.concat(F.lit(f"{name}:\n  - "), F.array_join(value, "\n  - ")))
        if style == "inline":
            return F.concat(F.lit(f"{name}: ["), F.array_join(value, ", "), F.lit("]"))
        return F.concat(F.lit(f"{name}: "), value.cast("string"))

    head = F.concat_ws("\n", F.lit("---"), *[line(*f) for f in fields], F.lit("---"))
    return F.concat(head, F.lit("\n\n"), F.regexp_replace(body, rf"{SPACE}+$", ""), F.lit("\n"))


def inline_list(value: Column) -> Column:
    """Entries of a list in brackets; null if it is none."""
    entries = F.split(F.regexp_extract(value, r"^\[(.*)\]$", 1), ",")
    return F.when(value.rlike(r"^\[.*\]$"), F.filter(F.transform(entries, strip), lambda x: x != ""))


def rewritten_capture(fields: Column, body: Column, media: Column) -> Column:
    """A capture whose asset was stored: media first, asset and name dropped, other fields in order.

    A body of nothing but white space is left out; line ends after a body become one.
    """
    kept = F.map_filter(fields, lambda k, v: ~k.isin("asset", "name"))
    rest = F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    lines = F.concat(F.array(F.concat(F.lit("media: "), media)), rest)
    note = F.when(strip(body) != "", F.concat(F.lit("\n"), F.regexp_replace(body, "\n+$", ""), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), note)


#: Lines of a caption file that are not spoken.
UNSPOKEN = r"^(WEBVTT|Kind:|Language:|NOTE|align:)"


def caption_text(vtt: Column) -> Column:
    """Spoken lines of a caption file, without headers, cue times, tags and repeats in a row."""
    lines = F.transform(F.split(vtt, "\r\n|\r|\n"), lambda x: strip(F.regexp_replace(x, "<[^>]+>", "")))
    spoken = F.filter(
        lines,
        lambda x: ~((x == "") | F.contains(x, F.lit("-->")) | x.rlike(UNSPOKEN) | x.rlike(r"^\d+$")),
    )
    return F.array_join(F.filter(spoken, lambda x, i: (i == 0) | (x != F.get(spoken, i - 1))), "\n")


def log_entry(line: Column) -> Column:
    """Struct (date, op, title) of a line of the operations log; nulls if it is none."""
    shape = r"^## \[(\d{4}-\d{2}-\d{2})\] (\S+) \| (.*)$"
    part = lambda i: F.nullif(F.regexp_extract(line, shape, i), F.lit(""))
    return F.struct(part(1).alias("date"), part(2).alias("op"), part(3).alias("title"))
