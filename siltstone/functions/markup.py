"""Fields of fetched responses: pages, feeds, captions and posts."""

from __future__ import annotations

import html.parser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.session import task_udf

#: Parts of a page that hold no article, and parts that stand on lines of their own.
SKIPPED = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "template", "svg", "head"}
BLOCKS = set("p div section article main li ul ol h1 h2 h3 h4 h5 h6 tr table blockquote pre figure figcaption br hr dd dt".split())


def og_image(page: Column) -> Column:
    """Address of the preview picture, with its attributes in either order; null if there is none."""
    name, content = r"""(?:property|name)=["']og:image["']""", r"""content=["']([^"']+)"""
    first = F.regexp_extract(page, rf"<meta[^>]+{name}[^>]+{content}", 1)
    second = F.regexp_extract(page, rf"""<meta[^>]+{content}["'][^>]+{name}""", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def paper_fields(feed: Column) -> Column:
    """Struct (title, abstract, published) of a preprint's feed entry: second title, first summary and date."""
    title = F.get(F.regexp_extract_all(feed, F.lit("(?s)<title>(.*?)</title>"), F.lit(1)), F.lit(1))
    abstract = F.get(F.regexp_extract_all(feed, F.lit("(?s)<summary>(.*?)</summary>"), F.lit(1)), F.lit(0))
    return F.struct(
        F.replace(_squeezed(title), F.lit(":"), F.lit(" -")).alias("title"),
        _squeezed(abstract).alias("abstract"),
        F.nullif(F.regexp_extract(feed, r"<published>(\d{4}-\d{2}-\d{2})", 1), F.lit("")).alias("published"),
    )


def caption_track(subtitles: Column, automatic: Column) -> Column:
    """Address of the English captions: written ones first, languages in order, first vtt track.

    Both are map<string, array<struct<ext, url>>> and may be null.
    """

    def tracks(of: Column) -> Column:
        entries = F.filter(F.map_entries(of), lambda e: e["key"].startswith("en"))
        best = F.transform(
            F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)),
            lambda e: F.get(F.filter(e["value"], lambda t: t["ext"] == "vtt"), F.lit(0)),
        )
        return F.get(F.filter(best, lambda t: t.isNotNull()), F.lit(0))["url"]

    return F.coalesce(tracks(subtitles), tracks(automatic))


def minutes(seconds: Column) -> Column:
    """Whole minutes, halves to the even number."""
    return F.bround(F.coalesce(seconds, F.lit(0)) / F.lit(60.0)).cast("bigint")


def post_text(text: Column, raw_text: Column, quote_name: Column, quote_text: Column) -> Column:
    """A short post's text, with the post it quotes below."""
    own = F.coalesce(F.nullif(text, F.lit("")), raw_text, F.lit(""))
    quote = F.concat(F.lit("\n\n> Quoting @"), quote_name, F.lit(": "), F.coalesce(quote_text, F.lit("")))
    return F.concat(own, F.coalesce(quote, F.lit("")))


class _Article(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.skipping = [""], 0

    def handle_starttag(self, tag, attrs):
        self.skipping += tag in SKIPPED
        if tag in BLOCKS:
            self.lines.append("")

    def handle_endtag(self, tag):
        self.skipping = max(0, self.skipping - (tag in SKIPPED))
        if tag in BLOCKS:
            self.lines.append("")

    def handle_data(self, data):
        if not self.skipping:
            self.lines[-1] += data


def page_text(page: str) -> str:
    """Text of a page, a block a line, without scripts, navigation and markup."""
    parser = _Article()
    parser.feed(page)
    parser.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in parser.lines) if x)


def article_text(page: Column) -> Column:
    """``page_text`` of a column; null stays null."""

    @task_udf("string")
    def of(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else page_text(p) for p in pages.to_pylist()], pa.string())

    return of(page)
