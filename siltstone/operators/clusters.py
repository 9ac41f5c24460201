"""Clusters of messages that make one post, and the items made from them."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text, urls
from siltstone.operators.chains import follow_pointers
from siltstone.operators.ranking import carry_last, distributed_row_number
from siltstone.session import materialize, ship

#: Messages of one author at most this far apart are one post.
GAP_MINUTES = 15
#: An item needs a link, a stored file or this many characters.
SUBSTANCE = 200


def _micros(ts):
    t = F.trim(ts)
    zoned = F.when(t.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.unix_micros(F.try_to_timestamp(zoned))


def last_copies(messages: DataFrame, *columns) -> DataFrame:
    """(channel, id, ``columns``) of the copy of each message that came last; rows without channel or id are left out."""
    facts = F.struct("ingested_at", "pos", "type", *columns)
    rows = messages.where("channel IS NOT NULL AND id IS NOT NULL")
    return rows.groupBy("channel", "id").agg(F.max(facts).alias("k")).select("channel", "id", "k.*")


def posts(messages: DataFrame) -> DataFrame:
    """Messages that can be part of a post, numbered ``n`` per channel in the order of the export.

    Types Default and Reply with text or attachments, as their last copy has
    it: a message whose last copy is blank is none, whatever it was before.
    """
    filled = (F.length("content") > 0) | (F.size("attachments") > 0)
    one = last_copies(
        messages, F.col("author.id").alias("author"), _micros(F.col("timestamp")).alias("at"),
        F.col("reference.messageId").alias("ref"), F.coalesce(filled, F.lit(False)).alias("filled"),
    ).where(F.col("type").isin("Default", "Reply") & F.col("filled"))
    rows = one.select("channel", "id", "pos", "type", "author", "at", "ref")
    return distributed_row_number(materialize(rows, "posts"), ["channel"], ["pos", "id"], "n")


def _follows(author, at, next_author, next_at):
    return F.coalesce((author == next_author) & (next_at - at <= GAP_MINUTES * 60_000_000), F.lit(False))


def by_gap(rows: DataFrame) -> DataFrame:
    """(channel, id, n, cluster) of numbered ``posts`` when no message is a reply.

    A message joins the one before it if both have one author and the gap is
    at most 15 minutes (a negative gap is); ``cluster`` is the number of its
    first message.
    """
    previous = carry_last(rows, ["channel"], "n", F.struct("author", "at"), "prev", before=True)
    starts = ~_follows(F.col("prev.author"), F.col("prev.at"), F.col("author"), F.col("at"))
    marked = carry_last(previous, ["channel"], "n", F.when(F.coalesce(starts, F.lit(True)), F.col("n")), "cluster")
    return marked.select("channel", "id", "n", "cluster")


#: Base messages that are folded in one task; longer segments are folded in parts.
PART = 4096


def _begin(start: int, n: int, sure: bool, seen) -> int:
    """Start of the cluster of message ``n``, if the cluster that was begun last has ``start``."""
    if sure:
        return start
    # the last message before this one that is in the cluster that was begun last
    latest = max((c for c in seen if c["root"] >= start), key=lambda c: c["at_n"], default=None)
    return start if latest is not None and latest["ok"] else n


def _rows(bases: pd.DataFrame) -> list[tuple]:
    bases = bases.sort_values("n")
    return list(zip(bases["n"], bases["joins"], ([] if x is None else x for x in bases["seen"])))


def _outcomes(bases: pd.DataFrame) -> pd.DataFrame:
    """The start that a part of a segment leaves behind, for every start it may be given.

    Only roots that are named before the part tell starts apart: a start up to
    ``bounds[i]`` and over the bound before leaves ``ends[i]``, or itself where that is null.
    """
    todo = _rows(bases)
    first = todo[0][0]
    bounds = sorted({c["root"] for _, sure, seen in todo if not sure for c in seen if c["root"] < first} | {first - 1})
    # starts that lead to the same cluster go on as one
    live = {bound: [bound] for bound in bounds}
    for n, sure, seen in todo:
        after: dict[int, list[int]] = {}
        for start, given in live.items():
            after.setdefault(_begin(start, n, sure, seen), []).extend(given)
        live = after
    ends = {bound: None if start < first else int(start) for start, given in live.items() for bound in given}
    last = [b for b, following in zip(bounds, [*bounds[1:], None]) if following is None or ends[b] != ends[following]]
    facts = bases.iloc[:1][["channel", "segment", "part"]].reset_index(drop=True)
    return facts.assign(bounds=[[int(b) for b in last]], ends=[[ends[b] for b in last]])


def _chain(parts: pd.DataFrame) -> pd.DataFrame:
    """The start that each part of a segment is given; one row per part."""
    parts = parts.sort_values("part")
    start, given = None, []
    for bounds, ends in zip(parts["bounds"], parts["ends"]):
        given.append(start)
        # the first message of a segment begins a cluster whatever it is given
        end = ends[-1] if start is None else ends[bisect.bisect_left(list(bounds), start)]
        start = start if end is None or pd.isna(end) else int(end)
    return parts[["channel", "segment", "part"]].assign(start=pd.array(given, "Int64"))


def _fold(bases: pd.DataFrame) -> pd.DataFrame:
    """Starts of the base messages of a segment or part, when replies decide."""
    given = bases["start"].iloc[0]
    start, ns, out = None if pd.isna(given) else int(given), [], []
    for n, sure, seen in _rows(bases):
        start = n if start is None else _begin(start, n, sure, seen)
        ns.append(n)
        out.append(start)
    return pd.DataFrame({"channel": bases["channel"].iloc[0], "n": ns, "cluster": out})


def by_replies(rows: DataFrame) -> DataFrame:
    """(channel, id, n, cluster) of numbered ``posts``, replies with their parents.

    A reply to an earlier message of its channel joins that message's
    cluster.  Any other message joins the cluster that was begun last, if
    that cluster's last message so far has the same author and the gap is at
    most 15 minutes; else it begins a cluster.

    Whether a message begins a cluster mostly shows from its neighbours, in
    windows over blocks of rows.  Only where replies stand in between and
    disagree does it depend on what happened since the last sure beginning;
    these segments alone are folded in order, in parts of PART base messages.
    What the parts before leave behind is one row per part.
    """
    ship(rows.sparkSession)
    rows = materialize(rows, "posts")
    parents = rows.select("channel", F.col("id").alias("ref"), F.col("n").alias("p_n"))
    linked = rows.where("type = 'Reply'").join(parents, ["channel", "ref"]).where("p_n < n").select("channel", "id", "n", "ref")
    state = rows.join(linked.select("channel", "id", F.col("ref").alias("ptr")), ["channel", "id"], "left").select(
        "channel", "id", "n", F.col("ptr"), F.when(F.col("ptr").isNull(), F.col("n")).alias("root")
    )
    rooted = follow_pointers(state, ["channel"]).select("channel", "id", "root")
    rows = rows.select("channel", "id", "n", "author", "at").join(rooted, ["channel", "id"])
    is_base = F.col("root") == F.col("n")
    rows = carry_last(rows, ["channel"], "n", F.when(is_base, F.col("n")), "slot", before=True)
    rows = materialize(rows, "slots")
    bases = rows.where(is_base).select("channel", "id", "n", "author", "at", "slot")
    # candidates for the last message: the base before, and the replies after it, the latest of each root
    after = rows.where(~is_base).select("channel", "slot", "root", "n", "author", "at")
    itself = bases.select("channel", F.col("n").alias("slot"), F.col("n").alias("root"), "n", "author", "at")
    latest = after.unionByName(itself).groupBy("channel", "slot", "root").agg(F.max(F.struct("n", "author", "at")).alias("c"))
    seen = (
        bases.join(latest, ["channel", "slot"], "left")
        .withColumn("ok", _follows(F.col("c.author"), F.col("c.at"), F.col("author"), F.col("at")))
        .groupBy("channel", "id", "n")
        .agg(
            F.coalesce(F.max("ok"), F.lit(False)).alias("some"), F.coalesce(F.min("ok"), F.lit(False)).alias("joins"),
            F.collect_list(F.when(F.col("root").isNotNull(), F.struct("root", F.col("c.n").alias("at_n"), "ok"))).alias("seen"),
        )
    )
    # bases only, numbered anew, so that segments can be carried forward
    ordered = distributed_row_number(materialize(seen, "seen"), ["channel"], ["n"], "i")
    segments = materialize(
        carry_last(ordered, ["channel"], "i", F.when(~F.col("some"), F.col("n")), "segment"), "segments"
    )
    open_segments = materialize(
        segments.groupBy("channel", "segment").agg(
            F.bool_or(F.expr("some AND NOT joins")).alias("open"), F.min("i").alias("first_i"), F.count(F.lit(1)).alias("bases")
        ).where("open").drop("open"), "open",
    )
    sure = segments.join(open_segments, ["channel", "segment"], "left_anti").select("channel", "n", F.col("segment").alias("cluster"))
    parts = segments.join(open_segments, ["channel", "segment"]).select(
        "channel", "segment", "n", "joins", F.when(F.expr("some AND NOT joins"), F.col("seen")).alias("seen"), "bases",
        F.floor((F.col("i") - F.col("first_i")) / PART).alias("part"),
    )
    by = ["channel", "segment", "part"]
    kinds = "channel string, segment bigint, part bigint"
    outcomes = parts.where(F.col("bases") > PART).groupBy(*by).applyInPandas(_outcomes, f"{kinds}, bounds array<bigint>, ends array<bigint>")
    given = outcomes.groupBy("channel", "segment").applyInPandas(_chain, f"{kinds}, start bigint")
    folded = parts.join(given, by, "left").groupBy(*by).applyInPandas(_fold, "channel string, n bigint, cluster bigint")
    starts = sure.unionByName(folded).withColumnRenamed("n", "root")
    return rows.join(starts, ["channel", "root"]).select("channel", "id", "n", "cluster")


def items(messages: DataFrame, clusters: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """Items made of clusters: id, channel, shared_by, date, urls, kinds, attachments, reactions, body, kept.

    ``kept`` is false for clusters without outside links, stored files and
    enough text.  The date is the first message's, in its own offset.
    """
    outside = lambda u: ~urls.is_internal(u, domains or [])
    copies = last_copies(messages, "timestamp", "content", "author", "attachments", "embeds", "reactions").select(
        "channel", "id", F.struct("timestamp", "content", "author", "attachments", "embeds", "reactions").alias("m"))
    rows = clusters.join(copies, ["channel", "id"])
    lists = rows.groupBy("channel", "cluster").agg(F.array_sort(F.collect_list(F.struct("n", "id", "m"))).alias("ms"))
    first = F.col("ms")[0]
    content = F.array_join(F.transform("ms", lambda x: F.coalesce(x["m"]["content"], F.lit(""))), "\n")
    files = F.flatten(F.transform("ms", lambda x: F.coalesce(x["m"]["attachments"], F.array().cast("array<struct<url:string,fileName:string>>"))))
    embeds = F.flatten(F.transform("ms", lambda x: F.coalesce(x["m"]["embeds"], F.array().cast("array<struct<url:string,title:string>>"))))
    stored = F.transform(F.filter(files, lambda a: ~a["url"].startswith("http")), lambda a: F.concat(F.lit("raw/discord/"), F.col("channel"), F.lit("/"), a["url"]))
    reactions = F.aggregate(
        F.flatten(F.transform("ms", lambda x: F.coalesce(x["m"]["reactions"], F.array().cast("array<struct<count:int>>")))),
        F.lit(0).cast("bigint"), lambda s, r: s + F.coalesce(r["count"], F.lit(0)),
    )
    base = lists.select(
        "channel", "cluster", first["id"].alias("first_id"), F.left(first["m"]["timestamp"], F.lit(10)).alias("date"),
        text.display_name(first["m"]["author"]).alias("shared_by"), content.alias("content"),
        F.array_distinct(F.filter(urls.links_in(content), outside)).alias("urls"), stored.alias("attachments"),
        reactions.alias("reactions"), F.filter(embeds, lambda e: (e["title"] != "") & (e["url"] != "")).alias("embeds"), "ms",
    )
    title = F.get(F.reverse(F.filter("embeds", lambda e: e["url"] == F.get(F.col("urls"), F.lit(0)))), F.lit(0))["title"]
    slug = text.slugify(F.coalesce(title, F.substring(text.without_links(F.col("content")), 1, 80)))
    short = text.short_id(F.col("channel"), F.col("first_id"))
    kinds = F.array_sort(F.array_distinct(F.transform("urls", urls.share_kind)))
    # of several titles of a link the last counts, in the place of the first
    titles = F.transform(
        F.array_distinct(F.transform("embeds", lambda e: e["url"])),
        lambda u: F.concat(F.lit("> unfurl: "), F.element_at(F.filter("embeds", lambda e: e["url"] == u), -1)["title"]),
    )
    unfurls = F.nullif(F.array_join(titles, "\n"), F.lit(""))
    body = F.array_join(F.transform("ms", lambda x, i: _message_lines(x, F.when(i == 0, unfurls))), "\n")
    return base.select(
        text.item_id(F.col("date"), slug, short).alias("id"), short.alias("short_id"), "channel", "shared_by", "date", "urls",
        F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("text"))).alias("kinds"), "attachments", "reactions", F.size("ms").alias("messages"),
        body.alias("body"),
        ((F.size("urls") > 0) | (F.size("attachments") > 0) | (text.substance(F.col("content")) >= SUBSTANCE)).alias("kept"),
    )


def _message_lines(x, unfurls):
    who = F.concat(F.lit("**"), text.display_name(x["m"]["author"]), F.lit("** ("),
                   F.replace(F.left(x["m"]["timestamp"], F.lit(16)), F.lit("T"), F.lit(" ")), F.lit("):"))
    files = F.array_join(F.transform(x["m"]["attachments"], lambda a: F.concat(F.lit("*[attached: "), a["fileName"], F.lit("]*"))), "\n")
    return F.concat_ws("\n", who, F.nullif(x["m"]["content"], F.lit("")), F.nullif(files, F.lit("")), unfurls, F.lit(""))


def cluster_counters(made: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Per channel: items written, clusters skipped."""
    if excluded is not None:
        out = excluded.select(F.substring_index("id", "-", -1).alias("short_id")).distinct().withColumn("out", F.lit(True))
        made = made.join(out, "short_id", "left").withColumn("kept", F.col("kept") & F.col("out").isNull())
    return made.groupBy("channel").agg(F.count_if("kept").alias("written"), F.count_if(~F.col("kept")).alias("skipped"))
