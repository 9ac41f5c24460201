"""The append-only ledger of fetched links, and the work it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import urls
from siltstone.operators.ranking import distributed_row_number
from siltstone.session import materialize

#: States in which a link is not fetched again.
TERMINAL = ["done", "dead", "skipped", "nocaptions", "manual"]
#: Kinds of links that are fetched.
KINDS = ["youtube", "blog", "github", "paper", "tweet"]


def compact(ledger: DataFrame) -> DataFrame:
    """The last line of every hash.  Partial maxima are taken before the shuffle."""
    columns = [c for c in ledger.columns if c not in ("hash", "seq")]
    last = ledger.where("hash IS NOT NULL").groupBy("hash").agg(F.max(F.struct("seq", *columns)).alias("last"))
    return last.select("hash", "last.*")


def counts_by_status(ledger: DataFrame) -> DataFrame:
    return compact(ledger).groupBy("status").agg(F.count(F.lit(1)).alias("links"))


def kind_status_matrix(ledger: DataFrame) -> DataFrame:
    """Links by kind, one column per status."""
    state = compact(ledger)
    sums = [F.count_if(F.col("status") == s).alias(s) for s in [*TERMINAL, "error", "toolong"]]
    return state.groupBy("kind").agg(*sums)


def item_links(items: DataFrame, site=None) -> DataFrame:
    """One row per link of an item: item, position, link, hash, kind.

    ``site`` gives, for a column of links, those whose hosts tell the kind, where these are others.
    """
    each = items.select(F.col("id").alias("item"), F.posexplode("urls").alias("pos", "url")).where("url IS NOT NULL")
    return each.withColumn("hash", urls.link_hash(F.col("url"))).withColumn("kind", urls.fetch_kind(site(F.col("url")) if site else F.col("url")))


def first_owners(links: DataFrame) -> DataFrame:
    """The first item (by id, then position) of every hash."""
    first = links.where("hash IS NOT NULL").groupBy("hash").agg(F.min(F.struct("item", "pos", "url", "kind")).alias("o"))
    return first.select("hash", "o.item", "o.pos", "o.url", "o.kind")


def worklist(items: DataFrame, ledger: DataFrame, kinds: list[str] | None = None, site=None) -> DataFrame:
    """Links still to be fetched, each under its first item of the wanted kinds.

    The order matters: kinds first, then first owners, then the ledger, so
    that a link whose first mention is of another kind is not lost.
    """
    wanted = item_links(items, site).where(F.col("kind").isin(kinds or KINDS))
    settled = compact(ledger).where(F.col("status").isin(TERMINAL)).select("hash")
    return first_owners(wanted).join(settled, "hash", "left_anti")


def pending_by_kind(items: DataFrame, ledger: DataFrame, kinds: list[str] | None = None, site=None) -> DataFrame:
    return worklist(items, ledger, kinds, site).groupBy("kind").agg(F.count(F.lit(1)).alias("pending"))


def first_work(items: DataFrame, ledger: DataFrame, limit: int, kinds: list[str] | None = None, site=None) -> DataFrame:
    """The first ``limit`` links of the work list, in the order of items."""
    return worklist(items, ledger, kinds, site).orderBy("item", "pos").limit(limit)


def caption_queue(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """Videos without captions, with the first item that has them."""
    waiting = compact(ledger).where("status = 'nocaptions'").select("hash", F.col("url").alias("ledger_url"))
    return waiting.join(first_owners(item_links(items)), "hash").select("hash", "item", "ledger_url")


def ledger_lines(results: DataFrame, date) -> DataFrame:
    """Lines to append for fetched links (hash, url, kind, status, meta, path)."""
    return results.select(
        "hash", urls.canonical(F.col("url")).alias("url"), "kind", "status", date.alias("date"),
        F.col("meta")["title"].alias("title"), F.col("meta")["error"].alias("error"), "path",
    )


def run_counters(results: DataFrame, work: DataFrame, states: list[str], every: int = 25) -> DataFrame:
    """Outcomes of every ``every`` links of a kind, in the order of the work list: kind, upto, and a column per state."""
    order = distributed_row_number(materialize(work.select("kind", "item", "pos", "hash"), "work"), ["kind"], ["item", "pos", "hash"], "i")
    upto = (F.floor((F.col("i") - 1) / every) + 1) * every
    counts = [F.count_if(F.col("status") == s).alias(s) for s in states]
    return order.join(results.select("hash", "status"), "hash").groupBy("kind", upto.alias("upto")).agg(*counts)


def progress(work: DataFrame, every: int = 25) -> DataFrame:
    """Every ``every``-th link of the work list with its number, by kind."""
    work = materialize(work.select("kind", "item", "pos", "hash"), "work")
    numbered = distributed_row_number(work, ["kind"], ["item", "pos"], "i")
    return numbered.where(F.col("i") % every == 0).select("kind", "i", "hash")
