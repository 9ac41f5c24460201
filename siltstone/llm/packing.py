"""Filling containers of fixed capacity: shortest-pack-first over a histogram."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.ranking import distributed_row_number
from siltstone.session import materialize, ship

PLACED = "container string, capacity int, bin bigint, doc_id bigint, piece int, first_token bigint, tokens int, bin_offset int"


def pack_histogram(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placements for ``histogram[length]`` items of each length in 1..capacity, and the number of bins.

    Lengths are placed longest first, always into the pack that is filled
    least.  Bins filled alike are one pack, a run of bin numbers with a count,
    so the work depends on the capacity (at most that many lengths, about two
    packs each), not on the number of items.  A placement is (length, rank of
    its first item, items per bin, first bin, offset in the bin); it lasts to
    the next placement of its length.
    """
    packs: list[tuple[int, int, int]] = []  # (-free, first bin, bins)
    placements, bins = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if packs and -packs[0][0] >= length:
                free, first, count = heapq.heappop(packs)
                free = -free
                # up to half of what fits, so that a pack is visited a few times only
                each = min((free // length + 1) // 2, max(1, left // count))
                used = min(count, left // each)
                if used < count:
                    heapq.heappush(packs, (-free, first + used, count - used))
            else:
                free, first = capacity, bins
                each = min(capacity // length, left)
                used = left // each
                bins += used
            placements.append((length, rank, each, first, capacity - free))
            heapq.heappush(packs, (each * length - free, first, used))
            rank += each * used
            left -= each * used
    return placements, bins


def pieces(sizes: DataFrame, containers: list[tuple[str, int]]) -> DataFrame:
    """Items to place: a document is one, unless it exceeds the capacity on its own."""
    kinds = F.array(*[F.struct(F.lit(n).alias("container"), F.lit(c).alias("capacity")) for n, c in containers])
    each = sizes.withColumn("c", F.explode(kinds)).select("doc_id", "n", "c.container", "c.capacity")
    last = F.greatest(F.ceil(F.col("n") / F.col("capacity")) - 1, F.lit(0)).cast("int")
    cut = each.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    return cut.withColumn("first_token", F.col("piece").cast("bigint") * F.col("capacity")).withColumn(
        "length", F.least(F.col("capacity"), F.col("n") - F.col("first_token")).cast("int")
    )


def pack(sizes: DataFrame, containers: list[tuple[str, int]]) -> DataFrame:
    """Every document of ``sizes`` (doc_id, n) assigned to bins of each capacity.

    One row per container kind, document and piece: ``bin``, the tokens
    ``first_token`` .. + ``tokens`` of the document, and their offset in the
    bin.  Only documents with more than ``capacity`` tokens have several
    pieces, all but the last of them full.  Documents without tokens (or a
    null size) take no space and are spread over the bins (one bin, 0, if
    there are no others).  Equal sizes are told apart by doc_id; repeated
    doc_ids are packed as often as they come; an empty table gives no rows.

    To the driver come the histograms, at most ``capacity`` rows each, and
    the placements go back as a broadcast of a size that depends on the
    capacity in the same way.
    """
    spark = sizes.sparkSession
    ship(spark)
    if not containers or any(c < 1 for _, c in containers):
        raise ValueError("containers need a capacity of at least 1")
    items = pieces(sizes.select("doc_id", F.coalesce("n", F.lit(0)).alias("n")), containers)
    ranked = materialize(
        distributed_row_number(items.drop("n"), ["container", "length"], ["doc_id", "piece"], "rank"), "pieces"
    )
    counts: dict[str, dict[int, int]] = {name: {} for name, _ in containers}
    for row in ranked.groupBy("container", "length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["container"]][row["length"]] = row["n"]
    plan = {}
    for name, capacity in containers:
        placements, bins = pack_histogram({k: v for k, v in counts[name].items() if k}, capacity)
        p = np.array(sorted(placements), dtype=np.int64).reshape(-1, 5)
        plan[name] = (p, (p[:, 0] << 40) + p[:, 1], max(bins, 1))
    shared = spark.sparkContext.broadcast(plan)

    def place(batches):
        for b in batches:
            names = np.array(b.column("container").to_pylist(), dtype=object)
            length = b.column("length").to_numpy().astype(np.int64)
            rank = b.column("rank").to_numpy().astype(np.int64) - 1
            at, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for name, (p, keys, bins) in shared.value.items():
                own = names == name
                some, none = own & (length > 0), own & (length == 0)
                at[none] = rank[none] % bins
                q = p[np.searchsorted(keys, (length[some] << 40) + rank[some], "right") - 1]
                after = rank[some] - q[:, 1]
                at[some] = q[:, 3] + after // q[:, 2]
                offset[some] = q[:, 4] + after % q[:, 2] * length[some]
            yield pa.RecordBatch.from_arrays(
                [b.column("container"), b.column("capacity"), pa.array(at), b.column("doc_id"), b.column("piece"),
                 b.column("first_token"), b.column("length"), pa.array(offset.astype(np.int32))],
                names=["container", "capacity", "bin", "doc_id", "piece", "first_token", "tokens", "bin_offset"],
            )

    return ranked.mapInArrow(place, PLACED)


def fill_report(packed: DataFrame) -> DataFrame:
    """Bins, tokens and share of filled space per container kind."""
    bins = packed.groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("t"))
    return bins.groupBy("container", "capacity").agg(
        F.count(F.lit(1)).alias("bins"), F.sum("t").alias("tokens"),
        (F.sum("t") / (F.count(F.lit(1)) * F.col("capacity"))).alias("filled"),
    )
