"""Duplicates of new batches in everything accepted before.

The index of what was accepted is a folder of tables to which batches are
appended: keys (ids, sets of links, equal texts), and for near-duplicates an
inverted file.  A text is a sparse vector of its pairs of neighbouring words;
every pair is a cell that lists the texts that have it and where, and the full
vectors and words are kept beside.  A new text probes its cells from the rarest
on, and stops when the cells left are too few for any text within the distance;
what it met there is compared word by word unless lengths, places or the sets of
words rule it out.  No bound loses a pair: see ``_pairs_of``.

The tables are cut into buckets by the hash of what they are looked up by.  A
batch reads the buckets that its keys and cells fall into, the narrow columns
of the vectors that it meets there, and the words of candidates only; nothing
of the index is written again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.urls import LINK, canonical
from siltstone.operators.ranking import distributed_row_number
from siltstone.operators.skew import lookup_join
from siltstone.session import materialize, scratch_path, ship, spread, task_udf, width

#: Letters from which on a text is compared.
SHORTEST_TEXT = 200
#: Texts are the same from this share of common words in common order on.
SAME = 0.8
#: Share of a text's cells that are probed: follows from SAME and the shortest text that can be the same, of
#: SAME / (2 - SAME) * n words; see ``_pairs_of``.
PROBED = 1 - (3 * SAME / 2 - 1) * (1 + SAME / (2 - SAME))
#: Words of a text are also kept as a set of bits, in so many numbers of 64.
BITS = ["b0", "b1", "b2", "b3"]
#: Cells with more texts than this are probed in steps, the oldest texts first, and in blocks of so many.
CROWDED, STEP, GROWTH, BLOCK = 32768, 4, 8, 32768
#: Rarity of cells is looked up in so many slots, which every task holds; cells that share a slot count as more common.
SLOTS = 1 << 21

#: Default number of buckets of an index; it is fixed with the first batch and should grow with the index to come.
BUCKETS = 32
#: Bytes for each bucket from which on what is appended is not shuffled by bucket.
UNSHUFFLED = 1 << 18

KEYS = "kind string, key string, seq bigint"
CELLS = "cell bigint, cls bigint, pos int"
VECTORS = "cls bigint, n int, words array<string>, " + ", ".join(f"{b} bigint" for b in BITS)
NEAR = "cls bigint, near bigint"


def plain_text(body: Column) -> Column:
    """Text without attribution lines and links, white space as single spaces."""
    bare = F.regexp_replace(body, r"(?m)^\*\*[^\n]*\*\* \([0-9 :T.+-]*\):", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, LINK, " "), r"[\s\p{Z}]+", " "))


def prepare(rows: DataFrame) -> DataFrame:
    """(seq, batch, id, links, words) of corpus rows: sorted canonical links, words of long texts."""
    # a column of its own, as it is used twice
    rows = rows.withColumn("__text", plain_text(F.col("body")))
    text = F.col("__text")
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    links = F.filter(F.transform("urls", canonical), lambda u: u.isNotNull())
    return rows.select(
        "seq", "batch", F.nullif("id", F.lit("")).alias("id"),
        F.array_sort(F.array_distinct(links)).alias("links"),
        F.when(F.length(text) >= SHORTEST_TEXT, words).alias("words"),
    )


def _keys(rows: DataFrame) -> DataFrame:
    """(kind, key, seq): what a row is equal to another by."""
    keys = {
        "id": F.col("id"),
        "links": F.when(F.size("links") > 0, F.array_join("links", "\n")),
        "text": F.sha1(F.array_join("words", " ")),
    }
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in keys.items()])
    return rows.select(F.explode(kinds).alias("k"), "seq").select("k.kind", "k.key", "seq").where("key IS NOT NULL")


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits, each of which depends on all bits of ``x``."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_cells(words: pa.ListArray) -> tuple[pa.ListArray, np.ndarray]:
    """Cells of texts: hashes of the n + 1 pairs of neighbouring words in their order, the ends being neighbours too,
    and sets of words as bits of BITS."""
    flat = words.flatten().dictionary_encode()
    names = np.array([xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()], np.uint64)
    hashes = names[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    sizes = np.asarray(words.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    texts, wide = len(sizes), sizes + 1
    row, own = np.repeat(np.arange(texts), wide), np.repeat(np.arange(texts), sizes)
    starts = np.concatenate([[0], np.cumsum(wide)])
    at = np.arange(len(hashes)) + own
    left, right = np.full(len(row), 94, np.uint64), np.full(len(row), 36, np.uint64)
    left[at + 1], right[at] = hashes, hashes
    with np.errstate(over="ignore"):
        pairs = _mixed(left * np.uint64(0x9E3779B97F4A7C15) + _mixed(right + np.uint64(1)))
    bits = np.zeros((texts, 64 * len(BITS)), np.uint8)
    bits[own, (hashes % np.uint64(64 * len(BITS))).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1, bitorder="little").view("<i8").reshape(texts, len(BITS))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(pairs.view(np.int64))), packed


def _cells(words: Column) -> Column:
    """``pair_cells`` of a column, as a struct."""
    @task_udf("struct<cells: array<bigint>, " + ", ".join(f"{b}: bigint" for b in BITS) + ">")
    def of(texts: pa.Array) -> pa.Array:
        cells, packed = pair_cells(texts)
        return pa.StructArray.from_arrays([cells, *[pa.array(packed[:, i]) for i in range(len(BITS))]], ["cells", *BITS])

    return of(words)


def _vectors(rows: DataFrame) -> DataFrame:
    """(cls, n, words, cells, bits) of rows with words: n + 1 cells."""
    some = rows.where("size(words) > 0").select(F.col("seq").alias("cls"), F.size("words").alias("n"), "words")
    return some.select("cls", "n", "words", _cells(F.col("words")).alias("v")).select("cls", "n", "words", "v.*")


def _least(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    # in hundredths, so that no rounding is in the way
    return (round(50 * SAME) * (n + k) + 99) // 100


def _near_places(x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    n, k = x["n"][i], x["n"][j]
    most = n + k - 2 * _least(n, k)
    return (np.abs(x["middle"][i] - x["middle"][j]) <= most) & (np.abs(n - k) <= most)


def _enough_cells(x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    n, k = x["n"][i], x["n"][j]
    shared = 3 * _least(n, k) + 1 - n - k
    return (x["at"][i] <= n + 1 - shared) & (x["at"][j] <= k + 1 - shared)


def _enough_words(x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    n, k = x["n"][i], x["n"][j]
    least = _least(n, k)
    mine = sum(np.bitwise_count(word[i] & ~word[j]).astype(np.int64) for word in x["bits"])
    theirs = sum(np.bitwise_count(word[j] & ~word[i]).astype(np.int64) for word in x["bits"])
    return (mine <= n - least) & (theirs <= k - least)


#: Rows that are compared with others at a time; groups with more rows than SPLIT are compared by lengths.
AT_ONCE, SPLIT = 128, 256
#: Pairs that are looked at exactly at a time.
HELD = 500_000
ENTRY = ["meet", "cls", "n", "at", "pos", "probe", "target", *BITS]
MET = "meet bigint, cls bigint, other bigint"


def _rows(x: dict, of) -> dict:
    return {c: [of(w) for w in v] if c == "bits" else of(v) for c, v in x.items()}


def _meet(batches):
    """Pairs that may be the same, of Arrow batches of ENTRY rows in order of ``meet``."""
    rest = None
    for batch in batches:
        x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ENTRY if c not in BITS}
        x["bits"] = [batch.column(b).to_numpy(zero_copy_only=False).view(np.uint64) for b in BITS]
        if rest is not None:
            x = {c: [np.concatenate(w) for w in zip(rest[c], v)] if c == "bits" else np.concatenate([rest[c], v]) for c, v in x.items()}
        if not len(x["meet"]):
            continue
        starts = np.flatnonzero(np.concatenate([[True], x["meet"][1:] != x["meet"][:-1]]))
        # the last group may go on in the next batch
        last = starts[-1]
        yield from _pairs_of(_rows(x, lambda v, at=last: v[:at]))
        rest = _rows(x, lambda v, at=last: v[at:])
    if rest is not None:
        yield from _pairs_of(rest)


def _pairs_of(x: dict):
    """Pairs of rows of one ``meet`` that may be the same, a probe and an older target.

    Texts of n and k words that are the same have at least ``least`` = SAME / 2 * (n + k)
    words in common order.  With the ends of the texts these are least + 1 pairs of
    neighbours, and each of the n + k - 2 * least other words parts one of them at
    most; the rest are cells in common.  If both order their cells alike, those of a
    cell as they stand, the first of these has at least as many of the text's own
    cells from it on.  What stands before and after it differs by no more words than
    the other ones: the cell's places, counted from the middles of the texts in half
    words, are at most n + k - 2 * least apart.  And words that only one of them has,
    told by their bits, are none of the common ones.
    """
    if len(x["meet"]) < 2:
        return
    n = x["n"].astype(np.int64)
    middle = 2 * x["pos"].astype(np.int64) - n
    group = np.concatenate([[0], np.cumsum(x["meet"][1:] != x["meet"][:-1])])
    # lengths of texts that are the same are in one class or in neighbouring ones
    length = np.where(np.bincount(group)[group] > SPLIT, np.floor(np.log(n) / np.log(1.01 * (2 - SAME) / SAME)), 0).astype(np.int64)
    order = np.lexsort((middle, length, ~x["probe"], group))
    x = _rows(x, lambda v: v[order])
    n, middle, group, length = n[order], middle[order], group[order], length[order]
    x["middle"] = middle
    bits = np.unpackbits(np.stack(x["bits"], 1).view(np.uint8), axis=1, bitorder="little").astype(np.float32)
    # a row's words that the other lacks are no more than n - least: the sum over both rows' numbers is not below 0
    one = np.ones(len(n), np.float32)
    left = np.column_stack([bits, one, ((1 - SAME / 2) * n - bits.sum(1)).astype(np.float32)])
    right = np.column_stack([bits, (-SAME / 2 * n).astype(np.float32), one])
    edges = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (x["probe"][1:] != x["probe"][:-1]) | (length[1:] != length[:-1]), [True]]))
    longest = np.maximum.reduceat(n, edges[:-1])
    # runs of one length by group, probes before others
    first = edges[:-1]
    runs = list(zip(group[first].tolist(), x["probe"][first].tolist(), length[first].tolist(), x["target"][first].tolist(), first.tolist(), edges[1:].tolist(), longest.tolist()))
    found, held = [], 0
    for r, (g, probe, size, target, lo, hi, most) in enumerate(runs):
        if not probe:
            continue
        for other in runs[r:]:
            if other[0] != g:
                break
            _, probing, its, targeted, start, end, longer = other
            if abs(its - size) > 1 or not targeted or (probing and not target):
                continue
            same = start == lo
            if same and hi - lo < 2:
                continue
            reach = (1 - SAME) * (most + longer) + 1
            for at in range(lo, hi, AT_ONCE):
                to = min(at + AT_ONCE, hi)
                begin, stop = start, end
                if end - start > AT_ONCE:
                    begin = start + int(np.searchsorted(middle[start:end], middle[at] - reach))
                    stop = start + int(np.searchsorted(middle[start:end], middle[to - 1] + reach, "right"))
                if same:
                    begin = at
                if begin >= stop:
                    continue
                hits = np.flatnonzero(left[at:to] @ right[begin:stop].T > -0.01)
                if len(hits):
                    found.append((at + hits // (stop - begin), begin + hits % (stop - begin)))
                    held += len(hits)
        if held > HELD:
            yield from _checked(x, found)
            found, held = [], 0
    yield from _checked(x, found)


def _checked(x: dict, found: list[tuple[np.ndarray, np.ndarray]]):
    """The pairs of ``found`` that meet all bounds exactly."""
    if not found:
        return
    a, b = (np.concatenate(side) for side in zip(*found))
    young = x["cls"][a] > x["cls"][b]
    i, j = np.where(young, a, b), np.where(young, b, a)
    good = (x["cls"][i] != x["cls"][j]) & x["probe"][i] & x["target"][j]
    i, j = i[good], j[good]
    for check in (_near_places, _enough_cells, _enough_words):
        good = check(x, i, j)
        i, j = i[good], j[good]
    # texts of a group that have its cell again meet again
    pairs = np.unique(np.column_stack([x["meet"][i], x["cls"][i], x["cls"][j]]), axis=0)
    if len(pairs):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, c].copy()) for c in range(3)], names=["meet", "cls", "other"])


def _prefixes(batch: pa.RecordBatch, counts: np.ndarray) -> pa.RecordBatch:
    """Cells that texts (cls, n, cells, bits) probe, in their order from the rarest on by ``counts`` of slots."""
    cells = batch.column("cells")
    n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = cells.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = cells.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    size = counts[flat & (len(counts) - 1)]
    order = np.lexsort((flat, size, row))
    # a cell with one text has nothing to be found; those are rarest of all
    kept = order[(size[order] > 1) & (at <= np.floor(PROBED * n + 1e-9)[row])], at[(size[order] > 1) & (at <= np.floor(PROBED * n + 1e-9)[row])]
    own = pa.array(row[kept[0]])
    new = {"cell": pa.array(flat[kept[0]]), "at": pa.array(kept[1].astype(np.int32)), "pos": pa.array(at[kept[0]].astype(np.int32)), "size": pa.array(size[kept[0]].astype(np.int32))}
    for c in ("cls", "n", *BITS):
        new[c] = batch.column(c).take(own)
    return pa.RecordBatch.from_arrays([new[c] for c in PROBE], names=PROBE)


PROBE = ["cell", "cls", "n", "at", "pos", "size", *BITS]
PROBES = "cell bigint, cls bigint, n int, at int, pos int, size int, " + ", ".join(f"{b} bigint" for b in BITS)


def _probes(new: DataFrame, slots: DataFrame) -> DataFrame:
    """PROBES of texts ``new``; ``slots`` (slot, count) has no more than SLOTS rows, which every task gets."""
    ship(new.sparkSession)
    told = slots.toArrow()
    counts = np.ones(SLOTS, np.int32)
    counts[told["slot"].to_numpy()] = np.minimum(told["count"].to_numpy(), 2**31 - 1)
    counts = new.sparkSession.sparkContext.broadcast(counts)

    def of(batches):
        for batch in batches:
            yield _prefixes(batch, counts.value)

    return new.select("cls", "n", "cells", *BITS).mapInArrow(of, PROBES)


def meetings(entries: DataFrame) -> DataFrame:
    """(meet, cls, other): texts ``cls`` (``probe``) and older ones (``target``) of one ``meet`` that may be the same.

    Rows of one ``meet`` are compared in one task, which holds them all; callers keep them to some ten thousand.
    """
    ship(entries.sparkSession)
    return entries.select(ENTRY).repartition(width(entries.sparkSession), "meet").sortWithinPartitions("meet").mapInArrow(_meet, MET)


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        both = row & places.get(w, 0)
        row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def _likeness(a: Column, b: Column) -> Column:
    @task_udf("double")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = zip(left.to_pylist(), right.to_pylist())
        return pa.array([2.0 * common_words(x, y) / (len(x) + len(y)) for x, y in pairs], pa.float64())

    return of(a, b)


class History:
    """The persisted index under ``path``; one that does not exist yet is empty.

    A lost executor loses nothing, as all state is in written tables.  A
    batch that was appended twice changes nothing: first rows stay first.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark = spark
        self.path = path or scratch_path(spark, "history")
        self.buckets = buckets
        self._filled = path is not None

    def _bucket(self, *by: str) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(self.buckets)).cast("int")

    def _table(self, name: str, schema: str, touched: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
        """A table of the index; of ``touched`` (``by``) given, the buckets it falls into only, of which the driver learns the numbers."""
        if not self._filled:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{name}")
        if touched is not None:
            numbers = [r[0] for r in touched.select(self._bucket(*by).alias("b")).distinct().collect()]
            found = found.where(F.col("bucket").isin(numbers) if len(numbers) < self.buckets else F.lit(True))
        return found.drop("bucket")

    def _append(self, name: str, df: DataFrame, *by: str) -> None:
        # of much data each task writes its own files, so that it isn't shuffled
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        cut = df.withColumn("bucket", self._bucket(*by))
        cut = cut if size > self.buckets * UNSHUFFLED else cut.repartition("bucket")
        cut.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def accept(self, rows: DataFrame) -> DataFrame:
        """(seq, first): the first accepted or earlier row that each row of the batch repeats.

        ``rows`` as from ``prepare``; seq must be unique and larger than
        that of all batches before.  Rows that repeat nothing have no result
        row.  Afterwards the batch is part of the index.  Null ids, empty
        sets of links and texts that are null or short repeat nothing.
        """
        keys = materialize(_keys(rows), "keys")
        asked = keys.select("kind", "key").distinct()
        known = self._table("keys", KEYS, asked, ["kind", "key"]).join(asked, ["kind", "key"], "left_semi")
        first = materialize(known.unionByName(keys).groupBy("kind", "key").agg(F.min("seq").alias("first")), "first")
        fresh = first.where("kind = 'text'").select(F.col("first").alias("seq"))
        new = materialize(_vectors(spread(rows.join(fresh, "seq", "left_semi"))), "vectors")
        near = self._near(new)
        self._append("keys", keys.groupBy("kind", "key").agg(F.min("seq").alias("seq")), "kind", "key")
        self._append("vectors", new.drop("cells"), "cls")
        self._append("cells", new.select(F.posexplode("cells").alias("pos", "cell"), "cls").select("cell", "cls", "pos"), "cell")
        self._append("near", near, "cls")
        self._filled = True
        texts = first.where("kind = 'text'").select(F.col("first").alias("cls"))
        like = self._table("near", NEAR, texts, ["cls"]).groupBy(F.col("cls").alias("first")).agg(F.min("near").alias("near"))
        known = first.join(like.withColumn("kind", F.lit("text")), ["kind", "first"], "left")
        hits = lookup_join(keys, known, ["kind", "key"], "inner").select(
            "seq", F.least("near", F.when(F.col("first") < F.col("seq"), F.col("first"))).alias("first")
        )
        return hits.groupBy("seq").agg(F.min("first").alias("first")).where("first IS NOT NULL")

    def _near(self, new: DataFrame) -> DataFrame:
        """(cls, near): the oldest text that is nearly the same as each of ``new``, in index or batch."""
        cells = new.select(F.explode("cells").alias("cell"))
        counted, old = cells, None
        if self._filled:
            asked = materialize(cells.distinct(), "asked")
            old = self._table("cells", CELLS, asked, ["cell"]).join(asked, "cell", "left_semi")
            counted = cells.unionByName(old.select("cell"))
        slot = F.col("cell").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")
        entries = materialize(_probes(new, counted.groupBy(slot).count().where("count > 1")), "cells")
        if old is not None:
            # cells of texts in the index are in no order, so that all of them are met
            met = old.join(entries.select("cell").distinct(), "cell", "left_semi").join(self._table("vectors", VECTORS).select("cls", "n", *BITS), "cls")
            met = met.withColumns({"at": F.lit(-1), "size": F.lit(None).cast("int")}).select(PROBE)
            entries = materialize(entries.unionByName(met), "cells")
        new = new.select("cls", "words")
        # a cell is no larger than its slot
        sizes = entries.where(F.col("size").isNull() | (F.col("size") > CROWDED)).groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
        sizes = materialize(sizes.where(F.col("size") > CROWDED), "sizes")
        crowds = not sizes.isEmpty()
        quiet = entries.join(sizes, "cell", "left_anti") if crowds else entries
        quiet = quiet.withColumns({"meet": F.col("cell"), "probe": F.col("at") >= 0, "target": F.lit(True)})
        found = self._same(materialize(meetings(quiet).select("cls", "other").distinct(), "met"), new)
        if crowds:
            found = found.unionByName(self._crowded(entries.drop("size").join(sizes, "cell"), new))
        return materialize(found.groupBy("cls").agg(F.min("other").alias("near")), "near")

    def _same(self, pairs: DataFrame, new: DataFrame) -> DataFrame:
        """Pairs (cls, other) whose words agree in order; cls is of the batch ``new`` (cls, words).

        Of the index the words of candidates are read only.
        """
        mine = new.withColumnRenamed("words", "a")
        known = self._table("vectors", VECTORS, pairs.select(F.col("other").alias("cls")), ["cls"]).select("cls", "words")
        theirs = known.unionByName(new).withColumnsRenamed({"cls": "other", "words": "b"})
        theirs = theirs.join(pairs.select("other").distinct(), "other", "left_semi")
        both = pairs.join(mine, "cls").join(theirs, "other")
        # words of one text that the other lacks can be in no common order
        spare = lambda x: F.size(x) - SAME / 2 * (F.size("a") + F.size("b"))
        alike = (F.size(F.array_except("a", "b")) <= spare("a")) & (F.size(F.array_except("b", "a")) <= spare("b"))
        return materialize(both.where(alike & (_likeness(F.col("a"), F.col("b")) >= SAME)).select("cls", "other"), "same")

    def _crowded(self, entries: DataFrame, new: DataFrame) -> DataFrame:
        """Pairs found in crowded cells, for each text and cell at least the oldest there is.

        In each step the unanswered probes of a cell meet its next STEP
        (then GROWTH times as many) oldest texts.  A probe that is answered
        leaves its cell: texts come in order of age, so nothing older is left.
        """
        ranked = materialize(distributed_row_number(entries, ["cell"], ["cls", "pos"], "rank"), "crowd")
        left, lo, hi, found = ranked.where("at >= 0"), 0, STEP, None
        upto = lambda n: F.explode(F.sequence(F.lit(0), n))
        while not left.isEmpty():
            # the probes of a cell are cut into blocks, and so are the texts they meet; each block meets each
            slices = (hi - lo - 1) // BLOCK
            probes = left.withColumn("block", F.floor(F.col("rank") / BLOCK)).withColumn("slice", upto(F.lit(slices).cast("bigint")))
            oldest = ranked.where((F.col("rank") > lo) & (F.col("rank") <= hi)).withColumn("slice", F.floor((F.col("rank") - lo - 1) / BLOCK))
            oldest = oldest.withColumn("block", upto(F.floor(F.col("size") / BLOCK)))
            both = probes.withColumns({"probe": F.lit(True), "target": F.lit(False)}).unionByName(
                oldest.withColumns({"probe": F.lit(False), "target": F.lit(True)})
            ).withColumn("meet", F.xxhash64("cell", "block", "slice"))
            names = probes.select(F.xxhash64("cell", "block", "slice").alias("meet"), "cell").distinct()
            met = materialize(meetings(both).join(names, "meet").select("cell", "cls", "other"), "met")
            same = self._same(met.select("cls", "other").distinct(), new)
            found = same if found is None else found.unionByName(same)
            answered = met.join(same, ["cls", "other"], "left_semi").select("cell", "cls").distinct()
            left = materialize(left.where(F.col("rank") > hi).join(answered, ["cell", "cls"], "left_anti"), "left")
            lo, hi = hi, hi * GROWTH
        return found if found is not None else entries.select("cls", F.col("cls").alias("other")).limit(0)


def repeats_of_ledger(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """(seq, first): rows all of whose links the ledger had settled in an earlier batch, and its first line.

    A link is settled if the last line of its hash in the batches before the
    row's has a status other than error or toolong (a null status settles
    nothing).  Of several links the least first line counts.  Lines are first
    reduced to one per hash and batch, so that a hash with many lines meets a
    row at most once a batch.
    """
    lines = (
        ledger.where("hash IS NOT NULL AND batch IS NOT NULL").groupBy("hash", F.col("batch").alias("line_batch"))
        .agg(F.max(F.struct("seq", "status")).alias("last"), F.min("seq").alias("first"))
    )
    asked = materialize(
        rows.where("size(links) > 0 AND batch IS NOT NULL").select(
            "seq", "batch", F.size("links").alias("n"), F.explode("links").alias("link")
        ).select("seq", "batch", "n", F.left(F.sha1("link"), F.lit(10)).alias("hash")),
        "asked",
    )
    held = (
        asked.select("hash", "batch").distinct().join(lines, "hash").where("line_batch < batch")
        .groupBy("hash", "batch").agg(F.max("last").alias("last"), F.min("first").alias("first"))
        .where("last.status IS NOT NULL AND last.status NOT IN ('error', 'toolong')").select("hash", "batch", "first")
    )
    return (
        lookup_join(asked, held, ["hash", "batch"], "inner").groupBy("seq", "n")
        .agg(F.count_distinct("hash").alias("settled"), F.min("first").alias("first"))
        .where("settled = n").select("seq", "first")
    )


def repeated(corpus: DataFrame, ledger: DataFrame, history: History) -> DataFrame:
    """(seq, match_table, match_seq) of the corpus rows that repeat something accepted before."""
    rows = materialize(prepare(spread(corpus)), "prepared")
    found = materialize(history.accept(rows), "accepted")
    rest = rows.join(found, "seq", "left_anti")
    return found.select("seq", F.lit("corpus").alias("match_table"), F.col("first").alias("match_seq")).unionByName(
        repeats_of_ledger(rest, ledger).select("seq", F.lit("enrichment_ledger").alias("match_table"), F.col("first").alias("match_seq"))
    )
