import os
import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import packing, tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary here")
TEXTS = ["Hello world", "  two  spaces\n\n\ttab ", "don't we'll I'd", "naïve café é", "日本語のテキスト", "🤷🏽‍♀️ emoji", "<|endoftext|>", "a" * 5000, "1234567890" * 30, "\x00\x01", "x", " ", "été" * 400, "…—«»"]


@needs_vocabulary
def test_ids_agree_with_the_library_and_decode():
    import tiktoken

    ranks = tokens.load_ranks(tokens.VOCABULARY)
    other = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = tokens.encoder(tokens.VOCABULARY)
    random.seed(3)
    alphabet = "ab Zé\n中🙂1'!"
    for t in TEXTS + ["".join(random.choices(alphabet, k=random.randint(1, 60))) for _ in range(300)]:
        assert encode(t) == other.encode_ordinary(t)


@needs_vocabulary
def test_columns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", *TEXTS])], "i int, t string")
    got = df.orderBy("i").select("t", tokens.token_ids(F.col("t")).alias("ids"), tokens.token_count(F.col("t")).alias("n")).withColumn("back", tokens.token_text(F.col("ids"))).collect()
    assert got[0].ids == [] and got[1].ids == [] and all(r.n == len(r.ids) for r in got)
    assert all(r.back == (r.t or "") for r in got)


def fill(h, capacity):
    placements, bins = packing.pack_histogram(h, capacity)
    used, free = [0] * bins, {}
    for length, rank, each, first, offset in placements:
        free.setdefault(length, []).append((rank, each, first, offset))
    for length, n in h.items():
        parts = sorted(free[length]) + [(n, 0, 0, 0)]
        assert parts[0][0] == 0
        for (rank, each, first, offset), (stop, *_) in zip(parts, parts[1:]):
            for k in range(rank, stop):
                b = first + (k - rank) // each
                assert used[b] >= 0
                used[b] += length
    assert all(0 < u <= capacity for u in used)
    return sum(used) / (bins * capacity)


def test_histograms():
    random.seed(1)
    for capacity in (1, 7, 64, 256):
        for _ in range(30):
            h = {random.randint(1, capacity): random.randint(1, 400) for _ in range(random.randint(1, capacity))}
            fill(h, capacity)
    assert packing.pack_histogram({}, 10) == ([], 0)
    assert fill({10: 1000}, 100) == 1.0
    many = {k: 1000 for k in range(1, 200)}
    assert fill(many, 256) > 0.97


def test_packing(spark):
    random.seed(2)
    sizes = [(i, random.choice([None, 0, 5, 5, 5, 60, 99, 100, 101, 250, 300])) for i in range(300)]
    df = spark.createDataFrame([(*s, "x", 1) for s in sizes], "doc_id bigint, n int, container string, length int")
    got = packing.pack(df, [("a", 100), ("b", 64)]).collect()
    for name, capacity in (("a", 100), ("b", 64)):
        rows = [r for r in got if r.container == name]
        by_doc, by_bin = {}, {}
        for r in rows:
            assert r.capacity == capacity
            by_doc.setdefault(r.doc_id, []).append(r)
            by_bin.setdefault(r.bin, []).append((r.bin_offset, r.bin_offset + r.tokens))
        for i, n in sizes:
            parts = sorted(by_doc[i], key=lambda r: r.piece)
            assert sum(p.tokens for p in parts) == (n or 0)
            assert len(parts) == max(1, -(-(n or 0) // capacity)) and all(p.first_token == k * capacity for k, p in enumerate(parts))
        for spans in by_bin.values():
            spans = sorted(s for s in spans if s[1] > s[0])
            assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:])) and all(s[1] <= capacity for s in spans)
    assert packing.pack(df.limit(0), [("a", 100)]).count() == 0
    empty = spark.createDataFrame([(1, 0), (2, None)], "doc_id bigint, n int")
    assert sorted((r.doc_id, r.bin, r.tokens) for r in packing.pack(empty, [("a", 10)]).collect()) == [(1, 0, 0), (2, 0, 0)]
    with pytest.raises(ValueError):
        packing.pack(df, [])
