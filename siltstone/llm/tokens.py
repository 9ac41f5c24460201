"""Byte-level BPE of whole texts with a public vocabulary of ranks."""

from __future__ import annotations

import base64
import heapq
import os

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from siltstone.session import task_udf

#: Default vocabulary; any file of "base64-token rank" lines can be given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a task remembers before it starts afresh; a matter of memory only.
REMEMBERED = 200_000

_loaded: dict[str, dict[bytes, int]] = {}
_encoders: dict = {}
_strings: dict[str, dict[int, bytes]] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, read once per Python process."""
    if path not in _loaded:
        # a worker without the file has the copy that the driver sent
        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as lines:
            _loaded[path] = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return _loaded[path]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the pair of least rank, leftmost first, is merged until none is left.

    Symbols form a doubly linked list (``end[i]`` is where the symbol that
    starts at i ends and the next begins, ``before[i]`` where the one before
    starts); candidate pairs wait in a queue by rank, and those whose symbols
    have changed since are skipped.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    queue = []

    def offer(i: int, mid: int) -> None:
        if i >= 0 and mid < n and (rank := ranks.get(piece[i:end[mid]])) is not None:
            heapq.heappush(queue, (rank, i, mid, end[mid]))

    for i in range(n - 1):
        offer(i, i + 1)
    while queue:
        _, i, mid, stop = heapq.heappop(queue)
        if end[i] != mid or end[mid] != stop:
            continue
        end[i], end[mid] = stop, -1
        if stop < n:
            before[stop] = i
        offer(before[i], i)
        offer(i, stop)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = end[i]
    return ids


def send_vocabulary(path: str) -> None:
    """Have every worker get a copy of a vocabulary file, once per application."""
    context = SparkSession.active().sparkContext
    if os.path.basename(path) not in {os.path.basename(f) for f in context.listFiles}:
        context.addFile(path)


def encoder(path: str):
    """A function from text to ids that remembers frequent pieces, one per Python process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = _encoder(path)
    return _encoders[path]


def _encoder(path: str):
    ranks, cut, known = load_ranks(path), regex.compile(PATTERN), {}

    def encode(text: str) -> list[int]:
        ids: list[int] = []
        for piece in cut.findall(text):
            got = known.get(piece)
            if got is None:
                got = merge(piece.encode("utf-8", "surrogatepass"), ranks)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(piece) < 64:
                    known[piece] = got
            ids += got
        return ids

    return encode


def token_ids(text: Column, path: str = VOCABULARY) -> Column:
    """Ids of a text, no special tokens (their strings are ordinary text); null and '' give []."""

    send_vocabulary(path)

    @task_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encode, flat, offsets = encoder(path), [], [0]
        for t in texts.to_pylist():
            if t is not None:
                flat += encode(t)
            offsets.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))

    return ids(text)


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Number of ids of a text; 0 for null."""

    send_vocabulary(path)

    @task_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        encode = encoder(path)
        return pa.array([0 if t is None else len(encode(t)) for t in texts.to_pylist()], pa.int32())

    return count(text)


def token_text(ids: Column, path: str = VOCABULARY) -> Column:
    """The text of ids: their vocabulary strings joined; an unknown id raises KeyError."""

    send_vocabulary(path)

    @task_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        strings = _strings.get(path) or _strings.setdefault(path, {i: b for b, i in load_ranks(path).items()})
        joined = [None if x is None else b"".join(strings[i] for i in x).decode("utf-8", "replace") for x in lists.to_pylist()]
        return pa.array(joined, pa.string())

    return text(ids)
