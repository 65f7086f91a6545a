"""Byte-level BPE encoding and decoding, in Arrow batches.

A pre-token is merged over a rank queue: each merge rank has a bucket of linked-list positions, and a three-level
bitmap of the non-empty buckets gives the lowest rank by find-first-set.  Entries that a merge has made stale are
skipped when they come up.  A merge touches two neighbours only, so a pre-token of n bytes takes O(n log n) steps
whatever its length, where rescanning takes O(n * n).

The vocabulary file is read on the driver from a path given by the caller and sent to the tasks; its size is that
of the file.  Each worker process keeps the ids of up to ``CACHE`` distinct pre-tokens from task to task, and starts
anew when they are full, which changes speed only.

Defined cases: a null text encodes to no ids; ids of a null stay empty bytes; repeated rows are encoded each for
itself; other columns of the input are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from odflux.llm._common import small_batches

CACHE = 700_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Positions by rank, lowest rank and then lowest position first."""

    def __init__(self, ranks: int) -> None:
        self.buckets: list[list[int] | None] = [None] * ranks
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        b = (top & -top).bit_length() - 1
        word = self.mid[b]
        a = (b << 6) + (word & -word).bit_length() - 1
        word = self.low[a]
        rank = (a << 6) + (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            self.low[a] ^= 1 << (rank & 63)
            if not self.low[a]:
                self.mid[b] ^= 1 << (a & 63)
                if not self.mid[b]:
                    self.top ^= 1 << b
        return rank, position


def merge(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """Ids of one pre-token."""
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    right = list(range(1, n + 1))  # the start of the next part, which is also the end of this one
    left = list(range(-1, n - 1))
    pair = [-1] * n  # rank of the part at a position with its successor; -1 if none
    push, pop = queue.push, queue.pop
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            pair[i] = r
            push(r, i)
    while (found := pop()) is not None:
        rank, i = found
        if pair[i] != rank:
            continue
        j = right[i]
        right[i] = k = right[j]
        pair[j] = pair[i] = -1
        if k < n:
            left[k] = i
            r = get(piece[i : right[k]])
            if r is not None:
                pair[i] = r
                push(r, i)
        h = left[i]
        if h >= 0:
            r = get(piece[h:k])
            if r is None:
                pair[h] = -1
            else:
                pair[h] = r
                push(r, h)
    out, i = [], 0
    while i < n:
        j = right[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


class Encoder(dict):
    """Packed little-endian ids by pre-token, computed at first sight."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.ranks, self.queue = ranks, RankQueue(max(ranks.values(), default=0) + 1)
        self.split = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        ids = merge(piece.encode(), self.ranks, self.queue)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join([self[piece] for piece in self.split(text)])


#: The worker's encoder, kept while the same vocabulary and pattern are asked for.
_KEPT: dict[str, Encoder] = {}


def _encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    kept = _KEPT.get(pattern)
    if kept is None or kept.ranks is not ranks:
        _KEPT.clear()
        _KEPT[pattern] = kept = Encoder(ranks, pattern)
    return kept


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids are unsigned 32-bit little-endian integers in a binary column."""
    small_batches(df.sparkSession)
    narrow = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        for batch in batches:
            ids = [encoder.encode(t) if t else b"" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return narrow.mapInArrow(run, StructType([narrow.schema["doc_id"], StructField("ids", BinaryType())]))


def decode(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) gains ``decoded``, the bytes that the ids stand for."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {v: k for k, v in ranks.value.items()}.__getitem__
        for batch in batches:
            texts = [b"".join(map(token, memoryview(x or b"").cast("I"))) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("decoded", BinaryType())]))


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode, and return counts and digests of both."""
    return decode(encode(df, path, pattern), path).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
