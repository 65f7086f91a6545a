"""Quality classifier: perplexity under an interpolated modified Kneser-Ney bigram model of trusted text.

Trusted text is that of documents labelled good and not toxic; a fifth of it, by the checksum of the id, is held out.

* Vocabulary: every word that trusted text has at least ``LEAST`` times, whatever the size of the input, known by a
  64-bit hash; any other word falls into one of ``ENDINGS`` unknown classes, one for each pair of last bytes: words with
  an ending that trusted text hasn't are improbable, however many they are.  Frequent words have low numbers, which
  pack well.  Tables over classes go to every task; they take about 37 bytes for each word of the vocabulary, and grow with it.
* Counts: each batch of texts sends its distinct bigrams with their counts to shards by the hash of the bigram, and a
  shard adds them up.  Discounts, context weights and continuation counts come from all shards' counts.
* Scoring: a batch looks up bigrams with at least 1 / ``HEAD`` of all counts, and those whose context or word was never
  seen, on the spot.  All other bigrams are scored there as if never counted, and go, packed by batch, to shards that are
  ranges of bigrams, where they meet the counts; shards stream their requests past the sorted counts and send back, for each
  batch, what the bigrams that they found add to its documents, if anything.  A packet's gaps stay as small however many
  shards there are.  A sample of ``SAMPLE`` documents and the counts set the limits of the ranges, which change no result.
* Thresholds: the ``QUANTILE`` of the held-out trusted perplexities of each language, times ``SLACK``; a language without
  a held-out document has none, and takes the quantile over all languages.

Defined cases: null or blank text has no tokens, a null perplexity, and isn't kept; without trusted text every class is
equally likely, and thresholds are null, so nothing is kept; null lang is a language of its own; rows with equal ids are scored
each for itself; repeated labels count once, as bad or toxic if any is; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from odflux.llm._common import durable, marked, members, release, remove, small_batches, written
from odflux.llm.ngram_join import CELLS, CHUNK, _added, _batch

LEAST = 2
ENDINGS = 1 << 16
HEAD = 1 << 19
#: Trusted tokens, and bytes of text to be scored, for each shard: either may be the larger.
SHARD, ASKED = 8_000_000, 32 << 20
#: From so many shards on, text to be scored makes a new one for ``STREAMED`` bytes only: it streams through its shard, and
#: documents get an answer from each shard that found a bigram of theirs.
SPREAD, STREAMED = 64, 256 << 20
#: Documents, keys of a batch and keys of all counts that the limits of the ranges are taken from.
SAMPLE, PLACES, MARKS = 1000, 1024, 1 << 16
#: What a shard adds to a document is a multiple of this, so that sums are exact in any order (below about a million).
GRAIN = 2.0**-32
QUANTILE, SLACK = 0.99, 1.25

SHARDED = StructType([StructField("shard", IntegerType()), StructField("kind", IntegerType()), StructField("batch", LongType()), StructField("body", BinaryType())])
COUNT, REQUEST, LOCAL = 0, 1, 2


def _packed(*arrays: np.ndarray) -> bytes:
    """Equally long arrays of numbers from 0, by byte planes, each compressed alone; high planes of zeros take nothing."""
    press, planes, widths = zstandard.ZstdCompressor(level=1).compress, [], []
    for x in arrays:
        flat = x.astype("<u8")
        widths.append((int(flat.max(initial=0)).bit_length() + 7) // 8)
        planes += [press(flat.view(np.uint8)[k::8].tobytes()) for k in range(widths[-1])]
    head = np.asarray([len(arrays[0]), *widths, *map(len, planes)], dtype="<u4")
    return head.tobytes() + b"".join(planes)


def _unpacked(raw: bytes, arrays: int) -> list[np.ndarray]:
    opened, out = zstandard.ZstdDecompressor().decompress, []
    n, *widths = np.frombuffer(raw, "<u4", 1 + arrays).tolist()
    sizes = np.frombuffer(raw, "<u4", sum(widths), 4 * (1 + arrays)).tolist()
    at, sizes = 4 * (1 + arrays + len(sizes)), iter(sizes)
    for width in widths:
        flat = np.zeros(8 * n, dtype=np.uint8)
        for k in range(width):
            size = next(sizes)
            flat[k::8] = np.frombuffer(opened(raw[at : at + size]), dtype=np.uint8)
            at += size
        out.append(flat.view("<u8"))
    return out


def _gaps(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys as gaps of contexts, and words: the first of each context, then gaps within it."""
    context, word = keys // size, keys % size
    gap = np.diff(context, prepend=0)
    same = gap == 0
    same[:1] = False
    return gap, np.where(same, np.diff(word, prepend=0), word)


def _keys(gap: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
    gap, word = gap.astype(np.int64), word.astype(np.int64)
    first = gap != 0
    first[:1] = True
    at, along = np.flatnonzero(first), np.cumsum(word)
    before = np.repeat((along - word)[at], np.diff(np.append(at, len(gap))))
    return np.cumsum(gap) * size + along - before


def _coded(keys: np.ndarray, counts: np.ndarray, size: int) -> bytes:
    """Sorted keys and their counts (1 or more)."""
    return _packed(*_gaps(keys, size), counts - 1)


def _decoded(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    gap, word, less = _unpacked(raw, 3)
    return _keys(gap, word, size), less.astype(np.int64) + 1


def _merged(pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all pieces, and their counts added up."""
    if not pieces:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    keys, counts = map(np.concatenate, zip(*(_decoded(x, size) for x in pieces)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    h = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return ((h * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in words), dtype="<u8")


class Classes:
    """Class numbers of words: vocabulary (by the place of its hash in ``hashes``), unknown classes, and the start of a text."""

    def __init__(self, hashes: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order.astype(np.uint32)
        self.base, self.start = len(hashes), len(hashes) + ENDINGS
        self.size = len(hashes) + ENDINGS + 1

    def __call__(self, words: list[bytes]) -> np.ndarray:
        distinct = list(dict.fromkeys(words))
        number = np.fromiter((self.base + int.from_bytes(w[-2:]) for w in distinct), dtype=np.int64, count=len(distinct))
        if self.base:
            wanted = word_hashes(distinct)
            at = np.minimum(np.searchsorted(self.hashes, wanted), self.base - 1)
            number = np.where(self.hashes[at] == wanted, self.number[at], number)
        get = dict(zip(distinct, number.tolist())).__getitem__
        return np.fromiter(map(get, words), dtype=np.int64, count=len(words))

    def bigrams(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys (context * size + class) of all bigrams of a batch, their texts' places, and the token counts."""
        words, sizes = [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            found = words_of(text)
            sizes[i] = len(found)
            words += found
        c = self(words)
        context = np.concatenate([[self.start], c[:-1]])[: len(c)]
        context[(np.cumsum(sizes) - sizes)[sizes > 0]] = self.start
        return context * self.size + c, np.repeat(np.arange(len(texts)), sizes), sizes


def trusted(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(ids, texts, folder) of the trusted documents; ``held`` tells those kept out of the counts, which have no text here.

    A bitmap of hashed ids, broadcast at a fixed size, picks the texts where they lie.  Only where a trusted and
    another document fall on one place of the bitmap (told from ids alone) do texts meet the ids in a join.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0")
    good = durable(good.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held")))
    counted = good.where(~F.col("held")).select("doc_id")
    others = members(counted, docs.select("doc_id").where("doc_id is not null")).join(counted, "doc_id", "left_anti")
    texts = members(counted, docs.select("doc_id", "text").where("doc_id is not null and text is not null"))
    chosen, where = written(marked(durable(others), texts, "shared"), "trusted")
    told = durable(chosen.where("shared").join(counted, "doc_id").select("text"))
    return good, chosen.where(~F.col("shared")).select("text").unionByName(told), where


def vocabulary(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Hashes of all words that occur at least LEAST times, frequent ones (by quarters of an octave) first; and the number of tokens."""
    schema = StructType([StructField("word", LongType()), StructField("n", LongType())])

    def out(seen: Counter[bytes]) -> pa.RecordBatch:
        return _batch(schema, [word_hashes(list(seen)).view(np.int64), list(seen.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(words_of(text))
            if len(seen) > 300_000:
                yield out(seen)
                seen = Counter()
        yield out(seen)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level = np.floor(4 * np.log2(batch.column("n").to_numpy())).astype(np.uint8)
            both = [batch.column("word").to_numpy().tobytes(), level.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in both], ["words", "levels"])

    counted = texts.mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    total = texts.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    rows = counted.mapInArrow(pack, "words binary, levels binary").collect()
    hashes = np.frombuffer(b"".join(bytes(r["words"]) for r in rows), dtype="<u8")
    levels = np.frombuffer(b"".join(bytes(r["levels"]) for r in rows), dtype=np.uint8)
    return hashes[np.lexsort((hashes, 255 - levels))], total


def _dealt(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs, and its places in their order."""
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        yield int(s), order[cuts[s] : cuts[s + 1]]


def bigram_counts(texts: DataFrame, classes: Classes, shards: int) -> DataFrame:
    """One row a shard: its sorted distinct bigrams and their counts over all ``texts``."""
    shared, size = texts.sparkSession.sparkContext.broadcast(classes), classes.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = np.unique(shared.value.bigrams(batch.column("text").to_pylist())[0], return_counts=True)
            rows = [(s, COUNT, 0, _coded(keys[o], counts[o], size)) for s, o in _dealt(shard_of(keys, shards), shards)]
            yield _batch(SHARDED, list(zip(*rows)) or [[]] * 4)

    def add(table: pa.Table) -> pa.Table:
        body = _coded(*_merged(table.column("body").to_pylist(), size), size)
        return pa.Table.from_batches([_batch(SHARDED, [[table.column("shard")[0].as_py()], [COUNT], [0], [body]])])

    return texts.mapInArrow(run, SHARDED).groupBy("shard").applyInArrow(add, SHARDED)


def _statistics(counts: DataFrame, size: int) -> np.ndarray:
    """Rows over classes: context count, contexts' numbers of bigrams seen once, twice, more often, continuations; then counts of counts."""
    width = size + 8
    chunks = -(-6 * width // CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(chunks * CHUNK, dtype=np.int64)
        out = flat[: 6 * width].reshape(6, width)
        for batch in batches:
            for body in batch.column("body"):
                keys, n = _decoded(body.as_py(), size)
                context, word = keys // size, keys % size
                out[0, :size] += np.bincount(context, n, size).astype(np.int64)
                for row, which in ((1, n == 1), (2, n == 2), (3, n > 2)):
                    out[row, :size] += np.bincount(context[which], minlength=size)
                out[4, :size] += np.bincount(word, minlength=size)
                out[5, :5] += np.bincount(np.minimum(n, 5), minlength=6)[:5]
        part = TaskContext.get().partitionId()
        packed = [zlib.compress(flat[c * CHUNK : (c + 1) * CHUNK].tobytes(), 1) for c in range(chunks)]
        yield _batch(CELLS, [[part] * chunks, list(range(chunks)), packed])

    parts = counts.mapInArrow(run, CELLS).withColumn("part", (F.col("part") / 256).cast("int"))
    rows = parts.groupBy("part", "chunk").applyInArrow(_added, CELLS).withColumn("part", F.lit(0)).groupBy("chunk").applyInArrow(_added, CELLS).collect()
    flat = np.zeros(chunks * CHUNK, dtype=np.int64)
    for r in rows:
        flat[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(bytes(r["counts"])), dtype=np.int64)
    return flat[: 6 * width].reshape(6, width)


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts for counts 0, 1, 2, 3 and more, from the numbers of things seen once to four times (n[1..4])."""
    if not n[1] or not n[2]:
        return np.asarray([0.0, 0.5, 0.75, 0.9])
    y = n[1] / (n[1] + 2 * n[2])
    d = [0.0] + [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k * y for k in (1, 2, 3)]
    return np.clip(d, 0.0, [0, 1, 2, 3])


class Model:
    """Tables of the model over its classes, unigrams and context weights, and the frequent bigrams."""

    def __init__(self, classes: Classes, stats: np.ndarray, head: list[tuple[int, int]]) -> None:
        size = self.size = classes.size
        self.classes = classes
        context, once, twice, more, continued = stats[:5, :size].astype(np.float64)
        self.discount = discounts(stats[5])
        d = discounts(np.bincount(np.minimum(stats[4, :size], 5), minlength=6))
        total = max(continued.sum(), 1)
        taken = d[np.minimum(stats[4, :size], 3)]
        self.unigram = np.where(continued > 0, continued - taken, 0) / total + (taken[continued > 0].sum() / total if continued.any() else 1) / size
        self.context = context
        held = self.discount[1] * once + self.discount[2] * twice + self.discount[3] * more
        self.weight = np.where(context > 0, held / np.maximum(context, 1), 1.0)
        self.unseen = continued == 0
        rows = sorted(head)
        self.head = np.asarray([k for k, _ in rows], dtype=np.int64)
        self.counts = np.asarray([c for _, c in rows], dtype=np.int64)

    def log_p(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log probability of each bigram given its count."""
        context, word = keys // self.size, keys % self.size
        own = (counts - self.discount[np.minimum(counts, 3)]) / np.maximum(self.context[context], 1)
        return np.log(own + self.weight[context] * self.unigram[word])

    def at_once(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts where the tables tell them, and whether they do."""
        counts = np.zeros(len(keys), dtype=np.int64)
        known = (self.context[keys // self.size] == 0) | self.unseen[keys % self.size]
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, keys), len(self.head) - 1)
            hit = self.head[at] == keys
            counts[hit] = self.counts[at[hit]]
            known |= hit
        return counts, known

    def added(self, asked: np.ndarray, doc: np.ndarray, times: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, sums): what the bigrams asked for add to their score as never counted, by sorted ``keys`` with ``counts``.

        Bigrams that weren't found add nothing, but where those never counted have no probability at all.
        """
        found = np.zeros(len(asked), dtype=np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            found = np.where(keys[at] == asked, counts[at], 0)
        without = self.log_p(asked, np.zeros_like(found))
        never = np.isneginf(without)
        says = (found > 0) | never
        more = self.log_p(asked[says], found[says]) - np.where(never, 0, without)[says]
        who, place = np.unique(doc[says], return_inverse=True)
        return who, np.round(np.bincount(place, more * times[says], len(who)) / GRAIN) * GRAIN


PACKED = StructType([StructField("batch", LongType()), StructField("kind", IntegerType()), StructField("body", BinaryType())])
SCORED = StructType([StructField("doc_id", LongType()), StructField("lang", StringType()), StructField("log_p", DoubleType()), StructField("n_tokens", LongType())])


def _marks(step: int, size: int):
    """Every ``step``-th key of the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                keys = _decoded(body.as_py(), size)[0]
                yield pa.RecordBatch.from_arrays([pa.array(keys[step // 2 :: step])], ["key"])

    return run


def limits_of(docs: DataFrame, rows: int, counts: DataFrame, distinct: int, model, shards: int) -> np.ndarray:
    """First keys of all shards but the first: ranges with about equal parts of the requests, by a sample, and of the counts.

    No shard has more than about twice its part of either.
    """
    if shards == 1:
        return np.zeros(0, dtype=np.int64)
    size = model.value.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            keys, doc, _ = m.classes.bigrams(batch.column("text").to_pylist())
            keys = np.sort(keys[~m.at_once(keys)[1]])
            some = keys[np.arange(min(PLACES, len(keys))) * len(keys) // max(1, min(PLACES, len(keys)))]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), len(keys) / max(1, len(some))))], ["key", "share"])

    few = docs.where(F.rand(7) < min(1.0, SAMPLE / max(1, rows))).select("text")
    asked = few.mapInArrow(run, "key long, share double").collect()
    marks = counts.mapInArrow(_marks(max(1, distinct // MARKS), size), "key long").collect()
    whole = max(sum(r["share"] for r in asked), 1e-9)
    keys = np.asarray([r["key"] for r in asked] + [r["key"] for r in marks], dtype=np.int64)
    share = np.asarray([r["share"] / whole for r in asked] + [1 / max(1, len(marks))] * len(marks))
    if not len(keys):
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    along = np.cumsum(share[order])
    at = np.searchsorted(along, along[-1] * np.arange(1, shards) / shards)
    return np.unique(keys[order][np.minimum(at, len(keys) - 1)])


def ranged(counts: DataFrame, limits: np.ndarray, size: int) -> DataFrame:
    """The counts, dealt to the ranges that ``limits`` part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                keys, n = _decoded(body.as_py(), size)
                cuts = [0, *np.searchsorted(keys, limits).tolist(), len(keys)]
                rows = [(s, COUNT, 0, _coded(keys[a:b], n[a:b], size)) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                yield _batch(SHARDED, list(zip(*rows)) or [[]] * 4)

    return counts.mapInArrow(run, SHARDED)


def requests(docs: DataFrame, model, limits: np.ndarray) -> DataFrame:
    """Packed look-ups of all documents, and what each batch could score by itself: all bigrams, those looked up as never counted."""
    shards = len(limits) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, base = model.value, TaskContext.get().partitionId() << 40
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            keys, doc, sizes = m.classes.bigrams(batch.column("text").to_pylist())
            counts, known = m.at_once(keys)
            p = m.log_p(keys, counts)
            p[~known & np.isneginf(p)] = 0
            local = np.bincount(doc, p, len(sizes)).astype(np.float64)
            sink = pa.BufferOutputStream()
            row = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(local), pa.array(sizes)], SCORED.names)
            with pa.ipc.new_stream(sink, row.schema) as w:
                w.write_batch(row)
            out = [((base + number) % shards, LOCAL, base + number, zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes()))]
            keys, doc = keys[~known], doc[~known]
            order = np.lexsort((doc, keys))
            keys, doc = keys[order], doc[order]
            at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])) if len(keys) else np.zeros(0, dtype=np.int64)
            times = np.diff(np.append(at, len(keys)))
            keys, doc = keys[at], doc[at]
            cuts = [0, *np.searchsorted(keys, limits).tolist(), len(keys)]
            for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    out.append((s, REQUEST, base + number, _packed(*_gaps(keys[a:b], m.size), doc[a:b], times[a:b] - 1)))
            yield _batch(SHARDED, list(zip(*out)))

    return docs.select("doc_id", "text", "lang").mapInArrow(run, SHARDED)


def partial_scores(counts: DataFrame, asked: DataFrame, model, shards: int) -> DataFrame:
    """What each batch scored by itself, and a row for each batch and shard that adds to it.

    In each partition the pieces of a shard's counts come first, and its requests stream past them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, shard, pieces, keys, counts = model.value, None, [], None, None
        for batch in batches:
            out = []
            for s, kind, name, body in zip(*(batch.column(c).to_pylist() for c in SHARDED.names)):
                if s != shard:
                    shard, pieces, keys, counts = s, [], None, None
                if kind == COUNT:
                    pieces.append(body)
                    continue
                if kind == LOCAL:
                    out.append((name, LOCAL, body))
                    continue
                if keys is None:
                    keys, counts = _merged(pieces, m.size)
                    pieces = []
                gap, word, doc, less = _unpacked(body, 4)
                who, sums = m.added(_keys(gap, word, m.size), doc.astype(np.int64), less.astype(np.int64) + 1, keys, counts)
                if len(who):
                    out.append((name, REQUEST, _packed(np.diff(who, prepend=0), sums.view(np.uint64))))
            yield _batch(PACKED, list(zip(*out)) or [[]] * 3)

    both = counts.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind")
    return both.mapInArrow(run, PACKED)


def whole_scores(partial: DataFrame) -> DataFrame:
    """A row for each document: its batch's own sums and those of all shards, added up."""

    def add(table: pa.Table) -> pa.Table:
        rows, extra = None, []
        for kind, body in zip(table.column("kind").to_pylist(), table.column("body").to_pylist()):
            if kind == LOCAL:
                with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)) as r:
                    rows = r.read_all()
            else:
                who, sums = _unpacked(body, 2)
                extra.append((np.cumsum(who.astype(np.int64)), sums.view(np.float64)))
        total = rows.column("log_p").to_numpy().copy()
        # in a fixed order, so that sums don't depend on which shard came first
        for who, sums in sorted(extra, key=lambda x: (len(x[0]), x[0].tobytes(), x[1].tobytes())):
            total[who] += sums
        return rows.set_column(2, "log_p", pa.array(total))

    return partial.groupBy("batch").applyInArrow(add, SCORED)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n_tokens, perplexity, threshold, kept) for each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    good, texts, where = trusted(docs, labels)
    hashes, total = vocabulary(texts)
    classes = Classes(hashes)
    rows, asked = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, -(-total // SHARD), min(SPREAD, -(-asked // ASKED)), -(-asked // STREAMED))
    counts = durable(bigram_counts(texts, classes, shards))
    remove(spark, where)
    del texts
    head = counts.mapInArrow(_frequent(max(1, -(-total // HEAD)), classes.size), "key long, n long").collect()
    stats = _statistics(counts, classes.size)
    model = Model(classes, stats, [(r["key"], r["n"]) for r in head])
    shared = spark.sparkContext.broadcast(model)
    limits = limits_of(docs, rows, counts, int(stats[4].sum()), shared, shards)
    # shuffles of the vocabulary and the counts; the JVM hears of dropped frames about a second late, so not right after the counts
    release(spark)
    partial = partial_scores(ranged(counts, limits, classes.size), requests(docs, shared, limits), shared, len(limits) + 1)
    mean = F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_p") / F.col("n_tokens")))
    scores = durable(whole_scores(partial).select("doc_id", "lang", "n_tokens", mean.alias("perplexity")))
    held = scores.join(good.where("held").select("doc_id"), "doc_id").where("perplexity is not null")
    at = lambda c: F.percentile_approx(c, F.lit(QUANTILE), F.lit(10_000)) * SLACK
    pooled = held.agg(at("perplexity")).first()[0]
    limits = held.groupBy(F.col("lang").alias("_lang")).agg(at("perplexity").alias("own"))
    limit = F.coalesce("own", F.lit(pooled).cast("double"))
    judged = scores.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("threshold", limit)
    return judged.select("doc_id", "lang", "n_tokens", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))


def _frequent(least: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                keys, n = _decoded(body.as_py(), size)
                yield pa.RecordBatch.from_arrays([pa.array(keys[n >= least]), pa.array(n[n >= least])], ["key", "n"])

    return run
