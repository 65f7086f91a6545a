"""N-gram Jaccard join: documents linked by exact Jaccard similarity of their word shingles, and their components.

The join is a sparse product of the document by n-gram incidence matrix with its transpose, cut into column blocks.

1. One pass over the texts gives each document's set size, a digest of its set, and counts of n-grams in a fixed number
   of hash cells.  Documents with equal sets are one class, known by its smallest id.
2. A document of n n-grams can have overlap enough with another only if the two share one of the n - ceil(0.75 n) + 1
   first of them in a common order, here rare cells first.  Only these columns enter the product, packed by batch and
   block; equal sets enter once for each task.
3. A block brings its columns together.  Columns of one set fall away.  Of the others, each set is multiplied with the
   column's pivot, the set with the smallest digest: a group of near copies gives one product for each member, not for
   each pair.  Overlap counts are added up over the blocks; pairs below a part of the overlap that their sizes imply are
   discarded, and the rest held against their whole sets.  Columns of a pair may have different pivots, so this finds
   most links inside such groups, and need not find all.
4. The links found so far make components.  A column whose sets all lie in one component can't add a link and is
   dropped.  The others get another pivot, drawn by another hash, and sets of other components are multiplied with it;
   this is repeated while it goes on to merge components, so a loose group of near copies, too, comes together at linear
   cost.  The columns left are multiplied in full, block by block, between sets of different components, and the
   overlap counts of a pair are added up over the blocks.  Signatures of each set's first columns and of its whole set
   bound what a pair can share over all blocks; pairs below the overlap that their sizes imply are discarded in the block, and again when all
   counts are in.  The pairs left are held against their whole sets.  No link between components is missed, so the final
   components are exact.

A block in which some column is hot is dealt over salts by the digest of the set; its salts' pivots are then multiplied
with each other.  In the full product, a column of many sets is split into ``SLICE``-sized pieces, and each pair of
pieces is multiplied on its own, so no task holds a whole hot column.

Defined cases: documents without words, or null, have an empty set and are linked with nothing; fewer than five words
make one n-gram; rows with the same id are one node; a null id has a null component; an empty table gives an empty
result; other columns are not read, and in ``keep_one`` are left as they are, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from odflux.llm._common import LOOK_UP, durable, fresh, least_heavy, marked, meet, members, release, remove, replaced, settled, small_batches, written
from odflux.llm.components import components

SHINGLE = 5
#: Similarity 3/4 as integers: 4 * overlap >= 3 * union.
UP, DOWN = 3, 4
CELL_BITS = 18
CHUNK = 1 << 14
#: Columns of a block, about; and documents of a column that are multiplied at once.
BLOCK = 1_000_000
SLICE = 2_048
#: 64-bit words of the signature of a set's first columns, and of that of its whole set; pairs compared at once.
SIGNATURE, WHOLE = 8, 16
COMPARED = 200_000

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit n-gram hashes of a text.  Word hashes are kept up to a fixed number."""

    LIMIT = 150_000

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self.words
        if len(known) > self.LIMIT:
            known.clear()
        try:
            ids = [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            ids = [known[w] for w in words]
        w = np.array(ids, dtype=np.uint64)
        if len(w) < SHINGLE:
            return np.array([xxhash.xxh3_64_intdigest(w.tobytes(), seed=1)], dtype=np.uint64)
        n = len(w) - SHINGLE + 1
        h = w[:n].copy()
        for k in range(1, SHINGLE):
            h = h * _MIX[0] + w[k : n + k]
        h = np.sort(_scramble(h))
        return h[np.concatenate([[True], h[1:] != h[:-1]])]


def prefix_length(n: np.ndarray | int) -> np.ndarray | int:
    """Columns of a set of n that a linked document must meet: n - ceil(3n/4) + 1."""
    return n - (UP * n + DOWN - 1) // DOWN + 1


def least_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest overlap that links sets of a and b: ceil(3 (a + b) / 7)."""
    return (UP * (a + b) + UP + DOWN - 1) // (UP + DOWN)


def rest(n: np.ndarray) -> np.ndarray:
    """Columns of a set of n beyond its first ones: ceil(3n/4) - 1."""
    return (UP * n + DOWN - 1) // DOWN - 1


def column_signatures(h: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """A row for each document's number of columns, then ``SIGNATURE`` rows of bits, one bit for each column."""
    bits = np.zeros((SIGNATURE, size), dtype=np.uint64)
    place = h & np.uint64(64 * SIGNATURE - 1)
    np.bitwise_or.at(bits, ((place >> np.uint64(6)).astype(np.int64), doc), np.uint64(1) << (place & np.uint64(63)))
    return np.concatenate([np.bincount(doc, minlength=size).astype(np.int64)[None], bits.view(np.int64)])


def whole_signature(h: np.ndarray) -> bytes:
    """Bits of a whole set, one bit for each n-gram."""
    bits = np.zeros(64 * WHOLE, dtype=bool)
    bits[((h >> np.uint64(20)) & np.uint64(64 * WHOLE - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def may_share(about: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether documents a and b can share enough of their first columns, and enough of their whole sets.

    ``about`` has a column for each document: id, component, set size, number of columns, ``SIGNATURE`` words of bits,
    and, where known, whether the whole set's bits are, and ``WHOLE`` words of these.
    Each bit of a's signature that b's lacks stands for a column that b hasn't got, so the bounds are never too low.
    """
    out, cut = np.zeros(len(a), dtype=bool), 4 + SIGNATURE
    for at in range(0, len(a), COMPARED):
        x, y = about[:, a[at : at + COMPARED]], about[:, b[at : at + COMPARED]]
        lacks = lambda p, q: np.bitwise_count((p & ~q).view(np.uint64)).sum(axis=0, dtype=np.int64)
        bound = np.minimum(x[3] - lacks(x[4:cut], y[4:cut]), y[3] - lacks(y[4:cut], x[4:cut]))
        need = least_overlap(x[2], y[2])
        fit = bound >= need - np.maximum(rest(x[2]), rest(y[2]))
        if len(about) > cut:
            p, q = x[cut + 1 :], y[cut + 1 :]
            fit &= (np.minimum(x[2] - lacks(p, q), y[2] - lacks(q, p)) >= need) | (x[cut] == 0) | (y[cut] == 0)
        out[at : at + COMPARED] = fit
    return out


PROFILE = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("n", LongType()),
        StructField("set_key", BinaryType()),
        StructField("part", IntegerType()),
        StructField("chunk", IntegerType()),
        StructField("counts", BinaryType()),
    ]
)
CELLS = StructType([StructField("part", IntegerType()), StructField("chunk", IntegerType()), StructField("counts", BinaryType())])


def _kinds(schema: StructType) -> list[pa.DataType]:
    of = {LongType(): pa.int64(), IntegerType(): pa.int32(), BinaryType(): pa.binary()}
    return [of[f.dataType] for f in schema]


def _batch(schema: StructType, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _kinds(schema))], schema.names)


def profile(docs: DataFrame) -> DataFrame:
    """Set profiles, one row a document, and the task's cell counts as extra rows with a chunk number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, cells = Shingler(), np.zeros(1 << CELL_BITS, dtype=np.int64)
        for batch in batches:
            n, keys, seen = [], [], []
            for text in batch.column("text").to_pylist():
                h = shingles(text)
                n.append(len(h))
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                seen.append(h >> np.uint64(64 - CELL_BITS))
            cells += np.bincount(np.concatenate(seen).astype(np.int64) if seen else [], minlength=1 << CELL_BITS)
            none = [None] * len(n)
            yield _batch(PROFILE, [batch.column("doc_id"), n, keys, none, none, none])
        part = TaskContext.get().partitionId()
        chunks = range(len(cells) // CHUNK)
        packed = [zlib.compress(cells[c * CHUNK : (c + 1) * CHUNK].tobytes(), 1) for c in chunks]
        none = [None] * len(chunks)
        yield _batch(PROFILE, [none, none, none, [part] * len(chunks), list(chunks), packed])

    return docs.select("doc_id", "text").mapInArrow(run, PROFILE)


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x.as_py()), dtype=np.int64) for x in table.column("counts"))
    first = table.column("part")[0].as_py(), table.column("chunk")[0].as_py()
    return pa.Table.from_batches([_batch(CELLS, [[first[0]], [first[1]], [zlib.compress(total.tobytes(), 1)]])])


def cell_levels(profiles: DataFrame) -> np.ndarray:
    """Half-octave levels of the cell counts, added up over 256 tasks at a time; a table of fixed size."""
    parts = profiles.where("chunk is not null").select((F.col("part") / 256).cast("int").alias("part"), "chunk", "counts")
    some = parts.groupBy("part", "chunk").applyInArrow(_added, CELLS)
    rows = some.withColumn("part", F.lit(0)).groupBy("chunk").applyInArrow(_added, CELLS).collect()
    total = np.zeros(1 << CELL_BITS, dtype=np.int64)
    for r in rows:
        total[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(bytes(r["counts"])), dtype=np.int64)
    return np.floor(2 * np.log2(total + 1)).astype(np.uint8)


def verified(docs: DataFrame, pairs: DataFrame, total: int) -> DataFrame:
    """The pairs (u, v) of ``pairs`` (settled, ``total`` rows) whose texts are linked, by exact overlap of their whole n-gram sets.

    A pair shows once for each way to take its two texts, where an id has several.
    A document that is in very many pairs is their u; its pairs are dealt over salts, 256 to each.
    """
    least = max(256, least_heavy(total))
    hubs = F.broadcast(pairs.groupBy("u").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least).select("u", F.expr("cast((k + 255) div 256 as int)").alias("salts")))
    dealt = pairs.join(hubs, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1)).cast("long")).cast("int").alias("salt"))
    ids = durable(pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct())
    texts = members(ids, docs.select("doc_id", "text").where("doc_id is not null and text is not null"))
    salted = pairs.select("u").distinct().join(hubs, "u", "left").select("u", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    heads = salted.join(texts, F.col("u") == F.col("doc_id")).select("u", "salt", F.col("text").alias("head"))
    full = dealt.join(texts, F.col("v") == F.col("doc_id")).select("u", "v", "salt", "text").join(heads, ["u", "salt"]).select("u", "v", "text", "head")
    out = StructType([StructField("u", LongType()), StructField("v", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, held = Shingler(), None, None
        for batch in batches:
            us, vs = [], []
            for u, v, text, head in zip(*(c.to_pylist() for c in batch.columns)):
                if head is not last and head != last:
                    last, held = head, shingles(head)
                h = shingles(text)
                both = len(np.intersect1d(h, held, assume_unique=True))
                if both and (UP + DOWN) * both >= UP * (len(h) + len(held)):
                    us.append(u)
                    vs.append(v)
            yield _batch(out, [us, vs])

    return full.mapInArrow(run, out)


COLUMNS = StructType([StructField("doc_id", LongType()), StructField("set", LongType()), StructField("n", LongType()), StructField("columns", BinaryType()), StructField("bits", BinaryType())])


def first_columns(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(doc_id, set, n, columns, bits): the packed first n-grams of each document, rare cells first; a set once for each task."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, level = Shingler(), shared.value.astype(np.uint64) << np.uint64(57)
        seen: set[bytes] = set()
        for batch in batches:
            found: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                h = shingles(text)
                key = xxhash.xxh3_128_digest(h.tobytes())
                if not len(h) or key in seen:
                    continue
                if len(seen) > Shingler.LIMIT:
                    seen.clear()
                seen.add(key)
                order = level[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)] | (h & np.uint64((1 << 57) - 1))
                p = prefix_length(len(h))
                first = h[np.argpartition(order, p - 1)[:p]] if p < len(h) else h
                for to, x in zip(found, (doc, int.from_bytes(key[:8], "little", signed=True), len(h), first.tobytes(), whole_signature(h))):
                    to.append(x)
            yield _batch(COLUMNS, found)

    return docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(run, COLUMNS)


def _blocks(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All columns of a batch's documents, and the document's place in the batch for each."""
    raw = batch.column("columns").to_pylist()
    h = np.frombuffer(b"".join(raw), dtype=np.uint64)
    return h, np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])


def hot_blocks(rows: DataFrame, blocks: int) -> dict[int, int]:
    """Number of salts of each block that holds more than twice ``BLOCK`` columns: fewer than half of the blocks do."""
    counted = StructType([StructField("block", LongType()), StructField("k", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(blocks, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_blocks(_unpacked(batch)[0], blocks), minlength=blocks)
        at = np.flatnonzero(total)
        yield _batch(counted, [at, total[at]])

    found = rows.mapInArrow(run, counted).groupBy("block").agg(F.sum("k").alias("k")).where(F.col("k") > 2 * BLOCK)
    return {r["block"]: -(-r["k"] // BLOCK) for r in found.collect()}


PACKED = StructType([StructField("block", IntegerType()), StructField("salt", IntegerType()), StructField("columns", BinaryType()), StructField("docs", BinaryType())])
SHARED = StructType([StructField(c, LongType()) for c in ("col", "set", "n", "doc", "pivot_set", "pivot_n", "pivot", "weight")])
#: Weight of a column in a salted block: its sets meet the pivot of their salt only, so counts of columns tell nothing.
SURE = 1 << 40
#: The part of the least overlap that a pair with a pivot must show, as a divisor; and the most rounds of further pivots.
PIVOT_PART, ROUNDS = 3, 6
#: Links for each mixed entry below which a round isn't followed by another.
LEAST_MERGED = 0.002


def _runs(h: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)


def shared_columns(rows: DataFrame, blocks: int, hot: dict[int, int]) -> DataFrame:
    """(col, set, n, doc, pivot_set, pivot_n, pivot, weight): the columns of two or more sets, with each of their sets and the pivot.

    A set has one row for each column, with the smallest id seen.  A salted block has all of its columns: those of one
    set in this salt may have others elsewhere.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = np.ones(blocks, dtype=np.int64)
        for b, k in hot.items():
            salts[b] = k
        for batch in batches:
            h, doc = _unpacked(batch)
            about = np.stack([np.asarray(batch.column(c).to_pylist(), dtype=np.int64) for c in ("set", "n", "doc_id")]) if batch.num_rows else np.zeros((3, 0), dtype=np.int64)
            block = _blocks(h, blocks)
            salt = (_scramble(about[0].astype(np.uint64) * _MIX[0])[doc] % salts[block].astype(np.uint64)).astype(np.int64)
            order = np.lexsort((salt, block))
            h, doc, block, salt = h[order], doc[order], block[order], salt[order]
            cut = _runs(block * (1 + salts.max()) + salt)
            columns: list[list] = [[], [], [], []]
            for a, b in zip(cut, [*cut[1:], len(h)]):
                who, local = np.unique(doc[a:b], return_inverse=True)
                for to, x in zip(columns, (int(block[a]), int(salt[a]), h[a:b].tobytes(), np.uint32(len(who)).tobytes() + about[:, who].tobytes() + local.astype(np.uint16).tobytes())):
                    to.append(x)
            yield _batch(PACKED, columns)

    def find(table: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(x.as_py() for x in table.column("columns")), dtype=np.uint64)
        docs, local, at = [], [], 0
        for x in table.column("docs"):
            raw = x.as_py()
            size = int(np.frombuffer(raw, np.uint32, 1)[0])
            docs.append(np.frombuffer(raw, np.int64, 3 * size, 4).reshape(3, size))
            local.append(np.frombuffer(raw, np.uint16, -1, 4 + 24 * size).astype(np.int64) + at)
            at += size
        about, doc = np.concatenate(docs, axis=1), np.concatenate(local)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        whole = table.column("block")[0].as_py() in hot

        def several(h: np.ndarray) -> np.ndarray:
            at = _runs(h)
            size = np.diff(np.append(at, len(h)))
            return np.repeat(size > 1, size)

        if not whole:
            keep = several(h)
            h, doc = h[keep], doc[keep]
        sets, n, ids = about[:, doc]
        order = np.lexsort((ids, n, sets, h))
        h, sets, n, ids = h[order], sets[order], n[order], ids[order]
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[1:] != h[:-1]) | (sets[1:] != sets[:-1]) | (n[1:] != n[:-1])
        h, sets, n, ids = h[first], sets[first], n[first], ids[first]
        if not whole:
            keep = several(h)
            h, sets, n, ids = h[keep], sets[keep], n[keep], ids[keep]
        at = _runs(h)
        pivot = np.repeat(at, np.diff(np.append(at, len(h))))
        return pa.Table.from_batches([_batch(SHARED, [h.view(np.int64), sets, n, ids, sets[pivot], n[pivot], ids[pivot], np.full(len(h), SURE if whole else 1)])])

    return rows.mapInArrow(split, PACKED).groupBy("block", "salt").applyInArrow(find, SHARED)


def _beyond(n: str) -> str:
    return f"(({UP} * {n} + {DOWN - 1}) div {DOWN} - 1)"


def enough(counted: DataFrame, part: int = 1) -> DataFrame:
    """Pairs (u, v) of (u, v, nu, nv, c) that share as many first columns as a link between sets of their sizes must, or 1 / ``part`` of them."""
    least = f"({UP} * (nu + nv) + {UP + DOWN - 1}) div {UP + DOWN} - greatest({_beyond('nu')}, {_beyond('nv')})"
    return counted.where(f"u <> v and {DOWN} * least(nu, nv) >= {UP} * greatest(nu, nv) and {part} * c >= {least}").select("u", "v").distinct()


def pivot_pairs(shared: DataFrame, salted: bool) -> DataFrame:
    """(u, v): sets' documents with the pivots of their columns, where sizes and the number of columns allow a link.

    A pair may share columns that have another pivot, so some links don't show here; the full product finds these.
    """
    pairs = shared.where("set <> pivot_set or n <> pivot_n").select(F.col("pivot").alias("u"), F.col("doc").alias("v"), F.col("pivot_n").alias("nu"), F.col("n").alias("nv"), "weight")
    if salted:
        # pivots of the salts of one column; a column has at most as many as its block has salts
        own = shared.select("col", F.struct("pivot_set", "pivot_n", "pivot").alias("own")).distinct()
        top = own.groupBy("col").agg(F.min("own").alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1").select("col", "top")
        more = own.join(top, "col").where("own <> top").select(F.col("top.pivot").alias("u"), F.col("own.pivot").alias("v"), F.col("top.pivot_n").alias("nu"), F.col("own.pivot_n").alias("nv"))
        pairs = pairs.unionByName(more.withColumn("weight", F.lit(SURE)))
    return enough(pairs.groupBy("u", "v", "nu", "nv").agg(F.sum("weight").alias("c")), PIVOT_PART)


COUNTED = StructType([StructField(c, LongType()) for c in ("u", "v", "nu", "nv", "c")])


def shared_counts(mixed: DataFrame, entries: int, bits: DataFrame) -> DataFrame:
    """(u, v, nu, nv, c): pairs of sets from different components that may share enough mixed columns, with those of a block.

    ``mixed`` has (col, rep, n, component, k), k being the number of sets of a column, and ``bits`` the signatures of
    whole sets by (rep, n), null where there are several.  A column of more than ``SLICE``
    sets is cut into slices by a hash of the set; each slice, and each pair of slices, is a piece of its own.
    """
    blocks, wide, most = max(1, -(-entries // BLOCK)), 5 + SIGNATURE + WHOLE, SLICE
    packed = StructType([StructField("block", IntegerType()), StructField("piece", LongType()), StructField("columns", BinaryType()), StructField("docs", BinaryType())])
    rows = mixed.groupBy("rep", "n", "component").agg(F.collect_list(F.struct("col", "k")).alias("columns")).join(bits, ["rep", "n"], "left")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("columns")
            flat = lists.flatten()
            h, k = flat.field("col").to_numpy().view(np.uint64), flat.field("k").to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            about = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("rep", "component", "n")])
            whole = batch.column("bits").to_pylist()
            known = np.asarray([[x is not None for x in whole]], dtype=np.int64)
            whole = np.frombuffer(b"".join(x or bytes(8 * WHOLE) for x in whole), dtype=np.int64).reshape(-1, WHOLE).T
            about = np.concatenate([about, column_signatures(h, doc, about.shape[1]), known, whole])
            slot = _scramble(about[0].astype(np.uint64) * _MIX[0] + about[2].astype(np.uint64))
            slices = np.where(k > most, 1 << np.ceil(np.log2(np.maximum(k, 1) / most)).astype(np.int64), 1)
            parts = [(h[slices == 1], doc[slices == 1], np.zeros((slices == 1).sum(), dtype=np.int64), np.zeros((slices == 1).sum(), dtype=np.uint8))]
            for s in np.unique(slices[slices > 1]):
                at = np.flatnonzero(slices == s)
                mine = np.repeat((slot[doc[at]] % np.uint64(s)).astype(np.int64), s)
                other = np.tile(np.arange(s), len(at))
                hh, low, high = np.repeat(h[at], s), np.minimum(mine, other), np.maximum(mine, other)
                piece = _scramble(hh * _MIX[0] + (low * s + high).astype(np.uint64)).view(np.int64) | 1
                side = np.where(mine == other, 0, np.where(mine == low, 1, 2)).astype(np.uint8)
                parts.append((hh, np.repeat(doc[at], s), piece, side))
            h, doc, piece, side = (np.concatenate(x) for x in zip(*parts))
            block = _blocks(h, blocks)
            order = np.lexsort((piece, block))
            h, doc, piece, side, block = h[order], doc[order], piece[order], side[order], block[order]
            cut = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (piece[1:] != piece[:-1])]))
            columns: list[list] = [[], [], [], []]
            for a, b in zip(cut, [*cut[1:], len(h)]):
                who, local = np.unique(doc[a:b], return_inverse=True)
                head = np.asarray([len(who), b - a], dtype=np.uint32).tobytes()
                for to, x in zip(columns, (int(block[a]), int(piece[a]), h[a:b].tobytes(), head + about[:, who].tobytes() + local.astype(np.uint16).tobytes() + side[a:b].tobytes())):
                    to.append(x)
            yield _batch(packed, columns)

    def multiply(table: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(x.as_py() for x in table.column("columns")), dtype=np.uint64)
        docs, local, sides, at = [], [], [], 0
        for x in table.column("docs"):
            raw = x.as_py()
            size, many = (int(v) for v in np.frombuffer(raw, np.uint32, 2))
            docs.append(np.frombuffer(raw, np.int64, wide * size, 8).reshape(wide, size))
            local.append(np.frombuffer(raw, np.uint16, many, 8 + 8 * wide * size).astype(np.int64) + at)
            sides.append(np.frombuffer(raw, np.uint8, many, 8 + 8 * wide * size + 2 * many))
            at += size
        about, doc, side = np.concatenate(docs, axis=1), np.concatenate(local), np.concatenate(sides)
        order = np.argsort(h, kind="stable")
        h, doc, side = h[order], doc[order], side[order]
        ids, group, size = about[:3, doc]
        width = max(1, about.shape[1])
        total = np.zeros((0, 2), dtype=np.int64)
        waiting: list[np.ndarray] = []
        held = 0

        def settle() -> None:
            nonlocal total, waiting, held
            pairs = np.concatenate([total[:, 0], *waiting])
            weight = np.concatenate([total[:, 1], np.ones(len(pairs) - len(total), dtype=np.int64)])
            keys, back = np.unique(pairs, return_inverse=True)
            total, waiting, held = np.stack([keys, np.bincount(back, weight, len(keys)).astype(np.int64)], axis=1), [], 0
            total = total[may_share(about, keys // width, keys % width)]

        left, d = np.arange(len(h)), 0
        while len(left):
            d += 1
            left = left[left + d < len(h)]
            left = left[h[left] == h[left + d]]
            right = left + d
            fit = (group[left] != group[right]) & (ids[left] != ids[right])
            fit &= DOWN * np.minimum(size[left], size[right]) >= UP * np.maximum(size[left], size[right])
            fit &= (side[left] != side[right]) | (side[left] == 0)
            if fit.any():
                # a pair has one number in all columns, whichever of the two comes first
                a, b = doc[left[fit]], doc[right[fit]]
                waiting.append(np.minimum(a, b) * width + np.maximum(a, b))
                held += int(fit.sum())
                if held > 2_000_000:
                    settle()
        settle()
        a, b, c = total[:, 0] // width, total[:, 0] % width, total[:, 1]
        swap = about[0][a] > about[0][b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return pa.Table.from_batches([_batch(COUNTED, [about[0][a], about[0][b], about[2][a], about[2][b], c])])

    return rows.mapInArrow(split, packed).groupBy("block", "piece").applyInArrow(multiply, COUNTED)


def mixed_columns(placed: DataFrame, found: DataFrame, known: int) -> tuple[DataFrame, int]:
    """(col, rep, n, component, k) and its row count: the rows of ``placed`` (col, rep, n) in columns whose sets lie in two or more components.

    ``found`` (id, component; ``known`` rows) tells a class's component, where it isn't the id itself.
    """
    placed, total = settled(replaced(placed.select("col", "rep", "n", F.col("rep").alias("component")), "component", found, known))
    groups = placed.groupBy("col").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("k"), F.count(F.lit(1)).alias("sets")).where("low <> high")
    return settled(meet(placed, groups, "col", least_heavy(total), ["rep", "n"]).select("col", "rep", "n", "component", F.col("sets").alias("k")))


def _merged(found: DataFrame, known: int, more: DataFrame) -> tuple[DataFrame, int]:
    """Components ``found`` (``known`` rows) after the links ``more`` between them, and their row count: links move to component numbers, so they stay few."""
    second, moved = settled(components(replaced(replaced(more.select("u", "v"), "u", found, known), "v", found, known)))
    if moved <= LOOK_UP:
        old = replaced(found, "component", second, moved)
    else:
        groups = found.groupBy("component").agg(F.count(F.lit(1)).alias("k")).join(second.toDF("_id", "_final"), F.col("component") == F.col("_id"), "left").select("component", F.coalesce("_final", "component").alias("final"), "k")
        old = meet(found, groups, "component", least_heavy(known), ["id"]).select("id", F.col("final").alias("component"))
    new = second.join(found.select("id"), "id", "left_anti").select("id", "component")
    return settled(old.unionByName(new))


def turn_pairs(mixed: DataFrame, total: int, turn: int) -> DataFrame:
    """(u, v): sets with the pivot that ``turn`` draws for each of their mixed columns, where it lies in another component."""
    drawn = F.struct(F.xxhash64("rep", "n", F.lit(turn)).alias("h"), F.col("rep").alias("u"), F.col("n").alias("nu"), F.col("component").alias("other"))
    rows = mixed.select("col", "rep", "n", "component")
    top = rows.groupBy("col").agg(F.min(drawn).alias("top"), F.count(F.lit(1)).alias("k"))
    met = meet(rows, top, "col", least_heavy(total), ["rep", "n"]).where("component <> top.other")
    pairs = met.groupBy(F.col("top.u").alias("u"), F.col("rep").alias("v"), F.col("top.nu").alias("nu"), F.col("n").alias("nv")).agg(F.count(F.lit(1)).alias("c"))
    return enough(pairs, PIVOT_PART)


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profiles, where = written(profile(docs), "ngram-profiles")
    levels = cell_levels(profiles)
    sets = profiles.where("chunk is null")
    full = sets.where("n > 0 and doc_id is not null")
    rows, firsts = full.agg(F.count(F.lit(1)), F.sum(F.expr(f"n - (({UP} * n + {DOWN - 1}) div {DOWN}) + 1"))).first()
    least = least_heavy(rows)
    classes = durable(full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1"))
    named = meet(full.select("doc_id", "set_key"), classes, "set_key", least, ["doc_id"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    ids = durable(named.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high or low <> doc_id"))
    copies, named_so = settled(ids.where("low = high").select("doc_id", F.col("low").alias("rep")))
    # an id with several texts lies in several classes, and makes them one
    same_id = named.join(ids.where("low <> high").select("doc_id"), "doc_id").where("rep <> doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))

    blocks = max(1, -(-int(firsts or 0) // BLOCK))
    columns, at = written(first_columns(docs, levels), "ngram-columns")
    hot = hot_blocks(columns, blocks)
    shared, beside = written(shared_columns(columns, blocks, hot), "ngram-shared")
    near, pairs = settled(replaced(replaced(pivot_pairs(shared, bool(hot)), "u", copies, named_so), "v", copies, named_so).where("u <> v").distinct())
    release(docs.sparkSession)
    found, known = settled(components(verified(docs, near, pairs).unionByName(same_id)))
    placed = replaced(shared.select("col", F.col("doc").alias("rep"), "n"), "rep", copies, named_so)
    mixed, entries = mixed_columns(placed, found, known)
    remove(docs.sparkSession, beside)
    release(docs.sparkSession)
    for turn in range(ROUNDS):
        if not entries:
            break
        near, pairs = settled(turn_pairs(mixed, entries, turn))
        more, merged = settled(verified(docs, near, pairs))
        if not merged:
            break
        found, known = _merged(found, known, more)
        before = entries
        mixed, entries = mixed_columns(mixed, found, known)
        release(docs.sparkSession)
        if merged < LEAST_MERGED * before:
            break
    if entries:
        bits = replaced(columns.select(F.col("doc_id").alias("rep"), "n", "bits"), "rep", copies, named_so).groupBy("rep", "n").agg(F.min("bits").alias("low"), F.max("bits").alias("high"))
        bits = bits.select("rep", "n", F.when(F.col("low") == F.col("high"), F.col("low")).alias("bits"))
        counted = shared_counts(mixed, entries, bits).groupBy("u", "v", "nu", "nv").agg(F.sum("c").alias("c"))
        candidates, pairs = settled(enough(counted))
        if pairs:
            found, known = _merged(found, known, verified(docs, candidates, pairs))
    remove(docs.sparkSession, at)
    release(docs.sparkSession)
    # copies get their component with their class, so the class's smallest id needn't meet all of them
    of_class = replaced(classes, "rep", found, known).select("set_key", F.col("rep").alias("of_class"), "k")
    wide = meet(sets.select("doc_id", "n", "set_key"), of_class, "set_key", least, ["doc_id"], "left").withColumn("component", F.col("doc_id"))
    wide = replaced(wide, "component", found, known)
    own = F.when(F.col("n") > 0, F.coalesce("of_class", "component")).otherwise(F.col("component"))
    out = durable(wide.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id")))
    remove(docs.sparkSession, where)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that with its smallest id.  Rows with a null id all stay.

    Only documents that a bitmap of their ids can't rule out are shuffled to meet the decisions; the others pass.
    """
    joined = join_components(docs)
    decided = joined.where("doc_id is not null").groupBy(F.col("doc_id").alias("decided")).agg(F.min("component_id").alias("keep"), F.count(F.lit(1)).alias("k"))
    decided = durable(decided.where("keep <> decided or k > 1").select("decided", (F.col("keep") == F.col("decided")).alias("first")))
    ids = decided.select(F.col("decided").alias("doc_id"))
    told, key, first, rank = (fresh(docs, c) for c in ("_told", "_decided", "_first", "_rank"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    split = marked(ids, docs, told)
    clear = split.where(~F.col(told)).select(*names)
    met = split.where(told).join(decided.select(F.col("decided").alias(key), F.col("first").alias(first)), F.col("doc_id") == F.col(key), "left")
    number = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64("text")))
    kept = met.where(F.col(first)).withColumn(rank, number).where(F.col(rank) == 1)
    return clear.unionByName(met.where(F.col(key).isNull()).select(*names)).unionByName(kept.select(*names))


def oracle() -> str:
    """DuckDB SQL for ``join_components`` over ``documents``."""
    return r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
hashed AS (SELECT doc_id, hash(s) AS h FROM shingles),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM hashed a JOIN hashed b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT doc_id AS id, doc_id AS low FROM documents UNION SELECT e.v, r.low FROM reach r JOIN edges e ON e.u = r.id WHERE r.low < e.v)
SELECT d.doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(low) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.id = d.doc_id GROUP BY d.doc_id"""
