"""Quality rules: counted base rules and a hashed n-gram logistic regression.

Base rules come from exact counts over the whole text.  The model is a logistic regression over the relative
frequencies of hashed word n-grams (1 and 2 words) and character n-grams (2 to 4 code points), trained on labelled rows;
its logit is calibrated by Platt scaling on a fifth of the sample that the weights haven't seen, and texts are scored
in Arrow batches against a fixed probability threshold.

The model is fitted on the driver from at most ``ROWS`` labelled rows of each class, those with the smallest id hashes;
tasks turn their whole texts into at most 2 x ``SPACE`` frequencies, and weights lie in as many cells, so sizes are
bounded however long a text is.

Defined cases: null text counts as empty (all counts 0, base rules failed); without both classes among the labels the
model keeps everything that passes the base rules; repeated labels of an id count once, the lowest quality first;
labels of unknown ids are ignored; an id with several texts is trained on with the first in order; extra columns pass
``judge`` through untouched, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from odflux.llm._common import fresh, small_batches

BITS = 16
SPACE = 1 << BITS
ROWS = 800
CHUNK = 50
THRESHOLD = 0.3
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: White space of the word rule, and the symbols counted.
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.int64, count=n)
    size = len(names)
    if size == n:
        return 0
    pairs = ids[:-1] * size + ids[1:]
    if size >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * size + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def counts(text: str, raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """The five counts of one text."""
    blanks = len(raw) - len(raw.translate(None, BLANK))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(BLANK)]
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated(words)


def features(text: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all word n-grams, and of all character n-grams, of a whole text, repeats included."""
    shift = np.uint32(32 - BITS)
    w = np.fromiter(map(crc32, words), dtype=np.uint32, count=len(words)) * np.uint32(2654435761)
    two = (w[:-1] * np.uint32(2246822519)) ^ w[1:]
    by_word = np.concatenate([w >> shift, (two * np.uint32(3266489917)) >> shift])
    b = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    parts, code = [], b
    for n in (2, 3, 4):
        code = code[:-1] * np.uint32(1000003) + b[n - 1 :] if len(code) > 1 else code[:0]
        parts.append(((code + np.uint32(n)) * np.uint32(2654435761)) >> shift)
    return by_word, np.concatenate(parts)


def frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells that a whole text has, those of characters after those of words, and the relative frequency of each."""
    cells, values = [], []
    for k, f in enumerate(features(text, text.encode().split())):
        u, c = np.unique(f, return_counts=True)
        cells.append(u.astype(np.int32) + k * SPACE)
        values.append((c / max(len(f), 1)).astype(np.float32))
    return np.concatenate(cells), np.concatenate(values)


def logits(weights: np.ndarray, bias: float, text: str, words: list[bytes]) -> float:
    by_word, by_char = features(text, words)
    out = bias
    if len(by_word):
        out += float(weights[0][by_word].mean())
    if len(by_char):
        out += float(weights[1][by_char].mean())
    return out


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], steps: int = 120) -> tuple[np.ndarray, float, float, float] | None:
    """Weights (2 x SPACE), bias and the two Platt coefficients from (quality, cells, frequencies) rows in a fixed order."""
    if len({r[0] for r in rows}) < 2 or len(rows) < 10:
        return None
    y = np.asarray([r[0] for r in rows], dtype=np.float64)
    held = np.arange(len(rows)) % 5 == 4
    # rows in chunks of at most 256, so that the arrays of a step stay small
    chunks = []
    for at in range(0, len(rows), CHUNK):
        some = rows[at : at + CHUNK]
        sizes = np.asarray([len(r[1]) for r in some])
        chunks.append((slice(at, at + len(some)), np.repeat(np.arange(len(some), dtype=np.uint8), sizes), np.concatenate([r[1] for r in some]), np.concatenate([r[2] for r in some])))
    train = ~held
    share = np.where(y == 1, 0.5 / max(1, (y[train] == 1).sum()), 0.5 / max(1, (y[train] == 0).sum())) * train
    outputs = lambda w, bias: np.concatenate([np.bincount(row, w[column] * value, part.stop - part.start) for part, row, column, value in chunks]) + bias
    w, bias = np.zeros(2 * SPACE), 0.0
    m, v = np.zeros(2 * SPACE + 1), np.zeros(2 * SPACE + 1)
    for t in range(1, steps + 1):
        error = (1 / (1 + np.exp(-np.clip(outputs(w, bias), -30, 30))) - y) * share
        g = np.append(1e-7 * w, error.sum())
        for part, row, column, value in chunks:
            g[:-1] += np.bincount(column, error[part][row] * value, 2 * SPACE)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w -= 1.0 * step[:-1]
        bias -= 0.05 * step[-1]
    z = outputs(w, bias)
    a, b = platt(z[held], y[held])
    return w.reshape(2, SPACE).astype(np.float32), bias, a, b


def platt(z: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of the calibrated logit, by Newton's method with smoothed targets and a small ridge."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([z, np.ones_like(z)], axis=1)
    theta = np.asarray([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.linalg.solve(h, g)
    return float(theta[0]), float(theta[1])


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(quality, cells, frequencies) of at most ``rows`` labelled texts of each class; the chosen ids are bounded, which bounds the broadcast."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = None
    for q in (0, 1):
        top = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = top if chosen is None else chosen.unionByName(top)
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    first = found.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"), F.xxhash64(F.first("doc_id")).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [[x.tobytes() for x in frequencies(t)] for t in batch.column("text").to_pylist()]
            columns = [pa.array([x[k] for x in both], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("h"), batch.column("doc_id").cast(pa.int64()), *columns], ["quality", "h", "doc_id", "cells", "values"])

    kept = first.mapInArrow(run, "quality int, h long, doc_id long, cells binary, values binary").collect()
    kept.sort(key=lambda r: (r["h"], r["doc_id"]))
    return [(r["quality"], np.frombuffer(r["cells"], dtype=np.int32), np.frombuffer(r["values"], dtype=np.float32)) for r in kept]


def judge(df: DataFrame, model: tuple | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with the five counts, base_failed, p_quality and kept appended, under names that ``df`` doesn't have."""
    small_batches(df.sparkSession)
    added = [StructField(fresh(df, c), LongType()) for c in COUNTS]
    added += [StructField(fresh(df, c), kind) for c, kind in (("base_failed", BooleanType()), ("p_quality", DoubleType()), ("kept", BooleanType()))]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            found, failed, p = [], [], []
            for text in batch.column(text_col).to_pylist():
                text = text or ""
                raw = text.encode()
                words = raw.split()
                c = counts(text, raw, words)
                found.append(c)
                failed.append(c[0] < MIN_WORDS or 100 * c[4] > REPEAT_PERCENT * c[0])
                if fitted is None:
                    p.append(1.0)
                else:
                    w, bias, a, b = fitted
                    p.append(1 / (1 + float(np.exp(-np.clip(a * logits(w, bias, text, words) + b, -30, 30)))))
            columns = [pa.array(list(x), pa.int64()) for x in zip(*found)] or [pa.array([], pa.int64())] * 5
            kept = [not f and q >= threshold for f, q in zip(failed, p)]
            columns += [pa.array(failed, pa.bool_()), pa.array(p, pa.float64()), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(f.name for f in added)])

    return df.mapInArrow(run, StructType([*df.schema.fields, *added]))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass; their columns are left as they are."""
    judged = judge(docs, fit(training_rows(docs, labels)))
    return judged.where(F.col(judged.columns[-1])).select(*[F.col(f"`{c}`") for c in docs.columns])


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: counts, base verdict, calibrated probability, verdict."""
    model = fit(training_rows(docs, labels))
    return judge(docs.select("doc_id", "text"), model).drop("text")
