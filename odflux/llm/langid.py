"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts is the number of distinct byte n-grams (n = 1..3 of the lower-cased
text, ASCII non-letters as spaces) that both have, over the root of the product of their numbers of distinct n-grams.
Nystroem landmarks, the same number from each language, give an explicit feature map; one-versus-rest kernel ridge
regression over it has one weight vector a language.  As the kernel is linear in n-gram presence, landmarks and weights
fold into one table of (n-gram, language), and a batch is scored by one matrix product.  N-grams are hashed into
``SPACE`` cells, so the model's size is fixed.

The model is fitted on the driver from at most ``ROWS`` labelled rows of each language, chosen by the hash of the id;
rows whose crc32(id) mod 5 is 0 never take part.  Tasks turn the chosen whole texts into presence bits, so a row takes
``SPACE`` / 8 bytes on the driver however long its text; of very many languages each gives fewer rows (``MOST_ROWS``) and
landmarks (``MOST_LANDMARKS``).  Only text and lang are learned from, and only text is scored.

Two more columns tell how far a prediction goes, whatever the number of languages: its margin is the distance of the
two best outputs, halved, and ``known`` is the share of a text's distinct n-grams that some landmark has, which is low for
a script that none is written in.  ``keep_identified`` goes by these.

Defined cases: null text or text without a letter gives ``und`` with score, margin and known 0; with one language every
text with a letter is of it, with margin 1; a null id isn't held out and sorts nowhere; without a labelled row every text is
``und``; repeated rows get equal answers; an empty table gives none; other columns pass ``predict`` untouched, under
whatever names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from odflux.llm._common import fresh, small_batches

ORDERS = (1, 2, 3)
BITS = 17
SPACE = 1 << BITS
ROWS, MOST_ROWS = 300, 4096
LANDMARKS, MOST_LANDMARKS = 40, 512
RIDGE = 1e-3
LEAST_MARGIN, LEAST_KNOWN = 0.05, 0.5
BATCH = 64
UNKNOWN = "und"

_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def cells(text: str) -> np.ndarray:
    """Hash cells of the distinct n-grams of a whole text."""
    b = np.frombuffer(text.lower().encode().translate(_PLAIN), dtype=np.uint8).astype(np.uint32)
    seen = np.zeros(SPACE, dtype=bool)
    code = np.zeros(len(b), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        code = (code[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :] if n > 1 else b
        if len(code) and n in ORDERS:
            seen[((code + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(seen)


def fit(rows: list[tuple[str, np.ndarray]]) -> tuple[list[str], np.ndarray]:
    """Languages and the folded table of (cell, language) from (lang, cells) rows in a fixed order.

    Matrices have a column for each cell that some landmark has; the cells of other rows count for their norms only.
    """
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return [], np.zeros((SPACE + 1, 0), dtype=np.float32)
    each = max(1, min(LANDMARKS, MOST_LANDMARKS // len(langs)))
    marks: list[np.ndarray] = []
    for lang in langs:
        marks += [c for x, c in rows if x == lang][:each]
    used = np.unique(np.concatenate(marks))
    place = np.full(SPACE, -1, dtype=np.int64)
    place[used] = np.arange(len(used))

    def presence(cells: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(cells), len(used)), dtype=np.float32)
        for i, c in enumerate(cells):
            x[i, place[c][place[c] >= 0]] = 1
            x[i] /= np.sqrt(max(len(c), 1))
        return x

    p = presence(marks)
    values, vectors = np.linalg.eigh((p @ p.T).astype(np.float64))
    keep = values > 1e-8 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.concatenate([(presence([c for _, c in rows[at : at + BATCH]]) @ p.T) @ root for at in range(0, len(rows), BATCH)])
    y = np.asarray([[1.0 if lang == k else -1.0 for k in langs] for lang, _ in rows])
    count = {k: sum(lang == k for lang, _ in rows) for k in langs}
    w = np.asarray([len(rows) / (len(langs) * count[lang]) for lang, _ in rows])[:, None]
    z = np.hstack([z, np.ones((len(z), 1))])
    gram = z.T @ (w * z) + RIDGE * len(z) * np.eye(z.shape[1])
    coef = np.linalg.solve(gram, z.T @ (w * y))
    table = np.zeros((SPACE + 1, len(langs)), dtype=np.float32)
    table[used] = p.T @ (root @ coef[:-1]).astype(np.float32)
    table[-1] = coef[-1]
    return langs, table


def training_rows(df: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = ROWS) -> list[tuple[str, np.ndarray]]:
    """Cells of at most ``rows`` rows of each language, those with the smallest id hashes; no row of the held-out fold is read."""
    pool = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h")
    )
    # a share of the hash range that holds three times the rows wanted, so that few texts are ranked
    counts = {r["lang"]: r["n"] for r in pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    rows = max(1, min(rows, MOST_ROWS // len(counts)))
    part = F.lit(1.0)
    for lang, n in counts.items():
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, 3.0 * rows / n))).otherwise(part)
    near = pool.where(F.pmod(F.col("h"), F.lit(1 << 20)) <= part * (1 << 20))
    top = Window.partitionBy("lang").orderBy("h", "t")
    # ranked without the texts, which then meet the chosen few
    ranked = near.select("lang", "h", F.xxhash64("text").alias("t")).withColumn("k", F.row_number().over(top)).where(F.col("k") <= rows).withColumnRenamed("lang", "of")
    chosen = F.broadcast(ranked.groupBy("of", "h", "t").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("times")))
    found = near.withColumn("t", F.xxhash64("text")).join(chosen.withColumnsRenamed({"h": "ch", "t": "ct"}), (F.col("lang") == F.col("of")) & (F.col("h") == F.col("ch")) & (F.col("t") == F.col("ct")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for text in batch.column("text").to_pylist():
                seen = np.zeros(SPACE, dtype=bool)
                if has_letter(text):
                    seen[cells(text)] = True
                bits.append(np.packbits(seen).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("k").cast(pa.int64()), batch.column("times").cast(pa.int64()), pa.array(bits, pa.binary())], ["lang", "k", "times", "bits"])

    kept = found.select("lang", "k", "times", "text").dropDuplicates(["lang", "k"]).mapInArrow(run, "lang string, k long, times long, bits binary").collect()
    out = []
    for r in sorted(kept, key=lambda r: (r["lang"], r["k"])):
        c = np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8)))
        out += [(r["lang"], c)] * (r["times"] if len(c) else 0)
    return out


def predict(
    df: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", names: tuple[str, ...] = ("lang_pred", "score", "margin", "known")
) -> DataFrame:
    """``df`` with the predicted language, its score, margin and known share appended under ``names``."""
    small_batches(df.sparkSession)
    langs, table = model
    shared = df.sparkSession.sparkContext.broadcast(table)
    schema = StructType([*df.schema.fields, StructField(names[0], StringType()), *[StructField(c, DoubleType()) for c in names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value[:-1], shared.value[-1:]
        used = np.flatnonzero(np.abs(weights).sum(axis=1)) if len(langs) else np.zeros(0, dtype=np.int64)
        place = np.full(SPACE, -1, dtype=np.int32)
        place[used] = np.arange(len(used))
        dense = np.ascontiguousarray(weights[used])
        x = np.zeros((BATCH, len(used)), dtype=np.float32)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            pred, (score, margin, known) = [UNKNOWN] * len(texts), np.zeros((3, len(texts)))
            todo = [i for i, t in enumerate(texts) if t and has_letter(t)] if langs else []
            for at in range(0, len(todo), BATCH):
                part = todo[at : at + BATCH]
                x[:] = 0
                norm = np.ones((len(part), 1), dtype=np.float32)
                for k, i in enumerate(part):
                    c = cells(texts[i])
                    norm[k] = np.sqrt(max(len(c), 1))
                    to = place[c]
                    to = to[to >= 0]
                    known[i] = len(to) / max(len(c), 1)
                    x[k, to] = 1
                f = (x[: len(part)] @ dense) / norm + bias
                best = f.argmax(axis=1)
                for k, i in enumerate(part):
                    pred[i] = langs[best[k]]
                top = np.sort(f, axis=1)
                score[part] = np.clip((top[:, -1] + 1) / 2, 0, 1)
                margin[part] = np.clip((top[:, -1] - top[:, -2]) / 2, 0, 1) if len(langs) > 1 else 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(margin), pa.array(known)], [*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    return fit(training_rows(df, id_col, text_col, lang_col))


def keep_identified(docs: DataFrame, least_margin: float = LEAST_MARGIN, least_known: float = LEAST_KNOWN) -> DataFrame:
    """The rows of ``docs`` whose language is told by at least this margin and known share; their columns are left as they are."""
    pred, score, margin, known = names = [fresh(docs, c) for c in ("lang_pred", "lang_score", "lang_margin", "lang_known")]
    found = predict(docs, train(docs), names=names)
    return found.where((F.col(pred) != UNKNOWN) & (F.col(margin) >= least_margin) & (F.col(known) >= least_known)).select(*[F.col(f"`{c}`") for c in docs.columns])


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin, known) for each row."""
    model = train(df, id_col, text_col, lang_col)
    narrow = df.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict(narrow, model).select("doc_id", "held_out", "lang_pred", "score", "margin", "known")
