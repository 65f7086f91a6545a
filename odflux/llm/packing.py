"""Packing into length buckets that minimise padding.

The global histogram of token counts goes to the driver; dynamic programming over it finds the ``buckets`` boundaries
whose total padding is least.  Rows then get a rank inside their bucket and form batches of at most ``budget`` tokens
after padding.

The histogram has a row for each distinct token count.  Their sum is at most the number of all tokens, so there are
fewer than the square root of twice that number; the dynamic program takes time and memory in proportion to them.

Defined cases: null or blank text has 0 tokens and goes to the first bucket; a null id sorts first; repeated rows
each get a slot of their own; texts beyond the budget form batches of one; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflux.llm._common import WORD, durable, global_row_number


def token_count(text: str = "text") -> Column:
    """Words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Indices of the last length of each bucket; ``lengths`` ascending, the last index always among them.

    Minimises the sum over buckets of (rows in it) * (its longest length), which is padding plus a constant.  For each
    number of buckets, the best cost up to ``j`` is ``lengths[j] * upto[j]`` plus the least of the lines
    ``best[i] - upto[i] * lengths[j]``, i < j: slopes fall and lengths rise, so a hull of lines is walked once.
    """
    size = len(lengths)
    upto = list(accumulate(counts))
    best = [n * u for n, u in zip(lengths, upto)]
    came: list[list[int]] = []
    for _ in range(min(buckets, size) - 1):
        hull: list[int] = []
        front, new, source = 0, list(best), [-1] * size
        for j in range(1, size):
            c = j - 1
            while len(hull) - front >= 2:
                a, b = hull[-2], hull[-1]
                if (best[c] - best[a]) * (upto[b] - upto[a]) > (best[b] - best[a]) * (upto[c] - upto[a]):
                    break
                hull.pop()
            hull.append(c)
            at = lambda i: best[i] - upto[i] * lengths[j]  # noqa: B023, E731
            while front + 1 < len(hull) and at(hull[front + 1]) < at(hull[front]):
                front += 1
            if (cost := lengths[j] * upto[j] + at(hull[front])) < best[j]:
                new[j], source[j] = cost, hull[front]
        came.append(source)
        best = new
    out, j = [size - 1], size - 1
    for step in reversed(came):
        if step[j] >= 0:
            j = step[j]
            out.append(j)
    return sorted(out)


def pack(df: DataFrame, buckets: int = 8, budget: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, n_tokens, bucket, bucket_length, padding, batch, slot.

    ``batch`` counts from 0 inside the bucket; (bucket, batch, slot) is unique.
    """
    # texts are counted once: histogram, range sample and placement all read these narrow rows
    narrow = durable(
        df.select(
            F.col(id_col).alias("doc_id"),
            token_count(text_col).alias("n_tokens"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"),
        )
    )
    histogram = narrow.groupBy(F.greatest("n_tokens", F.lit(1)).alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()
    if not histogram:
        histogram = [{"length": 1, "n": 0}]
    lengths = [r["length"] for r in histogram]
    counts = [r["n"] for r in histogram]
    ends = best_boundaries(lengths, counts, buckets)
    tops = [lengths[i] for i in ends]
    upto = list(accumulate(counts))
    starts = [0] + [upto[i] for i in ends[:-1]]
    per_batch = [max(1, budget // top) for top in tops]

    def pick(values: list[int]) -> Column:
        out = F.lit(values[-1]).cast("long")
        for b in range(len(values) - 2, -1, -1):
            out = F.when(F.col("bucket") <= b, F.lit(values[b]).cast("long")).otherwise(out)
        return out

    bucket = F.lit(len(tops) - 1)
    for b in range(len(tops) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= tops[b], F.lit(b)).otherwise(bucket)
    ranked, _ = global_row_number(narrow.withColumn("bucket", bucket.cast("int")), ["bucket", "doc_id", "_h"])
    return (
        ranked.withColumn("_rank", F.col("row_no") - pick(starts))
        .withColumn("bucket_length", pick(tops))
        .withColumn("_per", pick(per_batch))
        .select(
            "doc_id",
            "n_tokens",
            "bucket",
            "bucket_length",
            (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
            F.expr("_rank div _per").cast("long").alias("batch"),
            (F.col("_rank") % F.col("_per")).cast("long").alias("slot"),
        )
    )
