"""Connected components of an edge table, by contraction in tasks and alternating large-star and small-star rounds.

Defined cases: self-loops and edges with a null end are dropped; repeated edges count once; columns other than u and v
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.llm._common import TASK_ROWS, durable, least_heavy, meet, release, settled


def _large_star(edges: DataFrame, least: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")).select("u", F.least("u", "m").alias("m"), "k")
    return meet(both, lowest, "u", least, ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, least: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
    hung = meet(down, lowest, "u", least, ["v"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as (id, smallest id that these edges reach), one row an id."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    for at in range(0, len(ids), 10_000):
        part = ids[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component): each id that has an edge in ``edges`` (u, v), with the smallest id it can reach.

    Each task first contracts its own edges, about ``TASK_ROWS`` of them, to stars.  Where one task has all edges that
    is the answer; else stars of different tasks are joined by rounds that keep at most as many edges as they got; rounds
    grow with the logarithm of the longest path.  Each round's edges are checkpointed.  An id with very many edges is
    spread over tasks.
    """
    pairs = edges.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    (state, count), seal = settled(pairs), None
    while True:
        stars = state.mapInArrow(_contracted, "u long, v long")
        if count <= TASK_ROWS:
            return stars.toDF("id", "component")
        least = least_heavy(2 * count)
        state, count = settled(_small_star(_large_star(durable(stars.where("u <> v")), least), least))
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seal:
            return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seal = now
        release(state.sparkSession)
