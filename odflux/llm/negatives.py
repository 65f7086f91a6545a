"""Hard negatives by a vantage-point tree over norm-augmented integer vectors.

Each vector gets one more component that brings all to the largest norm, an anchor's is 0: then a larger inner product is a
smaller distance, and a window of scores is an annulus around the anchor.  The top of the tree is fitted on at most
``SAMPLE`` rows and every row is routed down it; a task refines the cells that it reads to leaves of at most ``LEAF`` rows.
A leaf keeps the least and greatest distance of its rows to the vantage points above it.  Anchors go to leaves nearest
first, in doubling waves; those that can't reach the annulus or a better row than those found, by the triangle inequality,
are left out, so the result is exact.

Anchors are searched ``ROUND`` at a time, near ones together: a round's anchors are broadcast, its tasks read only the cells
that the bounds of cells leave to it and keep the best few rows of each search.  No pair of rows is shuffled but those.
Positives are sought in the anchors' own cells first, which bounds how far the other cells may be.

Defined cases: rows with a null id, label, vector or component, or one that isn't finite, take no part; a shorter vector is
filled with zeros; a repeated row counts as often as it occurs, but a repeated anchor is searched once; rows with the
anchor's id are none of its positives or negatives; equal scores are in order of vec_id; other columns are ignored; an
empty table gives an empty result.  Scores are exact below 2**63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflux.llm._common import global_row_number, remove, scratch, written

#: Rows that the top of the tree is fitted on, its most levels, the most rows of a leaf, and rows that a task searches at a time.
SAMPLE, LEVELS, LEAF, TILE = 8192, 8, 512, 1 << 16
#: Anchors of a round.
ROUND = 4096
#: Anchors are the rows whose id is divisible by this; their positives, and the negatives of each; scores are of this scale.
EVERY, POSITIVES, NEGATIVES, SCALE = 50, 5, 3, 256
#: A negative's score is between these hundredths of the positive's.
LOW, HIGH = 50, 95
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part: moved labels, integer components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    label, vec = F.col("label").cast("long"), F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), vec.alias("x")).where("vec_id is not null and label is not null and x is not null").where(F.forall("x", finite))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", moved.alias("label"), F.transform("x", lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


class Space:
    """Vectors brought to one norm, and the tree's fitted top: vantage points and radii in heap order."""

    def __init__(self, norm2: float, kind: str, dims: int):
        self.norm2, self.kind, self.dims = norm2, kind, dims
        self.number = np.float64 if norm2 < 2.0**53 else np.longdouble
        self.slack = 1e-6 * (1 + np.sqrt(norm2))
        self.points, self.radii = np.zeros((0, dims + 1)), np.zeros(0)
        self.reaches: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.c_[x, np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0))]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of lifted rows, or of anchors with 0 as the last component, to lifted rows."""
        return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T), 0))

    def fit(self, x: np.ndarray, levels: int) -> None:
        """Split down to ``levels``; a cell has a vantage point of its own too, which splits nothing but bounds its rows."""
        lifted = self.lift(x)
        self.points, self.radii = np.zeros((2 ** (levels + 1) - 1, self.dims + 1)), np.full(2**levels - 1, np.inf)
        inside = {0: np.arange(len(lifted))}
        for node in range(len(self.points)):
            rows = inside.pop(node)
            near = np.zeros(0)
            if len(rows):
                self.points[node], near = self.split(lifted, rows)
            if node < len(self.radii):
                self.radii[node] = np.median(near) if len(rows) else np.inf
                inside[2 * node + 1], inside[2 * node + 2] = rows[near <= self.radii[node]], rows[near > self.radii[node]]

    def split(self, lifted: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A vantage point at the edge of the rows, and their distances to it."""
        edge = rows[self.apart(lifted[rows], lifted[rows[:1]])[:, 0].argmax()]
        return lifted[edge], self.apart(lifted[rows], lifted[edge][None])[:, 0]

    def route(self, x: np.ndarray) -> np.ndarray:
        """Cell of each row: the leaf of the fitted top that it falls into."""
        node, lifted = np.zeros(len(x), dtype=np.int64), self.lift(x)
        for _ in range(len(self.radii).bit_length()):
            for at in np.unique(node):
                rows = np.flatnonzero(node == at)
                node[rows] = 2 * at + 1 + (self.apart(lifted[rows], self.points[at][None])[:, 0] > self.radii[at])
        return node - len(self.radii)

    def above(self, cell: int) -> list[int]:
        """Vantage points of a cell: its own and those on the way to it."""
        node = cell + len(self.radii)
        out = [node]
        while node:
            node = (node - 1) // 2
            out.append(node)
        return out

    def measure(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Least and greatest distance of each cell's rows to the vantage points above it."""
        for df in batches:
            if len(df):
                lifted, cells = self.lift(self.unpack(df["packed"])), df["cell"].to_numpy()
                for cell in np.unique(cells):
                    near = self.apart(lifted[cells == cell], self.points[self.above(int(cell))])
                    yield pd.DataFrame({"cell": cell, "level": np.arange(near.shape[1] + 1), "least": np.r_[near.min(axis=0), 0], "most": np.r_[near.max(axis=0), 0]})

    def unpack(self, packed: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(packed), dtype=self.kind).reshape(len(packed), self.dims)


class Search:
    """Searches over the tiles that a task reads: each wants the ``k`` best rows of its anchor within a window of scores."""

    def __init__(self, space: Space, anchors: pd.DataFrame, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.space, self.of, self.low, self.high, self.k, self.same = space, of, low, high, k, same
        self.q = space.unpack(anchors["packed"]).astype(space.number)
        self.ids, self.labels = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
        self.lifted = np.c_[self.q.astype(np.float64), np.zeros(len(self.q))]
        self.far = self.space.apart(self.lifted, space.points)
        self.size2 = (self.lifted**2).sum(axis=1) + space.norm2
        self.score = np.full((len(of), k), -np.inf, dtype=space.number)
        self.row = np.full((len(of), k), np.iinfo(np.int64).max)
        self.inner = self.reach(high) - space.slack

    def reach(self, score: np.ndarray) -> np.ndarray:
        """Distance at which a search's anchor has the score."""
        with np.errstate(invalid="ignore"):
            return np.sqrt(np.maximum(self.size2[self.of] - 2 * score.astype(np.float64), 0))

    def outer(self) -> np.ndarray:
        return self.reach(np.maximum(self.low, self.score[:, -1])) + self.space.slack

    def cells(self) -> set[int]:
        """Cells that may have a row for any of the searches."""
        outer, needed = self.outer(), set()
        for cell, (least, most) in self.space.reaches.items():
            far = self.far[:, self.space.above(cell)]
            from_, to = np.maximum(far - most, least - far).max(axis=1, initial=0), (far + most).min(axis=1, initial=np.inf)
            if ((from_[self.of] <= outer) & (to[self.of] >= self.inner)).any():
                needed.add(cell)
        return needed

    def leaves(self, cells: np.ndarray, lifted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Leaves of a tile as (rows, least and greatest distance that any of them can have to each anchor)."""
        for cell in np.unique(cells):
            above = self.space.above(int(cell))
            todo = [(np.flatnonzero(cells == cell), self.far[:, above], self.space.points[above])]
            while todo:
                rows, far, points = todo.pop()
                if len(rows) > LEAF:
                    point, near = self.space.split(lifted, rows)
                    mid = np.median(near)
                    parts = [rows[near <= mid], rows[near > mid]]
                    if not len(parts[1]):
                        parts = np.array_split(rows, 2)
                    more = np.c_[far, self.space.apart(self.lifted, point[None])], np.r_[points, point[None]]
                    todo += [(part, *more) for part in parts]
                    continue
                near = self.space.apart(lifted[rows], points)
                least, most = near.min(axis=0, initial=np.inf), near.max(axis=0, initial=0)
                yield rows, np.maximum(far - most, least - far).max(axis=1, initial=0), (far + most).min(axis=1, initial=np.inf)

    def visit(self, tile: pd.DataFrame) -> None:
        x = self.space.unpack(tile["packed"])
        ids, labels = tile["vec_id"].to_numpy(), tile["label"].to_numpy()
        rows, least, most = zip(*self.leaves(tile["cell"].to_numpy(), self.space.lift(x)))
        least, most = np.stack(least, axis=1), np.stack(most, axis=1)
        place = least.argsort(axis=1, kind="stable").argsort(axis=1)
        start, width = 0, 1
        while start < len(rows):
            turn = (place >= start) & (place < start + width)
            wanted = turn[self.of] & (least[self.of] <= self.outer()[:, None]) & (most[self.of] >= self.inner[:, None])
            for leaf in np.flatnonzero(wanted.any(axis=0)):
                self.scan(np.flatnonzero(wanted[:, leaf]), x[rows[leaf]], ids[rows[leaf]], labels[rows[leaf]])
            start, width = start + width, start + width

    def scan(self, units: np.ndarray, x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Let the rows of a leaf into the best of each search."""
        anchors, at = np.unique(self.of[units], return_inverse=True)
        score = (self.q[anchors] @ x.astype(self.space.number).T)[at]
        fits = (score >= np.maximum(self.low[units], self.score[units, -1])[:, None]) & (score <= self.high[units][:, None])
        fits &= (labels[None] == self.labels[self.of[units]][:, None]) == self.same
        fits &= ids[None] != self.ids[self.of[units]][:, None]
        u, r = np.nonzero(fits)
        if not len(u):
            return
        hit = np.unique(u)
        unit = np.r_[units[u], np.repeat(units[hit], self.k)]
        value = np.r_[score[u, r], self.score[units[hit]].ravel()]
        row = np.r_[ids[r], self.row[units[hit]].ravel()]
        order = np.lexsort((row, -value, unit))
        unit, value, row = unit[order], value[order], row[order]
        first = np.maximum.accumulate(np.where(np.r_[True, unit[1:] != unit[:-1]], np.arange(len(unit)), 0))
        rank = np.arange(len(unit)) - first
        best = rank < self.k
        self.score[unit[best], rank[best]], self.row[unit[best], rank[best]] = value[best], row[best]

    def found(self) -> pd.DataFrame:
        u, r = np.nonzero(np.isfinite(self.score.astype(np.float64)))
        return pd.DataFrame({"unit": u.astype(np.int64), "vec_id": self.row[u, r], "score": self.score[u, r].clip(-(2.0**63), 2.0**63 - 1024).astype(np.int64)})


def _search(index: DataFrame, cells: set[int], sent: Broadcast, k: int, same: bool) -> DataFrame:
    """(unit, vec_id, score, rank): the k best rows of each search in the given cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search, tile = Search(*sent.value, k, same), []
        for df in batches:
            tile.append(df)
            if sum(map(len, tile)) >= TILE:
                search.visit(pd.concat(tile, ignore_index=True))
                tile = []
        if sum(map(len, tile)):
            search.visit(pd.concat(tile, ignore_index=True))
        yield search.found()

    order = Window.partitionBy("unit").orderBy(F.desc("score"), "vec_id")
    return index.where(F.col("cell").isin(sorted(cells))).mapInPandas(run, "unit long, vec_id long, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def build(rows: DataFrame) -> tuple[Space | None, DataFrame | None, str]:
    """The tree's fitted top, every row (cell, vec_id, label, packed) in order of cells, and where they are stored."""
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    widest = F.max(F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0)))
    n, dims, norm2, top = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(size), widest).first()
    if not n:
        return None, None, ""
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    space = Space(norm2, kind, max(1, dims))
    filled = rows.select("vec_id", "label", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(space.dims) - F.size("v"))).alias("v"))
    sample = filled.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v").toPandas()
    space.fit(np.stack(list(sample["v"])), max(0, min(LEVELS, int(np.ceil(np.log2(n / LEAF))))))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                x = np.stack(list(df["v"]))
                yield pd.DataFrame({"cell": space.route(x), "vec_id": df["vec_id"], "label": df["label"], "packed": [r.tobytes() for r in x.astype(kind)]})

    placed = filled.mapInPandas(route, "cell long, vec_id long, label long, packed binary")
    index, path = written(placed.repartitionByRange("cell", F.xxhash64("vec_id")).sortWithinPartitions("cell", F.xxhash64("vec_id")), "vantage")
    reaches = index.mapInPandas(space.measure, "cell long, level int, least double, most double").groupBy("cell", "level").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    for cell, part in reaches.toPandas().sort_values("level").groupby("cell"):
        space.reaches[int(cell)] = (part["least"].to_numpy()[:-1], part["most"].to_numpy()[:-1])
    return space, index, path


def _positives(index: DataFrame, space: Space, near: pd.DataFrame) -> pd.DataFrame:
    """(unit, vec_id, score) of the first positives of a round's anchors, in order."""
    every, endless = np.arange(len(near)), np.full(len(near), np.inf)
    order, spark = ["unit", "score", "vec_id"], index.sparkSession.sparkContext
    first = lambda df: df.sort_values(order, ascending=[True, False, True]).groupby("unit").head(POSITIVES)
    own = set(near["cell"])
    sent = spark.broadcast((space, near, every, -endless, endless))
    found = first(_search(index, own, sent, POSITIVES, True).select(order).toPandas())
    sent.destroy()
    last = found.groupby("unit")["score"].agg(["size", "min"])
    low = -endless
    low[last.index[last["size"] == POSITIVES]] = last["min"][last["size"] == POSITIVES]
    rest = Search(space, near, every, low, endless, POSITIVES, True).cells() - own
    if rest:
        sent = spark.broadcast((space, near, every, low, endless))
        found = first(pd.concat([found, _search(index, rest, sent, POSITIVES, True).select(order).toPandas()]))
        sent.destroy()
    return found.reset_index(drop=True)


def _window(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer score of a negative, for each positive's."""
    exact = [int(p) for p in positive]
    return np.array([-(-LOW * p // 100) for p in exact], dtype=np.float64), np.array([HIGH * p // 100 for p in exact], dtype=np.float64)


def mine(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the hard negatives of every anchor."""
    spark = embeddings.sparkSession
    space, index, path = build(usable(embeddings))
    if space is None:
        return spark.createDataFrame([], RESULT)
    try:
        anchors, total = global_row_number(index.where(F.col("vec_id") % EVERY == 0).distinct(), ["cell", "vec_id", "label", "packed"])
        out = scratch(spark, "negatives")
        spark.createDataFrame([], RESULT).write.parquet(out)
        for first in range(0, total, ROUND):
            near = anchors.where(F.col("row_no").between(first, first + ROUND - 1)).toPandas().sort_values("row_no", ignore_index=True)
            positives = _positives(index, space, near)
            of = positives["unit"].to_numpy()
            low, high = _window(positives["score"].to_numpy())
            units = spark.createDataFrame(pd.DataFrame({"unit": np.arange(len(of)), "anchor_id": near["vec_id"].to_numpy()[of], "positive_id": positives["vec_id"], "positive_score": positives["score"]}), "unit long, anchor_id long, positive_id long, positive_score long")
            sent = spark.sparkContext.broadcast((space, near, of, low, high))
            cells = Search(space, near, of, low, high, NEGATIVES, False).cells()
            negatives = _search(index, cells, sent, NEGATIVES, False).join(F.broadcast(units), "unit")
            negatives.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
            sent.destroy()
    finally:
        remove(spark, path)
    return spark.read.schema(RESULT).parquet(out)


def oracle() -> str:
    """DuckDB SQL for ``mine`` over ``embeddings``: every anchor against every row."""
    return f"""
WITH kept AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM kept a JOIN kept b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN {LOW} * positive_score AND {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= {NEGATIVES}"""
