"""Centralities by power iteration and peeling, as joins and group sums that scale with the edge count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflux.operators.aggregates import endpoints, without_loops
from odflux.operators.iterate import Iterates, shared_folder
from odflux.operators.structure import undirected


def _cut(df: DataFrame, step: int, every: int = 5) -> DataFrame:
    """Cut the lineage of a loop every few steps, by a checkpoint in the shared folder."""
    if step % every < every - 1:
        return df
    shared_folder(df.sparkSession)
    return df.checkpoint()


def pagerank(edges: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """Weighted PageRank after ``rounds`` rounds from the uniform start; dangling mass is spread evenly."""
    proper = without_loops(edges).select("o", "d", "trips")
    ids = endpoints(proper)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rank = ids.select("id", n.cast("double").alias("n")).withColumn("rank", 1 / F.col("n"))
    share = proper.withColumn("share", F.col("trips") / F.sum("trips").over(Window.partitionBy("o"))).select("o", "d", "share")
    sources = share.select(F.col("o").alias("id")).distinct()
    for step in range(rounds):
        flow = share.join(rank, F.col("o") == F.col("id")).groupBy("d").agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        loose = rank.join(sources, "id", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        merged = rank.select("id", "n").join(flow, F.col("id") == F.col("d"), "left").join(F.broadcast(loose))
        rank = merged.select("id", "n", ((1 - damping) / F.col("n") + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("loose") / F.col("n"))).alias("rank"))
        rank = _cut(rank, step)
    return rank.select(F.col("id").alias("zone_id"), "rank")


def settled_pagerank(edges: DataFrame, damping: float = 0.85, close: float = 1e-6, most: int = 100) -> DataFrame:
    """Weighted PageRank (zone_id, rank): rounds from the uniform start until all ranks together change by less than
    ``close`` times the number of nodes, at most ``most``.  Edges are stored once; the dangling mass and the change are one
    aggregate of a round's ranks."""
    steps = Iterates(edges.sparkSession, "pagerank")
    proper = without_loops(edges).groupBy("o", "d").agg(F.sum("trips").alias("trips"))
    out = proper.groupBy("o").agg(F.sum("trips").alias("out"))
    share = steps.keep("share", proper.join(out, "o").select(F.col("o").alias("id"), "d", (F.col("trips") / F.col("out")).alias("share")))
    ids = steps.keep("ids", endpoints(proper).join(out.select(F.col("o").alias("id"), F.lit(False).alias("loose")), "id", "left").na.fill(True, ["loose"]))
    n, loose = ids.agg(F.count(F.lit(1)), F.count_if("loose")).first()
    rank, loose = steps.keep("rank", ids.select("id", "loose", F.lit(1 / max(1, n)).alias("rank"))), loose / max(1, n)
    for _ in range(most if n else 0):
        flow = share.join(rank.select("id", "rank"), "id").groupBy(F.col("d").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        new = F.lit((1 - damping) / n + damping * loose / n) + damping * F.coalesce("flow", F.lit(0.0))
        rank = steps.keep("rank", rank.select("id", "loose", F.col("rank").alias("last")).join(flow, "id", "left").select("id", "loose", "last", new.alias("rank")))
        loose, change = rank.agg(F.coalesce(F.sum(F.when(F.col("loose"), F.col("rank"))), F.lit(0.0)), F.sum(F.abs(F.col("rank") - F.col("last")))).first()
        if change < close * n:
            break
    steps.result("rank")
    return rank.select(F.col("id").alias("zone_id"), "rank")


#: Steps of a power iteration between two looks at its length and change.
BURST = 3


def _powered(steps: Iterates, start: DataFrame, step: Callable[[DataFrame], DataFrame], close: float, most: int) -> DataFrame:
    """(id, x) of unit length that ``step`` leaves as it is but for its length: a leading vector of a linear map.

    ``step`` maps (id, x) and is taken ``BURST`` times in a plan; lengths are scalars."""
    x = steps.keep("x", start.select("id", "x", F.lit(None).cast("double").alias("last")))
    for _ in range(-(-most // BURST)):
        size = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
        if not size:
            break
        unit = x.select("id", (F.col("x") / size).alias("x"))
        moved = unit
        for _step in range(BURST):
            moved = step(moved)
        x = steps.keep("x", moved.join(unit.withColumnRenamed("x", "last"), "id"))
        size = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
        if not size or x.agg(F.max(F.abs(F.col("x") / size - F.col("last")))).first()[0] < close:
            break
    size = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
    return x.select("id", (F.col("x") / size).alias("x"))


def settled_hits(edges: DataFrame, close: float = 1e-10, most: int = 300) -> DataFrame:
    """(zone_id, hub, authority): the leading singular vectors of the trips matrix, of unit length."""
    steps = Iterates(edges.sparkSession, "hits")
    proper = steps.keep("edges", without_loops(edges).groupBy("o", "d").agg(F.sum("trips").cast("double").alias("trips")))
    ids = steps.keep("ids", endpoints(proper))
    along = lambda x, a, b: proper.join(x, F.col(a) == F.col("id")).groupBy(F.col(b).alias("id")).agg(F.sum(F.col("x") * F.col("trips")).alias("x"))
    whole = lambda x: ids.join(x, "id", "left").select("id", F.coalesce("x", F.lit(0.0)).alias("x"))
    hub = _powered(steps, ids.withColumn("x", F.lit(1.0)), lambda x: whole(along(along(x, "o", "d"), "d", "o")), close, most)
    authority = steps.keep("authority", along(hub, "o", "d"))
    size = authority.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
    both = hub.withColumnRenamed("x", "hub").join(authority.select("id", (F.col("x") / size).alias("authority")), "id", "left")
    out = steps.keep("scores", both.select(F.col("id").alias("zone_id"), "hub", F.coalesce("authority", F.lit(0.0)).alias("authority")))
    steps.result("scores")
    return out


def settled_eigenvector(edges: DataFrame, close: float = 1e-10, most: int = 600) -> DataFrame:
    """(zone_id, eigenvector): in-edge eigenvector centrality of unit length.

    A share of each node's own value is added in a step, which keeps the vector and lets graphs with a period settle."""
    steps = Iterates(edges.sparkSession, "eigenvector")
    proper = steps.keep("edges", without_loops(edges).groupBy("o", "d").agg(F.sum("trips").cast("double").alias("trips")))
    ids = steps.keep("ids", endpoints(proper))
    trips, n = proper.agg(F.coalesce(F.sum("trips"), F.lit(0.0))).first()[0], ids.count()
    own = trips / max(1, n) / 4

    def step(x: DataFrame) -> DataFrame:
        sent = proper.select(F.col("o").alias("id"), "d", "trips").union(ids.select("id", "id", F.lit(own)))
        return sent.join(x, "id").groupBy(F.col("d").alias("id")).agg(F.sum(F.col("x") * F.col("trips")).alias("x"))

    out = steps.keep("scores", _powered(steps, ids.withColumn("x", F.lit(1.0)), step, close, most).select(F.col("id").alias("zone_id"), F.col("x").alias("eigenvector")))
    steps.result("scores")
    return out


def _unit(df: DataFrame, column: str) -> DataFrame:
    size = F.sqrt(F.sum(F.col(column) * F.col(column)).over(Window.partitionBy()))
    return df.withColumn(column, F.coalesce(F.try_divide(F.col(column), size), F.lit(0.0)))


def hits(edges: DataFrame, rounds: int) -> DataFrame:
    """Weighted hub and authority scores after ``rounds`` rounds, of unit length."""
    proper = without_loops(edges).select("o", "d", "trips")
    ids = endpoints(proper)
    hub = ids.withColumn("hub", F.lit(1.0))
    for step in range(rounds):
        auth = _unit(proper.join(hub, F.col("o") == F.col("id")).groupBy("d").agg(F.sum(F.col("hub") * F.col("trips")).alias("auth")), "auth")
        hub = _unit(proper.join(auth, "d").groupBy(F.col("o").alias("id")).agg(F.sum(F.col("auth") * F.col("trips")).alias("hub")), "hub")
        hub = _cut(hub, step)
    out = ids.join(hub, "id", "left").join(auth, F.col("id") == F.col("d"), "left")
    return out.select(F.col("id").alias("zone_id"), F.coalesce("hub", F.lit(0.0)).alias("hub"), F.coalesce("auth", F.lit(0.0)).alias("authority"))


def eigenvector(edges: DataFrame, rounds: int) -> DataFrame:
    """In-edge eigenvector centrality after ``rounds`` rounds, of unit length."""
    proper = without_loops(edges).select("o", "d", "trips")
    ids = endpoints(proper)
    x = ids.withColumn("x", F.lit(1.0))
    for step in range(rounds):
        moved = proper.join(x, F.col("o") == F.col("id")).groupBy("d").agg(F.sum(F.col("x") * F.col("trips")).alias("y"))
        x = _unit(ids.join(moved, F.col("id") == F.col("d"), "left").select("id", F.coalesce("y", F.lit(0.0)).alias("x")), "x")
        x = _cut(x, step)
    return x.select(F.col("id").alias("zone_id"), F.col("x").alias("eigenvector"))


def core_numbers(edges: DataFrame, *by: str) -> DataFrame:
    """k-core number of each node of the undirected simple graph, for each graph of ``by``, by local refinement: a node's
    number is the largest h such that h neighbours have at least h; from the degree down, until nothing changes."""
    keys, steps = list(by), Iterates(edges.sparkSession, "cores")
    proper = without_loops(edges)
    ways = steps.keep("ways", proper.select(*keys, F.col("o").alias("a"), F.col("d").alias("b")).union(proper.select(*keys, "d", "o")).distinct())
    core = steps.keep("core", ways.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("k")).withColumn("moved", F.lit(True)))
    order = Window.partitionBy(*keys, "a").orderBy(F.desc("kb"))
    while core.where("moved").limit(1).count():
        near = ways.join(core.select(*keys, F.col("a").alias("b"), F.col("k").alias("kb")), [*keys, "b"])
        h = near.select(*keys, "a", "kb", F.row_number().over(order).alias("i")).groupBy(*keys, "a").agg(F.max(F.least("i", "kb")).alias("h"))
        core = steps.keep("core", core.select(*keys, "a", "k").join(h, [*keys, "a"]).select(*keys, "a", F.least("k", "h").alias("k"), (F.col("h") < F.col("k")).alias("moved")))
    steps.result("core")
    return core.select(*keys, F.col("a").alias("zone_id"), F.col("k").cast("int").alias("core"))


def weak_components(edges: DataFrame) -> DataFrame:
    """Smallest id that each node reaches over edges in either direction.

    In a round each node takes the smallest label around it, and then the label that this label's node has: chains of
    labels are halved, so rounds grow with the logarithm of the longest path."""
    steps = Iterates(edges.sparkSession, "weak")
    proper = without_loops(edges)
    ways = steps.keep("ways", proper.select(F.col("o").alias("a"), F.col("d").alias("b")).union(proper.select("d", "o")).distinct())
    label = steps.keep("label", ways.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("label"), F.lit(True).alias("moved")))
    while label.where("moved").limit(1).count():
        # the least label around a node is offered to the node, and to the node that its own label names
        around = ways.join(label.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        heard = label.select("id", "label").join(around, "id").select("id", "label", F.least("label", "m").alias("m"))
        offers = heard.select("id", "m").union(heard.select("label", "m")).groupBy("id").agg(F.min("m").alias("m"))
        near = steps.keep("near", label.select("id", F.col("label").alias("old")).join(offers, "id").select("id", "old", F.least("old", "m").alias("label")))
        jump = near.select(F.col("id").alias("label"), F.col("label").alias("far"))
        label = steps.keep("label", near.join(jump, "label").select("id", "far", "old").select("id", F.col("far").alias("label"), (F.col("far") < F.col("old")).alias("moved")))
    steps.result("label")
    return label.select(F.col("id").alias("zone_id"), F.col("label").alias("component"))


def label_propagation(edges: DataFrame, rounds: int) -> DataFrame:
    """Each node takes its neighbours' most frequent label, the smallest among equals, for ``rounds`` rounds."""
    pairs = undirected(edges).select("u", "v")
    ways = pairs.union(pairs.select("v", "u")).toDF("a", "b")
    label = ways.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id"))
    for step in range(rounds):
        votes = ways.join(label, F.col("b") == F.col("id")).groupBy("a", "label").agg(F.count(F.lit(1)).alias("n"))
        label = votes.groupBy(F.col("a").alias("id")).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))
        label = _cut(label, step)
    return label.select(F.col("id").alias("zone_id"), F.col("label").alias("community"))
