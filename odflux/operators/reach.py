"""Who reaches whom: strong components of many graphs at once, and shortest paths from all sources, as joins.

Graphs are told apart by key columns; a loop's round works on all of them together, and finished ones drop out.  Nothing is
held as a matrix, so neither nodes nor graphs are limited; a round moves each edge once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflux.functions.expressions import safe_ratio
from odflux.operators.iterate import Iterates


def strong_components(edges: DataFrame, *by: str, nodes: DataFrame | None = None) -> DataFrame:
    """(by, id, component): the smallest id of each node's strong component, for each graph of ``by``.

    In a round every node takes the smallest id that reaches it and the smallest that it reaches.  Where both are the same,
    that node and this are on a circle: the component is found.  An edge whose ends differ in either joins two components,
    so it goes, and the rest is another round.  The least node left always finds its component, and components that
    nothing joins any more are found together.  ``nodes`` (by, id) adds nodes without edges."""
    keys = list(by)
    steps = Iterates(edges.sparkSession, "strong")
    links = steps.keep("links", edges.where("o <> d").select(*keys, "o", "d").distinct())
    ends = links.select(*keys, F.explode(F.array("o", "d")).alias("id"))
    left = (ends.union(nodes.select(*keys, "id")) if nodes is not None else ends).distinct().select(*keys, "id", F.col("id").alias("fore"), F.col("id").alias("back"))
    left, found = steps.keep("left", left), None
    while True:
        ways = links.select(*keys, F.col("o").alias("a"), F.col("d").alias("b"), F.lit(True).alias("on")).union(links.select(*keys, F.col("d"), F.col("o"), F.lit(False)))
        ways = steps.keep("ways", ways)
        moved = 1
        while moved:
            heard = left.withColumnRenamed("id", "a").join(ways, [*keys, "a"]).groupBy(*keys, F.col("b").alias("id")).agg(F.min(F.when(F.col("on"), F.col("fore"))).alias("f"), F.min(F.when(~F.col("on"), F.col("back"))).alias("r"))
            new = left.select(*keys, "id", "fore", "back").join(heard, [*keys, "id"], "left")
            new = new.select(*keys, "id", F.least("fore", "f").alias("fore"), F.least("back", "r").alias("back"), ((F.col("f") < F.col("fore")) | (F.col("r") < F.col("back"))).alias("moved"))
            left = steps.keep("left", new)
            moved = left.where("moved").limit(1).count()
        done = left.where("fore = back").select(*keys, "id", F.col("fore").alias("component"))
        found = steps.keep("found", done if found is None else found.union(done))
        open_ = left.where("fore <> back").select(*keys, "id", "fore", "back")
        a, b = (open_.select(*keys, F.col("id").alias(c), F.col("fore").alias(f"{c}f"), F.col("back").alias(f"{c}b")) for c in ("o", "d"))
        links = steps.keep("links", links.join(a, [*keys, "o"]).join(b, [*keys, "d"]).where("of = df and ob = db").select(*keys, "o", "d"))
        left = steps.keep("left", open_.select(*keys, "id", F.col("id").alias("fore"), F.col("id").alias("back")))
        if not left.limit(1).count():
            steps.result("found")
            return found


def removal_orders(nodes: DataFrame, seeds: int, *by: str) -> DataFrame:
    """(by, seed, id, place, n): each seed's order of the nodes of each graph, from 0, by a hash that any engine can repeat."""
    from odflux.functions.expressions import integer_hash

    drawn = nodes.select(*by, "id", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    order = Window.partitionBy(*by, "seed").orderBy(integer_hash(F.col("seed") + 42, F.col("id")), "id")
    whole = Window.partitionBy(*by, "seed")
    return drawn.select(*by, "seed", "id", (F.row_number().over(order) - 1).alias("place"), F.count(F.lit(1)).over(whole).alias("n"))


def failure_curves(edges: DataFrame, seeds: int = 20, every: int = 5, *by: str) -> DataFrame:
    """(by, seed, gone, largest, n): nodes in the largest strong component after so many went at random.

    All seeds and steps of all graphs are one frame of edges keyed by them."""
    proper = edges.where("o <> d").select(*by, "o", "d").distinct()
    nodes = proper.select(*by, F.explode(F.array("o", "d")).alias("id")).distinct()
    orders = Iterates(edges.sparkSession, "orders").keep("orders", removal_orders(nodes, seeds, *by))
    last = F.floor((F.col("n") - 1) / every).cast("int")
    alive = orders.select(*by, "seed", "id", "n", F.explode(F.sequence(F.lit(0), last)).alias("step"), "place").select(*by, "seed", (F.col("step") * every).cast("int").alias("gone"), "id", "place", "n").where("place >= gone")
    keys = [*by, "seed", "gone"]
    a = alive.select(*keys, F.col("id").alias("o"))
    b = alive.select(*keys, F.col("id").alias("d"))
    left = a.join(proper, [*by, "o"]).join(b, [*keys, "d"])
    parts = strong_components(left, *keys, nodes=alive.select(*keys, "id")).groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("size"))
    sizes = parts.groupBy(*keys).agg(F.max("size").alias("largest"))
    return sizes.join(orders.select(*by, "seed", "n").distinct(), [*by, "seed"])


def schneider_random(edges: DataFrame, seeds: int = 20, every: int = 5, *by: str) -> DataFrame:
    """(by, schneider_r): mean share of the largest strong component over the steps of random failure, over the seeds."""
    curves = failure_curves(edges, seeds, every, *by)
    return curves.groupBy(*by, "seed").agg(F.avg(F.col("largest") / F.col("n")).alias("r")).groupBy(*by).agg(F.avg("r").alias("schneider_r"))


def shortest_paths(lengths: DataFrame, *by: str) -> DataFrame:
    """(by, o, d, length) of all pairs where d is reached from o, from edges (by, o, d, length) of no negative length.

    Each round lets the pairs that got shorter in the last one take one more edge, and keeps what beats the best known
    length: a pair is worked on again only when it changed."""
    keys = list(by)
    steps = Iterates(lengths.sparkSession, "paths")
    edges = steps.keep("edges", lengths.where("o <> d").groupBy(*keys, "o", "d").agg(F.min("length").alias("length")))
    best = steps.keep("best", edges.select(*keys, "o", "d", "length", F.lit(True).alias("fresh")))
    hop = edges.select(*keys, F.col("o").alias("d"), F.col("d").alias("e"), F.col("length").alias("more"))
    while True:
        offers = best.where("fresh").join(hop, [*keys, "d"]).where("o <> e").groupBy(*keys, "o", F.col("e").alias("d")).agg(F.min(F.col("length") + F.col("more")).alias("offer"))
        merged = best.select(*keys, "o", "d", "length").join(offers, [*keys, "o", "d"], "full_outer")
        shorter = F.col("length").isNull() | (F.col("offer") < F.col("length") * (1 - 1e-12))
        best = steps.keep("best", merged.select(*keys, "o", "d", F.when(shorter, F.col("offer")).otherwise(F.col("length")).alias("length"), F.coalesce(shorter, F.lit(False)).alias("fresh")))
        if not best.where("fresh").limit(1).count():
            steps.result("best")
            return best.drop("fresh")


def path_efficiency(paths: DataFrame, nodes: DataFrame, *by: str) -> DataFrame:
    """(by, n_nodes, efficiency): mean of 1 / length over all ordered pairs of nodes (by, id); unreached pairs count 0."""
    n = nodes.select(*by, "id").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_nodes"))
    total = paths.where("length > 0").groupBy(*by).agg(F.sum(1 / F.col("length")).alias("total"))
    met = n.join(total, list(by), "left") if by else n.join(total)
    return met.select(*by, "n_nodes", safe_ratio(F.coalesce("total", F.lit(0.0)), F.col("n_nodes") * (F.col("n_nodes") - 1)).alias("efficiency"))


def detours(paths: DataFrame, straight: DataFrame) -> DataFrame:
    """(o, d, straight, network, circuity) of reached pairs at a positive distance."""
    return paths.join(straight.where("miles > 0").select("o", "d", F.col("miles").alias("straight")), ["o", "d"]).where("length > 0").select("o", "d", "straight", F.col("length").alias("network"), (F.col("length") / F.col("straight")).alias("circuity"))


def detour_summary(pairs: DataFrame) -> DataFrame:
    """One row: pairs, mean, median, 90th percentile and greatest circuity, and the mean of nodes' straightness."""
    node = straightness(pairs).agg(F.avg("straightness").alias("mean_straightness"))
    q = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("circuity").alias("mean"), F.percentile("circuity", F.lit(0.5)).alias("median"), F.percentile("circuity", F.lit(0.9)).alias("p90"), F.max("circuity").alias("max"))
    return q.join(node)


def straightness(pairs: DataFrame) -> DataFrame:
    """Mean of straight over network length from each node to those that it reaches."""
    return pairs.groupBy(F.col("o").alias("zone_id")).agg(F.avg(F.col("straight") / F.col("network")).alias("straightness"))


def corridors(pairs: DataFrame, k: int = 8, least: float = 0.5) -> DataFrame:
    """The k pairs of most circuity among those at least so far apart."""
    return pairs.where(F.col("straight") >= least).orderBy(F.desc(F.round("circuity", 9)), "o", "d").limit(k)
