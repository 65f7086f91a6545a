"""Structure measures of the directed weighted graph (self-loops always left out)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflux.functions.expressions import safe_corr, safe_ratio
from odflux.operators.aggregates import endpoints, without_loops


def undirected(edges: DataFrame) -> DataFrame:
    """Unordered pairs with both directions' trips added."""
    return without_loops(edges).groupBy(F.least("o", "d").alias("u"), F.greatest("o", "d").alias("v")).agg(F.sum("trips").alias("trips"))


def with_reverse(edges: DataFrame) -> DataFrame:
    """Each edge with the trips of its reverse, null where there is none."""
    e = without_loops(edges).select("o", "d", "trips")
    back = e.select(F.col("d").alias("o"), F.col("o").alias("d"), F.col("trips").alias("back"))
    return e.join(back, ["o", "d"], "left")


def weighted_reciprocity(edges: DataFrame) -> DataFrame:
    both = with_reverse(edges)
    return both.agg(safe_ratio(F.sum(F.least("trips", F.coalesce("back", F.lit(0)))), F.sum("trips")).alias("weighted_reciprocity"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """Share of links with a reverse, link density, and their correlation coefficient rho."""
    n = endpoints(without_loops(edges)).agg(F.count(F.lit(1)).alias("n"))
    links = with_reverse(edges).agg(F.count(F.lit(1)).alias("links"), F.count("back").alias("mutual"))
    out = links.join(n).select("links", "n", safe_ratio(F.col("mutual"), F.col("links")).alias("r"), safe_ratio(F.col("links"), F.col("n") * (F.col("n") - 1)).alias("density"))
    return out.withColumn("rho", F.try_divide(F.col("r") - F.col("density"), 1 - F.col("density")))


def flow_imbalance(edges: DataFrame) -> DataFrame:
    """Mean and median of |a - b| / (a + b) over unordered pairs with trips both ways."""
    pairs = with_reverse(edges).where("o < d and back is not null")
    x = F.abs(F.col("trips") - F.col("back")) / (F.col("trips") + F.col("back"))
    return pairs.select(x.alias("x")).agg(F.count(F.lit(1)).alias("pairs"), F.avg("x").alias("mean_imbalance"), F.median("x").alias("median_imbalance"))


def degrees(edges: DataFrame) -> DataFrame:
    proper = without_loops(edges)
    out = proper.groupBy(F.col("o").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    inn = proper.groupBy(F.col("d").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return out.join(inn, "id", "full_outer").na.fill(0)


def assortativity(edges: DataFrame) -> DataFrame:
    """Correlation over edges of the source's out-degree with the target's in-degree; null where either is the same on every edge."""
    deg = degrees(edges)
    e = without_loops(edges).join(deg.select(F.col("id").alias("o"), "out_degree"), "o").join(deg.select(F.col("id").alias("d"), "in_degree"), "d")
    return e.agg(safe_corr(F.col("out_degree"), F.col("in_degree")).alias("assortativity"))


def kappa(edges: DataFrame) -> DataFrame:
    """Density, mean degree and the ratio of its second to its first moment, on total degree."""
    k = degrees(edges).select((F.col("out_degree") + F.col("in_degree")).cast("double").alias("k"))
    n = F.count(F.lit(1))
    return k.agg(n.alias("nodes"), F.avg("k").alias("mean_degree"), safe_ratio(F.avg(F.col("k") * F.col("k")), F.avg("k")).alias("kappa"), safe_ratio(F.sum("k") / 2, n * (n - 1)).alias("density"))


def transitivity(edges: DataFrame) -> DataFrame:
    """Closed over all triads of the undirected simple graph.  Pairs go from lower to higher degree, so hubs open few triads."""
    pairs = undirected(edges).select("u", "v")
    deg = pairs.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    keyed = pairs.join(deg.select(F.col("id").alias("u"), F.col("k").alias("ku")), "u").join(deg.select(F.col("id").alias("v"), F.col("k").alias("kv")), "v")
    down = F.struct("ku", "u") <= F.struct("kv", "v")
    way = keyed.select(F.when(down, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(down, F.col("v")).otherwise(F.col("u")).alias("b"))
    open_ = way.join(way.select("a", F.col("b").alias("c")), "a").where("b < c")
    closed = open_.join(pairs, (F.col("b") == F.col("u")) & (F.col("c") == F.col("v"))).agg(F.count(F.lit(1)).alias("triangles"))
    triads = deg.agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).cast("long").alias("triads"))
    return closed.join(triads).withColumn("transitivity", safe_ratio(F.col("triangles") * 3, F.col("triads")))


def backbone(edges: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Disparity filter: significance of each edge from either end; a node with one edge keeps it."""
    e = without_loops(edges).select("o", "d", "trips")
    side = lambda c: F.pow(1 - F.col("trips") / F.sum("trips").over(Window.partitionBy(c)), F.count(F.lit(1)).over(Window.partitionBy(c)) - 1)
    alone = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c)) == 1
    score = lambda c: F.when(alone(c), 0.0).otherwise(side(c))
    return e.withColumn("alpha", F.least(score("o"), score("d"))).withColumn("keep", F.col("alpha") < alpha)


def backbone_share(edges: DataFrame, threshold: int, alpha: float = 0.05) -> DataFrame:
    """Edges and trip share of the backbone, of the threshold, and of both."""
    b = backbone(edges, alpha)
    strong = F.col("trips") > threshold
    share = lambda test: safe_ratio(F.coalesce(F.sum(F.when(test, F.col("trips"))), F.lit(0)), F.sum("trips"))
    return b.agg(
        F.count_if("keep").alias("backbone_edges"),
        F.count_if(strong).alias("threshold_edges"),
        F.count_if(F.col("keep") & strong).alias("both_edges"),
        share(F.col("keep")).alias("backbone_share"),
        share(strong).alias("threshold_share"),
    )


def with_geometry(edges: DataFrame, zones: DataFrame) -> DataFrame:
    """Edges whose ends both have coordinates."""
    known = zones.where("cx_ft is not null and cy_ft is not null").select("zone_id")
    return edges.join(known, edges["o"] == known["zone_id"], "left_semi").join(known, edges["d"] == known["zone_id"], "left_semi")


def without_geometry(edges: DataFrame, zones: DataFrame) -> DataFrame:
    """Edges with an end that has no coordinates."""
    known = zones.where("cx_ft is not null and cy_ft is not null").select(F.col("zone_id").alias("known"))
    a = edges.join(known, F.col("o") == F.col("known"), "left_anti")
    b = edges.join(known, F.col("o") == F.col("known"), "left_semi").join(known, F.col("d") == F.col("known"), "left_anti")
    return a.unionByName(b)


def rich_club(edges: DataFrame, percentile: float) -> DataFrame:
    """Trips among the nodes of at least the percentile's strength, over the trips of as many strongest pairs.

    Every pair of rich nodes counts, with trips or without.  The strongest pairs are summed over the table of distinct trip
    counts, so no task sorts all pairs."""
    pairs = undirected(edges)
    strength = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("id"), "trips"), F.struct(F.col("v").alias("id"), "trips"))).alias("x")).groupBy("x.id").agg(F.sum("x.trips").alias("s"))
    cut = strength.agg(F.percentile("s", F.lit(percentile)).alias("cut"))
    rich = strength.join(F.broadcast(cut), F.col("s") >= F.col("cut")).select("id")
    a = pairs.join(rich, F.col("u") == F.col("id"), "left_semi").join(rich, F.col("v") == F.col("id"), "left_semi")
    n = F.count(F.lit(1))
    room = rich.agg((n * (n - 1) / 2).cast("long").alias("pairs"))
    inside = room.join(a.agg(F.coalesce(F.sum("trips"), F.lit(0)).alias("rich_trips")))
    weights = pairs.groupBy("trips").agg(n.alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("trips")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.greatest(F.least("n", F.col("pairs") - F.col("before")), F.lit(0))
    best = weights.withColumn("before", before).join(F.broadcast(room)).agg(F.coalesce(F.sum(F.col("trips") * taken), F.lit(0)).alias("best_trips"))
    return inside.join(best).withColumn("phi", safe_ratio(F.col("rich_trips"), F.col("best_trips")))
