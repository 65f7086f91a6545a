"""Queries by kernels, models and streams: no SQL for another engine exists; the tests hold them to invariants."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from odflux.operators import aggregates as A
from odflux.operators import evolution, interaction, network, spatial, structure, tables, temporal
from odflux.plans.catalog import clean_orders, order_edges, order_furness, order_nodes, order_residuals, query, rounded
from odflux.sources import sinks, views


def _sparse(spark, sf_dir):
    return views.sparse_edges(spark, sf_dir, 60)


@query()
def betweenness(spark, sf_dir):
    return network.betweenness(_sparse(spark, sf_dir))


@query()
def betweenness_load(spark, sf_dir):
    return network.betweenness(order_edges(spark, sf_dir), normalised=False)


@query()
def efficiency(spark, sf_dir):
    return network.path_efficiency(_sparse(spark, sf_dir))


@query()
def local_efficiency(spark, sf_dir):
    return network.local_efficiency(order_edges(spark, sf_dir))


@query()
def static_attacks(spark, sf_dir):
    return network.targeted_attacks(_sparse(spark, sf_dir))


@query()
def random_failure(spark, sf_dir):
    return network.random_failure(_sparse(spark, sf_dir), 100, 20)


@query()
def recomputed_attack(spark, sf_dir):
    return network.recomputed_attack(_sparse(spark, sf_dir))


@query()
def schneider_critical_f(spark, sf_dir):
    return network.sweep_summary(network.targeted_attacks(order_edges(spark, sf_dir)))


@query()
def attack_against_failure(spark, sf_dir):
    edges = _sparse(spark, sf_dir)
    return rounded(network.attack_gap(network.targeted_attacks(edges).unionByName(network.recomputed_attack(edges)), network.random_failure(edges, 100, 20)))


@query()
def cascade(spark, sf_dir):
    return network.cascades(order_edges(spark, sf_dir), [0.0, 0.1, 0.2, 0.5, 1.0, 2.0])


@query()
def capacity_ladder(spark, sf_dir):
    load = network.betweenness(order_edges(spark, sf_dir), normalised=False)
    return load.withColumns({f"capacity_a{str(a).replace('.', '_')}": F.col("betweenness") * (1 + a) for a in (0.1, 0.5, 1.0)})


@query()
def louvain(spark, sf_dir):
    return network.communities(order_edges(spark, sf_dir), "louvain")


@query()
def leiden(spark, sf_dir):
    return network.communities(order_edges(spark, sf_dir), "leiden")


@query()
def greedy_modularity(spark, sf_dir):
    return network.communities(order_edges(spark, sf_dir), "greedy")


@query()
def infomap(spark, sf_dir):
    return network.communities(order_edges(spark, sf_dir), "infomap")


@query()
def resolution_sweep(spark, sf_dir):
    return network.resolution_sweep(order_edges(spark, sf_dir), [0.5, 0.75, 1.0, 1.25, 1.5, 2.0])


@query()
def seed_stability(spark, sf_dir):
    return network.seed_stability(order_edges(spark, sf_dir), 100)


@query()
def modularity_significance(spark, sf_dir):
    return network.modularity_significance(order_edges(spark, sf_dir), 200)


@query()
def rich_club_null(spark, sf_dir):
    return network.rich_club_null(order_edges(spark, sf_dir), [50, 70, 80, 90, 95], 50)


@query()
def null_er(spark, sf_dir):
    return network.null_models(_sparse(spark, sf_dir), "er", 100)


@query()
def null_config(spark, sf_dir):
    return network.null_models(_sparse(spark, sf_dir), "configuration", 100)


@query()
def null_weight_permuted(spark, sf_dir):
    return network.null_models(_sparse(spark, sf_dir), "weights", 100)


def _strengths(spark, sf_dir) -> dict[str, np.ndarray]:
    """Strengths of a graph whose node number is fixed by its classes, not by the data."""
    e = A.without_loops(views.sparse_edges(spark, sf_dir, 200))
    out = e.groupBy("o").agg(F.sum("trips").alias("s")).toPandas()["s"].to_numpy()
    inn = e.groupBy("d").agg(F.sum("trips").alias("s")).toPandas()["s"].to_numpy()
    return {"out_strength": out, "in_strength": inn}


@query()
def powerlaw_fit(spark, sf_dir):
    return network.tail_fits(_strengths(spark, sf_dir), spark)


@query()
def powerlaw_gof(spark, sf_dir):
    return network.tail_goodness(_strengths(spark, sf_dir)["in_strength"], spark, 1000)


@query()
def vuong(spark, sf_dir):
    return network.tail_comparisons(_strengths(spark, sf_dir)["in_strength"], spark, 1000)


@query()
def morans_i_permutation(spark, sf_dir):
    nodes = order_nodes(spark, sf_dir).where("cx_ft is not null").select("zone_id", F.col("total_trips").cast("double").alias("value"))
    return network.morans_p(nodes, interaction.nearest(views.zones(spark, sf_dir), 6), 999)


@query()
def gravity_calibrated(spark, sf_dir):
    return network.calibrate(order_edges(spark, sf_dir), interaction.pair_distances(views.zones(spark, sf_dir)))


@query()
def poisson_gravity(spark, sf_dir):
    return interaction.poisson_gravity(order_edges(spark, sf_dir), views.zones(spark, sf_dir))


@query()
def rhythm_kmeans(spark, sf_dir):
    """Clusters of the hourly profiles of users, with their size and peak hour."""
    events = views.read(spark, sf_dir, "events").select(F.col("user_id").alias("zone_id"), F.hour("ts").alias("hr"), F.lit(False).alias("weekend"))
    cells = events.groupBy("zone_id", "hr", "weekend").agg(F.count(F.lit(1)).alias("pickups"))
    profile = temporal.rhythm_profiles(cells, 20).groupBy("zone_id").pivot("hr", list(range(24))).agg(F.sum("share")).na.fill(0.0)
    hours = [str(h) for h in range(24)]
    data = profile.select("zone_id", array_to_vector(F.array(*hours)).alias("features"), F.array(*hours).alias("shares"))
    fitted = KMeans(k=4, seed=42, maxIter=50, initSteps=5).fit(data).transform(data)
    means = fitted.select("prediction", F.posexplode("shares").alias("hr", "share")).groupBy("prediction", "hr").agg(F.avg("share").alias("share"), F.count(F.lit(1)).alias("size"))
    return means.groupBy(F.col("prediction").alias("cluster")).agg(F.max("size").alias("size"), F.max_by("hr", F.struct("share", -F.col("hr"))).alias("peak_hour"))


def yearly_members(spark, sf_dir):
    """Leiden communities of each year: years run in parallel, one year's zone graph a group."""
    from odflux.kernels import graph as G

    yearly = A.edges(clean_orders(spark, sf_dir), "yr").where("o <> d").select("yr", "o", "d", "trips")

    def of(df):
        ids = np.unique(df[["o", "d"]].to_numpy())
        t = np.zeros((len(ids), len(ids)))
        t[np.searchsorted(ids, df["o"]), np.searchsorted(ids, df["d"])] = df["trips"]
        out = df.iloc[:0][["yr"]].reindex(range(len(ids)))
        out["yr"], out["zone_id"], out["community"] = int(df["yr"].iloc[0]), ids, G.louvain(t + t.T, 42, refine=True)
        return out

    return yearly.groupBy("yr").applyInPandas(of, "yr int, zone_id long, community int")


@query()
def community_alignment(spark, sf_dir):
    return rounded(evolution.alignment(yearly_members(spark, sf_dir)))


@query()
def modularity_of_leiden(spark, sf_dir):
    edges = order_edges(spark, sf_dir)
    part = network.communities(edges, "leiden").select("zone_id", "community")
    return rounded(evolution.modularity(structure.undirected(edges), part))


@query()
def results_document(spark, sf_dir):
    edges = order_edges(spark, sf_dir)
    return sinks.results_document({"reciprocity": rounded(structure.reciprocity(edges)), "scalars": rounded(A.graph_scalars(edges, 15))})


@query()
def centrality_table(spark, sf_dir):
    return rounded(tables.centrality_table(_sparse(spark, sf_dir)))


@query()
def node_analysis(spark, sf_dir):
    surprise = interaction.surprise(order_residuals(spark, sf_dir))
    return rounded(tables.node_analysis(order_edges(spark, sf_dir), order_nodes(spark, sf_dir), surprise))


def user_hours(spark, sf_dir):
    """Events of each user by hour, those of weekends apart."""
    events = views.read(spark, sf_dir, "events").select(F.col("user_id").alias("zone_id"), F.hour("ts").alias("hr"), (F.weekday("ts") >= 5).alias("weekend"))
    return events.groupBy("zone_id", "hr", "weekend").agg(F.count(F.lit(1)).alias("pickups"))


@query()
def rhythm_labels(spark, sf_dir):
    """The cluster of each user's weekday hours; the events' own places are too few to be clustered."""
    return rounded(temporal.rhythm_clusters(user_hours(spark, sf_dir), 20).drop("shares"))


@query()
def rhythm_summary(spark, sf_dir):
    return temporal.describe_rhythms(temporal.rhythm_clusters(user_hours(spark, sf_dir), 20))


def _squares(spark, side: float, columns: int, first: int = 0):
    """Square polygons on a grid, numbered by row and column."""
    n = spark.range(columns * columns)
    x, y = (F.col("id") % columns) * side, F.floor(F.col("id") / columns) * side
    return n.select((F.col("id") + first).alias("poly_id"), F.array(x, x + side, x + side, x).cast("array<double>").alias("xs"), F.array(y, y, y + side, y + side).cast("array<double>").alias("ys"))


@query()
def point_in_polygon(spark, sf_dir):
    points = views.zones(spark, sf_dir).where("cx_ft is not null").select(F.col("zone_id").cast("long").alias("point_id"), (F.col("cx_ft") + 1).alias("x"), (F.col("cy_ft") + 1).alias("y"))
    return spatial.point_in_polygon(points, _squares(spark, 26400.0, 6), 26400.0)


@query()
def polygons_intersect(spark, sf_dir):
    return spatial.polygons_intersect(_squares(spark, 30000.0, 4), _squares(spark, 21000.0, 6), 30000.0)


@query()
def dissolve(spark, sf_dir):
    cells = views.zones(spark, sf_dir).where("cx_ft is not null").select("borough", (F.col("cx_ft") / 5280).cast("long").alias("x"), (F.col("cy_ft") / 5280).cast("long").alias("y")).dropDuplicates(["x", "y"])
    return spatial.dissolve(cells, "borough")
