"""The whole panel of years: every measure of every year, each worked out for all years at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.operators import centrality, evolution, interaction, reach
from odflux.operators.aggregates import without_loops
from odflux.operators.iterate import Iterates


def distance_efficiency(yearly: DataFrame, zones: DataFrame, *by: str) -> DataFrame:
    """(by, efficiency): global efficiency over shortest paths by straight miles; edges without coordinates carry none,
    their ends still count, and centroids at one place are a tiny distance apart."""
    proper = without_loops(yearly)
    far = interaction.with_distance(proper, zones).where("miles is not null")
    paths = reach.shortest_paths(far.select(*by, "o", "d", F.greatest("miles", F.lit(1e-9)).alias("length")), *by)
    nodes = proper.select(*by, F.explode(F.array("o", "d")).alias("id"))
    return reach.path_efficiency(paths, nodes, *by).drop("n_nodes")


def structure_panel(yearly: DataFrame, zones: DataFrame, seeds: int = 20, every: int = 5) -> DataFrame:
    """The relational panel of edges keyed by yr, with the largest core number, efficiency by distance and Schneider's R."""
    core = centrality.core_numbers(yearly, "yr").groupBy("yr").agg(F.max("core").alias("max_kcore"))
    efficiency = distance_efficiency(yearly, zones, "yr").withColumnRenamed("efficiency", "global_efficiency")
    robust = reach.schneider_random(yearly, seeds, every, "yr")
    out = evolution.panel(yearly)
    for part in (core, efficiency, robust):
        out = out.join(part, "yr", "left")
    return out


def full_panel(yearly: DataFrame, zones: DataFrame, members: DataFrame, low: float = 0.2) -> DataFrame:
    """``structure_panel`` with the calibrated gravity model, the communities (yr, zone_id, community) and the top hubs of
    each year.  Edges are stored once for all of it."""
    yearly = Iterates(yearly.sparkSession, "panel").keep("edges", yearly)
    gravity = interaction.calibrate(yearly, zones, "yr", low=low).select("yr", F.col("beta").alias("gravity_beta"), F.col("cpc").alias("gravity_cpc"))
    count = members.groupBy("yr").agg(F.count_distinct("community").alias("n_communities"))
    pairs = without_loops(yearly).groupBy("yr", F.least("o", "d").alias("u"), F.greatest("o", "d").alias("v")).agg(F.sum("trips").alias("trips"))
    quality = evolution.modularity(pairs, members, "yr").withColumnRenamed("modularity", "modularity_q")
    hubs = evolution.hub_shares(yearly, 3).join(zones.select("zone_id", "zone"), "zone_id", "left")
    named = hubs.groupBy("yr").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "zone_id", "zone", "inward"))), lambda h: F.concat_ws(":", h["zone_id"], h["zone"], h["inward"])), ",").alias("top_hubs"))
    out = structure_panel(yearly, zones)
    for part in (gravity, count, quality, named):
        out = out.join(part, "yr", "left")
    return out
