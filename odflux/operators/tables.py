"""Assembled tables: the centralities, the structure measures and the node analysis, each joined from its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflux.operators import centrality, network, structure
from odflux.operators.aggregates import endpoints, without_loops
from odflux.operators.iterate import Iterates


def centrality_table(edges: DataFrame) -> DataFrame:
    """One row a node: strengths, PageRank, hub and authority scores, betweenness, eigenvector centrality, all settled.

    The edges are added up and stored once.  An empty edge table gives an empty result."""
    steps = Iterates(edges.sparkSession, "centrality")
    proper = steps.keep("edges", without_loops(edges).groupBy("o", "d").agg(F.sum("trips").alias("trips")))
    strength = lambda end, name: proper.groupBy(F.col(end).alias("zone_id")).agg(F.sum("trips").alias(name))
    out = endpoints(proper).select(F.col("id").alias("zone_id"))
    out = out.join(strength("o", "out_strength"), "zone_id", "left").join(strength("d", "in_strength"), "zone_id", "left").na.fill(0, ["out_strength", "in_strength"])
    scores = (centrality.settled_pagerank(proper).withColumnRenamed("rank", "pagerank"), centrality.settled_hits(proper), network.betweenness(proper), centrality.settled_eigenvector(proper))
    for score in scores:
        out = out.join(score, "zone_id", "left")
    return out


def structure_bundle(edges: DataFrame) -> DataFrame:
    """One row: weighted reciprocity, rho, mean and median imbalance, degree assortativity, largest core number."""
    core = centrality.core_numbers(edges).agg(F.max("core").alias("max_kcore"))
    imbalance = structure.flow_imbalance(edges).select("mean_imbalance", "median_imbalance")
    return structure.weighted_reciprocity(edges).join(structure.reciprocity(edges).select("rho")).join(imbalance).join(structure.assortativity(edges)).join(core)


def node_analysis(edges: DataFrame, nodes: DataFrame, surprise: DataFrame) -> DataFrame:
    """The centrality table with core number, Leiden community, gravity surprise and the attributes of each zone.

    Nodes without a zone row, or whose cells the gravity model expects too little of, have nulls there."""
    steps = Iterates(edges.sparkSession, "nodes")
    edges = steps.keep("edges", edges.groupBy("o", "d").agg(F.sum("trips").alias("trips")))
    core = centrality.core_numbers(edges).withColumnRenamed("core", "coreness")
    part = network.communities(edges, "leiden").select("zone_id", F.col("community").alias("leiden_community"))
    fit = surprise.select("zone_id", F.col("surprise").alias("gravity_surprise"))
    zones = nodes.select("zone_id", "zone", "borough", "service_zone", "net_flow_index", "self_trips")
    out = centrality_table(edges)
    for side in (core, part, fit, zones):
        out = out.join(side, "zone_id", "left")
    return out
