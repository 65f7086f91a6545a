"""Aggregates of clean trips: edges, nodes, time cells, histograms, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflux.functions.expressions import capped_bin, daypart, integer_hash, is_weekend, net_flow_index, safe_ratio



def edges(trips: DataFrame, *by: str) -> DataFrame:
    """Trips and sums for each origin, destination and further key; additive over months."""
    return trips.groupBy("o", "d", *by).agg(F.count(F.lit(1)).alias("trips"), F.sum("dist").alias("sum_dist"), F.sum("fare").alias("sum_fare"), F.sum("dur").alias("sum_dur"))


def with_period(trips: DataFrame) -> DataFrame:
    return trips.withColumn("period", daypart(F.col("wd"), F.col("hr")))


def annual(partial: DataFrame, *by: str) -> DataFrame:
    """Partial edges collapsed to (o, d), with trip-weighted means."""
    out = partial.groupBy("o", "d", *by).agg(*[F.sum(c).alias(c) for c in ("trips", "sum_dist", "sum_fare", "sum_dur")])
    return out.withColumns({f"mean_{c}": F.col(f"sum_{c}") / F.col("trips") for c in ("dist", "fare", "dur")})


def zone_hourly(trips: DataFrame) -> DataFrame:
    """Pickups and dropoffs by zone, weekend and hour; zero where one side has none."""
    cell = lambda zone, name: trips.groupBy(F.col(zone).alias("zone_id"), is_weekend(F.col("wd")).alias("weekend"), "hr").agg(F.count(F.lit(1)).alias(name))
    both = cell("o", "pickups").join(cell("d", "dropoffs"), ["zone_id", "weekend", "hr"], "full_outer")
    return both.na.fill(0, ["pickups", "dropoffs"])


def monthly_volume(trips: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(f"sum_{c}") for c in ("fare", "total", "dist", "dur")]
    return trips.groupBy(F.col("mo").alias("month")).agg(F.count(F.lit(1)).alias("trips"), *sums).where("month between 1 and 12")


def hour_weekday(trips: DataFrame) -> DataFrame:
    return trips.groupBy("wd", "hr").agg(F.count(F.lit(1)).alias("trips"))


def cost_duration_histogram(trips: DataFrame, cap: int = 120) -> DataFrame:
    return trips.groupBy(capped_bin(F.col("dur"), cap).alias("dur_bin"), capped_bin(F.col("fare"), cap).alias("fare_bin")).agg(F.count(F.lit(1)).alias("n"))


def hashed_sample(trips: DataFrame, by: str, size: int, *keys: str) -> DataFrame:
    """At most ``size`` rows of each group, those with the smallest integer hash of the keys; the same on every run."""
    order = Window.partitionBy(by).orderBy(integer_hash(*[F.col(k) for k in keys]), *keys)
    return trips.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= size).drop("_n")


def without_loops(edge_table: DataFrame) -> DataFrame:
    return edge_table.where("o <> d")


def above(edge_table: DataFrame, threshold: int) -> DataFrame:
    """Edges with strictly more trips than the threshold."""
    return edge_table.where(F.col("trips") > threshold)


def endpoints(edge_table: DataFrame) -> DataFrame:
    return edge_table.select(F.col("o").alias("id")).union(edge_table.select(F.col("d").alias("id"))).distinct()


def nodes(edge_table: DataFrame, zones: DataFrame) -> DataFrame:
    """Every zone and every active endpoint with strengths, degrees, own trips and net-flow index."""
    proper = without_loops(edge_table)
    out = proper.groupBy(F.col("o").alias("zone_id")).agg(F.sum("trips").alias("out_strength"), F.count(F.lit(1)).alias("out_degree"))
    inn = proper.groupBy(F.col("d").alias("zone_id")).agg(F.sum("trips").alias("in_strength"), F.count(F.lit(1)).alias("in_degree"))
    own = edge_table.where("o = d").select(F.col("o").alias("zone_id"), F.col("trips").alias("self_trips"))
    spine = zones.select("zone_id").union(endpoints(proper).select(F.col("id").alias("zone_id"))).distinct()
    filled = ["out_strength", "out_degree", "in_strength", "in_degree", "self_trips"]
    joined = spine.join(zones, "zone_id", "left").join(out, "zone_id", "left").join(inn, "zone_id", "left").join(own, "zone_id", "left").na.fill(0, filled)
    return joined.withColumn("total_trips", F.col("out_strength") + F.col("in_strength")).withColumn("net_flow_index", net_flow_index(F.col("out_strength"), F.col("in_strength")))


def graph_scalars(edge_table: DataFrame, threshold: int) -> DataFrame:
    """One row: trips, own trips and share, active and filtered nodes and edges, density."""
    loop, strong = F.col("o") == F.col("d"), F.col("trips") > threshold
    totals = edge_table.agg(
        F.sum("trips").alias("total_trips"),
        F.coalesce(F.sum(F.when(loop, F.col("trips"))), F.lit(0)).alias("self_trips"),
        F.count_if(~loop).alias("active_edges"),
        F.count_if(~loop & strong).alias("filtered_edges"),
    )
    ends = without_loops(edge_table).select(F.explode(F.array("o", "d")).alias("id"), strong.alias("strong"))
    sizes = ends.groupBy("id").agg(F.bool_or("strong").alias("strong")).agg(F.count(F.lit(1)).alias("active_nodes"), F.count_if("strong").alias("filtered_nodes"))
    n = F.col("active_nodes")
    return totals.join(sizes).withColumn("self_share_pct", safe_ratio(F.col("self_trips") * 100, F.col("total_trips"))).withColumn("density", safe_ratio(F.col("active_edges"), n * (n - 1)))


def grouping_levels(trips: DataFrame) -> DataFrame:
    """Origin-destination sums at year, month and hour grain in one pass."""
    grains = trips.groupingSets([["o", "d", "yr"], ["o", "d", "yr", "mo"], ["o", "d", "yr", "mo", "hr"]], "o", "d", "yr", "mo", "hr")
    return grains.agg(F.count(F.lit(1)).alias("trips"), F.sum("dist").alias("sum_dist"), F.sum("dur").alias("sum_dur"), F.sum("fare").alias("sum_fare"), F.sum("total").alias("sum_total"))
