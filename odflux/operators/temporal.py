"""Seasonal, weekly and daypart summaries."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflux.functions.expressions import net_flow_index, safe_ratio
from odflux.operators.iterate import Iterates


def seasonality(monthly: DataFrame) -> DataFrame:
    """Peak month, spring (March-May) and later (June-December) means, and the drop between them in percent."""
    avg = lambda a, b: F.avg(F.when(F.col("month").between(a, b), F.col("trips")))
    out = monthly.agg(F.max_by("month", F.struct("trips", -F.col("month"))).alias("peak_month"), avg(3, 5).alias("spring_mean"), avg(6, 12).alias("later_mean"))
    return out.withColumn("drop_pct", safe_ratio((F.col("spring_mean") - F.col("later_mean")) * 100, F.col("spring_mean")))


def week_shares(cells: DataFrame) -> DataFrame:
    """Busiest weekday-hour cell, and the shares of weekday mornings (6-9) and weekend nights (0-4)."""
    share = lambda test: safe_ratio(F.sum(F.when(test, F.col("trips")).otherwise(0)) * 100, F.sum("trips"))
    top = F.max_by(F.struct("wd", "hr"), F.struct("trips", -F.col("wd"), -F.col("hr")))
    return cells.agg(
        top.alias("top"),
        share(F.col("wd").between(0, 4) & F.col("hr").between(6, 9)).alias("weekday_am_pct"),
        share(F.col("wd").between(5, 6) & F.col("hr").between(0, 4)).alias("weekend_night_pct"),
    ).select(F.col("top.wd").alias("busiest_wd"), F.col("top.hr").alias("busiest_hr"), "weekday_am_pct", "weekend_night_pct")


def fare_band(trips: DataFrame, rate: int = 2, low: float = 49.0, high: float = 53.0) -> DataFrame:
    """Quartiles of fares, and the share of one rate code inside a fare band."""
    q = F.percentile("fare", F.lit([0.25, 0.5, 0.75]))
    inside = F.col("fare").between(low, high)
    return trips.agg(q.alias("q"), F.count_if(inside).alias("in_band"), F.avg(F.when(inside, (F.col("rate") == rate).cast("double"))).alias("rate_share")).select(
        F.col("q")[0].alias("fare_q25"), F.col("q")[1].alias("fare_q50"), F.col("q")[2].alias("fare_q75"), "in_band", "rate_share"
    )


def period_strengths(period_edges: DataFrame) -> DataFrame:
    """(zone_id, period, outward, inward) without self-loops."""
    proper = period_edges.where("o <> d")
    sides = F.explode(F.array(F.struct(F.col("o").alias("zone_id"), F.col("trips").alias("outward"), F.lit(0).cast("long").alias("inward")), F.struct(F.col("d").alias("zone_id"), F.lit(0).cast("long").alias("outward"), F.col("trips").alias("inward"))))
    flat = proper.select("period", sides.alias("s")).select("period", "s.*")
    return flat.groupBy("zone_id", "period").agg(F.sum("outward").alias("outward"), F.sum("inward").alias("inward"))


def top_hubs(period_edges: DataFrame, k: int) -> DataFrame:
    """The k zones of each daypart with most inward trips; ties by zone."""
    order = Window.partitionBy("period").orderBy(F.desc("inward"), "zone_id")
    return period_strengths(period_edges).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("period", "rank", "zone_id", "inward")


def hub_overlap(period_edges: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """Jaccard overlap of two dayparts' top hubs."""
    sets = top_hubs(period_edges, k).groupBy("zone_id").agg(F.bool_or(F.col("period") == a).alias("a"), F.bool_or(F.col("period") == b).alias("b"))
    return sets.agg(F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count_if(F.col("a") | F.col("b")).alias("united")).withColumn("jaccard", safe_ratio(F.col("shared"), F.col("united")))


def flow_flip(period_edges: DataFrame, a: str, b: str) -> DataFrame:
    """Net-flow index of each zone in two dayparts, and whether its sign flips."""
    s = period_strengths(period_edges)
    part = lambda c, p: F.sum(F.when(F.col("period") == p, F.col(c)).otherwise(0))
    wide = s.groupBy("zone_id").agg(*[part(c, p).alias(f"{c}_{i}") for i, p in enumerate((a, b)) for c in ("outward", "inward")])
    out = wide.select("zone_id", net_flow_index(F.col("outward_0"), F.col("inward_0")).alias("nfi_a"), net_flow_index(F.col("outward_1"), F.col("inward_1")).alias("nfi_b"))
    return out.withColumn("flips", F.coalesce(F.col("nfi_a") * F.col("nfi_b") < 0, F.lit(False)))


def rank_shift(period_edges: DataFrame, a: str, b: str) -> DataFrame:
    """Average-tie rank by inward trips in two dayparts, descending, and the shift."""
    s = period_strengths(period_edges)
    part = lambda p: F.sum(F.when(F.col("period") == p, F.col("inward")).otherwise(0))
    wide = s.groupBy("zone_id").agg(part(a).alias("a"), part(b).alias("b"))
    rank = lambda c: F.rank().over(Window.orderBy(F.desc(c))) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2.0
    return wide.select("zone_id", rank("a").alias("rank_a"), rank("b").alias("rank_b")).withColumn("shift", F.col("rank_a") - F.col("rank_b"))


def rhythm_profiles(cells: DataFrame, floor: int) -> DataFrame:
    """Weekday pickup profile over the hours of each zone with enough pickups: share by hour."""
    week = cells.where("not weekend").groupBy("zone_id", "hr").agg(F.sum("pickups").alias("pickups"))
    total = F.sum("pickups").over(Window.partitionBy("zone_id"))
    return week.withColumn("total", total).where(F.col("total") >= floor).select("zone_id", "hr", "pickups", safe_ratio(F.col("pickups"), F.col("total")).alias("share"))


def rhythm_clusters(cells: DataFrame, floor: int, k: int = 4, seed: int = 42, inits: int = 10) -> DataFrame:
    """(zone_id, volume, shares, rhythm_cluster): zones clustered by their weekday profile over the 24 hours.

    The best of ``inits`` starts by the squared distances within clusters; clusters are numbered by size, largest first, then
    by the least zone.  Zones below ``floor`` have no row; with fewer than two of them there is one cluster."""
    hours = [str(h) for h in range(24)]
    profile = rhythm_profiles(cells, floor).groupBy("zone_id").pivot("hr", list(range(24))).agg(F.sum("share")).na.fill(0.0)
    volume = cells.where("not weekend").groupBy("zone_id").agg(F.sum("pickups").alias("volume"))
    steps = Iterates(cells.sparkSession, "rhythm")
    stored = steps.keep("profiles", profile.join(volume, "zone_id").select("zone_id", "volume", F.array(*hours).alias("shares")).sortWithinPartitions("zone_id"))
    if stored.limit(2).count() < 2:
        return stored.withColumn("rhythm_cluster", F.lit(0))
    data = stored.withColumn("features", array_to_vector("shares"))
    fitted = [KMeans(k=k, seed=seed + i, maxIter=50, initSteps=5).fit(data) for i in range(inits)]
    best = min(fitted, key=lambda m: m.summary.trainingCost)
    told = best.transform(data).select("zone_id", "volume", "shares", F.col("prediction").alias("_c"))
    order = Window.orderBy(F.desc("n"), "least")  # over k rows
    names = told.groupBy("_c").agg(F.count(F.lit(1)).alias("n"), F.min("zone_id").alias("least")).select("_c", (F.row_number().over(order) - 1).alias("rhythm_cluster"))
    return told.join(F.broadcast(names), "_c").drop("_c")


def describe_rhythms(labelled: DataFrame, examples: int = 5) -> DataFrame:
    """(rhythm_cluster, size, peak_hour, examples): each cluster's zones, the hour of its mean profile's peak, its busiest zones."""
    means = labelled.select("rhythm_cluster", F.posexplode("shares").alias("hr", "share")).groupBy("rhythm_cluster", "hr").agg(F.avg("share").alias("share"), F.count(F.lit(1)).alias("size"))
    peaks = means.groupBy("rhythm_cluster").agg(F.max("size").alias("size"), F.max_by("hr", F.struct("share", -F.col("hr"))).alias("peak_hour"))
    busiest = Window.partitionBy("rhythm_cluster").orderBy(F.desc("volume"), "zone_id")
    top = labelled.select("rhythm_cluster", "zone_id", F.row_number().over(busiest).alias("place")).where(F.col("place") <= examples)
    named = top.groupBy("rhythm_cluster").agg(F.sort_array(F.collect_list(F.struct("place", "zone_id"))).alias("t"))
    return peaks.join(named.select("rhythm_cluster", F.transform("t", lambda t: t["zone_id"]).alias("examples")), "rhythm_cluster")


def forward_fill(series: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last value seen where one is missing, in order, for each key."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return series.withColumn(f"{value}_filled", F.last(value, ignorenulls=True).over(upto))


def mean_by(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.groupBy(*keys).agg(F.avg("trips").alias("mean_trips"))
