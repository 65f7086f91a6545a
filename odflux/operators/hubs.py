"""Hub rankings of the node table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflux.functions.expressions import safe_ratio


def hub_asymmetry(nodes: DataFrame) -> DataFrame:
    """Inward and outward trips for each partner, and their ratio."""
    out = nodes.select("zone_id", "zone", "in_strength", "in_degree", "out_strength", "out_degree")
    out = out.withColumn("trips_per_source", safe_ratio(F.col("in_strength"), F.col("in_degree"))).withColumn("trips_per_dest", safe_ratio(F.col("out_strength"), F.col("out_degree")))
    return out.withColumn("asymmetry", safe_ratio(F.col("trips_per_source"), F.col("trips_per_dest")))


def periphery_rank(nodes: DataFrame, borough: str, floor: int) -> DataFrame:
    """Zones of a borough by trips per source, ascending: competition rank, and average rank over count."""
    scored = hub_asymmetry(nodes.where((F.col("borough") == borough) & (F.col("in_strength") >= floor))).select("zone_id", "zone", "trips_per_source")
    rank = F.rank().over(Window.orderBy("trips_per_source"))
    ties = F.count(F.lit(1)).over(Window.partitionBy("trips_per_source"))
    return scored.withColumn("rank", rank).withColumn("pct_rank", (F.col("rank") + (ties - 1) / 2.0) / F.count(F.lit(1)).over(Window.partitionBy()))


def named_hubs(nodes: DataFrame, names: list[str]) -> DataFrame:
    """For each pattern the matching zone with most inward trips."""
    patterns = nodes.sparkSession.createDataFrame([(n,) for n in names], "pattern string")
    hits = nodes.join(F.broadcast(patterns), F.lower("zone").contains(F.lower("pattern")))
    first = Window.partitionBy("pattern").orderBy(F.desc("in_strength"), "zone_id")
    return hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("pattern", "zone_id", "zone", "in_strength")


def extremes(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """The k smallest and k largest rows by a column, each once, with the end they come from."""
    low = df.orderBy(by, tie).limit(k).withColumn("end", F.lit("low"))
    high = df.orderBy(F.desc(by), tie).limit(k).withColumn("end", F.lit("high"))
    return low.unionByName(high.join(low.select(tie), tie, "left_anti"))


def strength_curve(nodes: DataFrame, column: str) -> DataFrame:
    """Rank and complementary cumulative share of a column's values, largest first."""
    order = Window.orderBy(F.desc(column), "zone_id")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return nodes.select("zone_id", column, F.row_number().over(order).alias("rank"), n.alias("n")).withColumn("ccdf", safe_ratio(F.col("rank"), F.col("n"))).drop("n")


def concentration(nodes: DataFrame, column: str, top: int) -> DataFrame:
    """Gini coefficient and the share of the ``top`` largest values."""
    up, down = Window.orderBy(column, "zone_id"), Window.orderBy(F.desc(column), "zone_id")
    ranked = nodes.select(F.col(column).cast("double").alias("x"), F.row_number().over(up).alias("i"), F.row_number().over(down).alias("j"))
    n, total = F.count(F.lit(1)), F.sum("x")
    gini = safe_ratio(2 * F.sum(F.col("i") * F.col("x")), n * total) - (n + 1) / n
    return ranked.agg(gini.alias("gini"), safe_ratio(F.sum(F.when(F.col("j") <= top, F.col("x"))), total).alias("top_share"))
