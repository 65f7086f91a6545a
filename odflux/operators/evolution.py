"""Partitions compared, and years compared."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflux.functions.expressions import log_factorial, safe_corr, safe_ratio


def modularity(pairs: DataFrame, part: DataFrame, *by: str) -> DataFrame:
    """Weighted modularity of a partition (by, zone_id, community) over undirected pairs (by, u, v, trips), for each group of ``by``."""
    keys = list(by)
    a = part.select(*keys, F.col("zone_id").alias("u"), F.col("community").alias("cu"))
    b = part.select(*keys, F.col("zone_id").alias("v"), F.col("community").alias("cv"))
    both = pairs.join(a, [*keys, "u"]).join(b, [*keys, "v"])
    inside = F.when(F.col("cu") == F.col("cv"), F.col("trips")).otherwise(0)
    ends = F.explode(F.array(F.struct(F.col("cu").alias("g"), inside.alias("inside")), F.struct(F.col("cv").alias("g"), F.lit(0).cast("long").alias("inside"))))
    rows = both.select(*keys, ends.alias("e"), "trips").groupBy(*keys, "e.g").agg(F.sum("e.inside").alias("inside"), F.sum("trips").alias("degree"))
    m = F.sum("degree").over(Window.partitionBy(*keys)) / 2.0
    return rows.select(*keys, (F.col("inside") / m - F.pow(F.col("degree") / (2 * m), F.lit(2.0))).alias("q")).groupBy(*keys).agg(F.sum("q").alias("modularity"))


def flow_matrix(edges: DataFrame, part: DataFrame) -> DataFrame:
    """Trips between communities, and the share of trips that stay inside one."""
    a = part.select(F.col("zone_id").alias("o"), F.col("community").alias("from_group"))
    b = part.select(F.col("zone_id").alias("d"), F.col("community").alias("to_group"))
    flows = edges.where("o <> d").join(a, "o").join(b, "d").groupBy("from_group", "to_group").agg(F.sum("trips").alias("trips"))
    every = Window.partitionBy()
    within = F.sum(F.when(F.col("from_group") == F.col("to_group"), F.col("trips")).otherwise(0)).over(every)
    return flows.withColumn("within_share", safe_ratio(within, F.sum("trips").over(every)))


def contingency(pairs: DataFrame) -> DataFrame:
    """(a, b, n) of two labellings a and b, one row an item."""
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(pairs: DataFrame, *by: str) -> DataFrame:
    """Adjusted Rand index of labellings a and b, for each group of ``by``."""
    table = pairs.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    two = lambda n: n * (n - 1) / 2
    total = lambda df, name: df.groupBy(*by).agg(F.sum(two(F.col("n"))).alias(name))
    cells = table.groupBy(*by).agg(F.sum(two(F.col("n"))).alias("idx"), F.sum("n").alias("t"))
    rows = total(table.groupBy(*by, "a").agg(F.sum("n").alias("n")), "sa")
    columns = total(table.groupBy(*by, "b").agg(F.sum("n").alias("n")), "sb")
    meet = (lambda x, y: x.join(y, list(by))) if by else (lambda x, y: x.join(y))
    expected = F.try_divide(F.col("sa") * F.col("sb"), two(F.col("t")))
    top = F.col("idx") - F.col("expected")
    return meet(meet(cells, rows), columns).withColumn("expected", expected).select(*by, F.try_divide(top, (F.col("sa") + F.col("sb")) / 2 - F.col("expected")).alias("ari"))


def adjusted_mutual(pairs: DataFrame, *by: str) -> DataFrame:
    """Adjusted mutual information of labellings a and b, for each group of ``by``: less its expectation under shuffled
    items, over the mean entropy less the same.

    The expectation depends on the sizes of the classes only, so sizes are counted first: at most about the root of twice
    the items differ, and their pairs are no more than the items."""
    keys = list(by) or ["_all"]
    rows = pairs if by else pairs.withColumn("_all", F.lit(1))
    cells = rows.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    a = cells.groupBy(*keys, "a").agg(F.sum("n").alias("x"))
    b = cells.groupBy(*keys, "b").agg(F.sum("n").alias("y"))
    total = cells.groupBy(*keys).agg(F.sum("n").alias("t"))
    n, x, y, t = (F.col(c) for c in "nxyt")
    mutual = cells.join(a, [*keys, "a"]).join(b, [*keys, "b"]).join(total, keys).groupBy(*keys).agg(F.sum(n / t * F.log(t * n / (x * y))).alias("mi"))
    entropy = lambda df, c, name: df.join(total, keys).groupBy(*keys).agg((-F.sum(F.col(c) / t * F.log(F.col(c) / t))).alias(name))
    sizes = lambda df, c: df.groupBy(*keys, c).agg(F.count(F.lit(1)).alias(f"of_{c}"))
    met = sizes(a, "x").join(sizes(b, "y"), keys).join(total, keys)
    terms = met.withColumn("n", F.explode(F.sequence(F.greatest(F.lit(1), x + y - t).cast("long"), F.least(x, y).cast("long"))))
    up = [log_factorial(c) for c in (x, y, t - x, t - y)]
    down = [log_factorial(c) for c in (t, n, x - n, y - n, t - x - y + n)]
    chance = F.exp(reduce(lambda p, q: p + q, up) - reduce(lambda p, q: p + q, down))
    expected = terms.groupBy(*keys).agg(F.sum(F.col("of_x") * F.col("of_y") * n / t * F.log(t * n / (x * y)) * chance).alias("emi"))
    out = mutual.join(entropy(a, "x", "ha"), keys).join(entropy(b, "y", "hb"), keys).join(expected, keys)
    top, bottom = F.col("mi") - F.col("emi"), (F.col("ha") + F.col("hb")) / 2 - F.col("emi")
    score = F.when((F.col("ha") == 0) & (F.col("hb") == 0), 1.0).when(F.abs(bottom) > 1e-12, F.try_divide(top, bottom))
    return out.select(*by, score.alias("ami"))


def agreement(pairs: DataFrame, *by: str) -> DataFrame:
    """Items, adjusted Rand index and adjusted mutual information of labellings a and b; null for fewer than two items."""
    items = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("items"))
    met = items.join(adjusted_rand(pairs, *by), list(by), "left").join(adjusted_mutual(pairs, *by), list(by), "left")
    return met.withColumns({c: F.when(F.col("items") >= 2, F.col(c)) for c in ("ari", "ami")})


def panel(yearly: DataFrame) -> DataFrame:
    """One row a year: edges, nodes, trips, own trips, mean distance, density, reciprocity and assortativity, of edges keyed by yr."""
    proper = F.col("o") != F.col("d")
    when = lambda c: F.sum(F.when(proper, F.col(c)))
    sums = yearly.groupBy("yr").agg(
        F.count_if(proper).alias("n_edges"),
        F.coalesce(when("trips"), F.lit(0)).alias("total_trips"),
        F.coalesce(F.sum(F.when(~proper, F.col("trips"))), F.lit(0)).alias("self_trips"),
        safe_ratio(when("sum_dist"), when("trips")).alias("mean_dist"),
    )
    nodes = yearly.where(proper).select("yr", F.explode(F.array("o", "d")).alias("id")).distinct().groupBy("yr").agg(F.count(F.lit(1)).alias("n_nodes"))
    links = yearly.where(proper).select("yr", "o", "d", "trips")
    back = links.select("yr", F.col("d").alias("o"), F.col("o").alias("d"), F.col("trips").alias("back"))
    near = lambda c: F.count(F.lit(1)).over(Window.partitionBy("yr", c)).cast("double")
    both = links.withColumns({"ko": near("o"), "kd": near("d")}).join(back, ["yr", "o", "d"], "left").groupBy("yr")
    shape = both.agg(
        safe_ratio(F.sum(F.least("trips", F.coalesce("back", F.lit(0)))), F.sum("trips")).alias("weighted_reciprocity"),
        safe_ratio(F.count("back"), F.count(F.lit(1))).alias("r"),
        safe_corr(F.col("ko"), F.col("kd")).alias("degree_assortativity"),
    )
    out = sums.join(nodes, "yr", "left").na.fill(0, ["n_nodes"]).join(shape, "yr", "left")
    out = out.withColumn("density", safe_ratio(F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)))
    return out.withColumn("reciprocity_rho", F.try_divide(F.col("r") - F.col("density"), 1 - F.col("density"))).drop("r")


def yearly_change(yearly: DataFrame, metric: str) -> DataFrame:
    before = F.lag(metric).over(Window.orderBy("yr"))
    return yearly.select("yr", metric, before.alias("previous"), F.try_divide((F.col(metric) - before) * 100.0, before.cast("double")).alias("change_pct"))


def variation(yearly: DataFrame, metric: str) -> DataFrame:
    return yearly.agg(F.avg(metric).alias("mean"), F.min(metric).alias("min"), F.max(metric).alias("max"), F.try_divide(F.stddev_samp(metric), F.avg(F.abs(metric))).alias("cv"))


def fixed_changes(yearly: DataFrame, metric: str, spans: list[tuple[int, int]]) -> DataFrame:
    """(from_year, to_year, change_pct) of a metric between given years; null where a year is absent or its value 0."""
    wanted = yearly.sparkSession.createDataFrame(spans, "from_year int, to_year int")
    at = lambda name, value: yearly.select(F.col("yr").alias(name), F.col(metric).cast("double").alias(value))
    met = wanted.join(at("from_year", "before"), "from_year", "left").join(at("to_year", "after"), "to_year", "left")
    return met.select("from_year", "to_year", F.try_divide((F.col("after") - F.col("before")) * 100.0, F.col("before")).alias("change_pct"))


def timeline(monthly: DataFrame, metric: str) -> DataFrame:
    """(yr, mo, value, share_of_peak, is_least): one row for every month from the first to the last, those without trips 0."""
    whole = monthly.select((F.col("yr") * 12 + F.col("mo") - 1).alias("m"), F.col(metric).alias("value")).groupBy("m").agg(F.sum("value").alias("value"))
    months = whole.agg(F.min("m").alias("a"), F.max("m").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("m"))
    every = Window.partitionBy()
    filled = months.join(whole, "m", "left").na.fill(0, ["value"])
    share = safe_ratio(F.col("value"), F.max("value").over(every))
    return filled.select(F.floor(F.col("m") / 12).cast("int").alias("yr"), (F.col("m") % 12 + 1).cast("int").alias("mo"), "value", share.alias("share_of_peak"), (F.col("value") == F.min("value").over(every)).alias("is_least"))


def base_index(yearly: DataFrame, metric: str, base: int) -> DataFrame:
    """100 at the base year."""
    at = F.max(F.when(F.col("yr") == base, F.col(metric))).over(Window.partitionBy())
    return yearly.select("yr", metric, F.try_divide(F.col(metric) * 100.0, at.cast("double")).alias("index"))


def hub_shares(yearly: DataFrame, k: int) -> DataFrame:
    """The k zones with most inward trips of each year, and their shares of the k's sum."""
    inward = yearly.where("o <> d").groupBy("yr", F.col("d").alias("zone_id")).agg(F.sum("trips").alias("inward"))
    order = Window.partitionBy("yr").orderBy(F.desc("inward"), "zone_id")
    ranked = inward.withColumn("rank", F.row_number().over(order))
    share = safe_ratio(F.col("inward"), F.sum("inward").over(Window.partitionBy("yr")))
    return ranked.withColumn("share", share).where(F.col("rank") <= k)


def top_edges(yearly: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("yr").orderBy(F.desc("trips"), "o", "d")
    return yearly.where("o <> d").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("yr", "o", "d", "trips", "rank")


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank correlation of each pair of columns, ties at their average rank."""
    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2.0
    ranked = df.select(*[rank(c).alias(c) for c in columns])
    pairs = list(combinations(columns, 2))
    one = ranked.agg(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), safe_corr(F.col(a), F.col(b)).alias("rho")) for a, b in pairs]).alias("all"))
    return one.select(F.inline("all"))


def alignment(members: DataFrame) -> DataFrame:
    """Agreement of consecutive years' communities (yr, zone_id, community) over the zones they share."""
    years = members.select("yr").distinct().select("yr", F.lag("yr").over(Window.orderBy("yr")).alias("before"))
    now = members.join(F.broadcast(years), "yr").where("before is not null").select("before", "yr", "zone_id", F.col("community").alias("b"))
    old = members.select(F.col("yr").alias("before"), "zone_id", F.col("community").alias("a"))
    return agreement(now.join(old, ["before", "zone_id"]), "before", "yr").withColumnRenamed("items", "shared_zones")


def unite(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
