"""Spatial interaction: distances, gravity models, residuals."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odflux.functions.expressions import safe_ratio
from odflux.operators.aggregates import without_loops
from odflux.operators.iterate import Iterates

FEET = 5280.0
#: Balancing rounds between two looks at what has changed over them, and exponents that are tried as upper ends first.
BURST = 8
PROBES = (0.5, 1.0, 2.0, 3.0)


def with_distance(edges: DataFrame, zones: DataFrame) -> DataFrame:
    """Edges with straight miles between their ends' centroids; null without coordinates.  The zone table is small."""
    at = zones.select("zone_id", "cx_ft", "cy_ft")
    a = at.select(F.col("zone_id").alias("o"), F.col("cx_ft").alias("ox"), F.col("cy_ft").alias("oy"))
    b = at.select(F.col("zone_id").alias("d"), F.col("cx_ft").alias("dx"), F.col("cy_ft").alias("dy"))
    out = edges.join(a, "o", "left").join(b, "d", "left")
    return out.withColumn("miles", F.sqrt((F.col("ox") - F.col("dx")) ** 2 + (F.col("oy") - F.col("dy")) ** 2) / FEET).drop("ox", "oy", "dx", "dy")


def pair_distances(zones: DataFrame) -> DataFrame:
    """All ordered pairs of zones with coordinates; at most a few hundred zones."""
    ids = zones.where("cx_ft is not null").select("zone_id")
    pairs = ids.select(F.col("zone_id").alias("o")).crossJoin(ids.select(F.col("zone_id").alias("d"))).where("o <> d")
    return with_distance(pairs, zones)


def nearest(zones: DataFrame, k: int) -> DataFrame:
    """The k nearest zones of each zone; ties by zone."""
    order = Window.partitionBy("o").orderBy("miles", "d")
    return pair_distances(zones).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def decay_bins(edges: DataFrame, zones: DataFrame, low: float = -1.0, high: float = 2.0, bins: int = 24) -> DataFrame:
    """Mean trips of edges by equal bins of log10 miles."""
    e = with_distance(without_loops(edges), zones).where("miles > 0")
    step = (high - low) / bins
    keyed = e.withColumn("bin", F.floor((F.log10("miles") - low) / step).cast("int")).where(F.col("bin").between(0, bins - 1))
    return keyed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("trips").alias("mean_trips"))


def ideal_efficiency(zones: DataFrame) -> DataFrame:
    """Mean of 1 / miles over all ordered pairs at positive distance."""
    return pair_distances(zones).where("miles > 0").agg(F.count(F.lit(1)).alias("pairs"), F.avg(1 / F.col("miles")).alias("ideal_efficiency"))


def poisson_gravity(edges: DataFrame, zones: DataFrame) -> DataFrame:
    """Unconstrained gravity model: trips on logs of outward and inward totals and of miles; deviance share explained."""
    e = with_distance(without_loops(edges), zones).where("miles > 0")
    out = F.sum("trips").over(Window.partitionBy("o"))
    inn = F.sum("trips").over(Window.partitionBy("d"))
    x = e.select(F.col("trips").cast("double").alias("trips"), F.log(out).alias("lo"), F.log(inn).alias("ld"), F.log(F.greatest("miles", F.lit(0.1))).alias("lm"))
    data = VectorAssembler(inputCols=["lo", "ld", "lm"], outputCol="features").transform(x)
    fit = GeneralizedLinearRegression(family="poisson", link="log", labelCol="trips", tol=1e-9, maxIter=50).fit(data)
    s, c = fit.summary, fit.coefficients
    row = (float(c[0]), float(c[1]), -float(c[2]), float(s.dispersion), float(s.coefficientStandardErrors[2]), 1 - s.deviance / s.nullDeviance)
    return edges.sparkSession.createDataFrame([row], "coef_out double, coef_in double, beta double, dispersion double, se_beta double, deviance_r2 double")


def furness(edges: DataFrame, zones: DataFrame, beta: float, rounds: int) -> DataFrame:
    """Doubly constrained model after a fixed number of balancing rounds: (o, d, obs, miles, model).

    All pairs of active zones with coordinates take part; each round is two group sums and two joins on zone ids.
    """
    e = with_distance(without_loops(edges).select("o", "d", "trips"), zones).where("miles > 0")
    out = e.groupBy("o").agg(F.sum("trips").cast("double").alias("out_total"))
    inn = e.groupBy("d").agg(F.sum("trips").cast("double").alias("in_total"))
    grid = out.join(inn.select("d", "in_total")).where("o <> d")
    grid = with_distance(grid, zones).where("miles > 0").withColumn("f", F.pow("miles", F.lit(-beta)))
    b = inn.select("d", F.lit(1.0).alias("b"))
    for _ in range(rounds):
        a = grid.join(b, "d").groupBy("o").agg(F.sum(F.col("b") * F.col("in_total") * F.col("f")).alias("s")).select("o", (1 / F.col("s")).alias("a"))
        b = grid.join(a, "o").groupBy("d").agg(F.sum(F.col("a") * F.col("out_total") * F.col("f")).alias("s")).select("d", (1 / F.col("s")).alias("b"))
    model = grid.join(a, "o").join(b, "d").join(e.select("o", "d", "trips"), ["o", "d"], "left")
    value = F.col("a") * F.col("b") * F.col("out_total") * F.col("in_total") * F.col("f")
    return model.select("o", "d", F.coalesce("trips", F.lit(0)).alias("obs"), "miles", value.alias("model"))


def calibrate(edges: DataFrame, zones: DataFrame, by: str, low: float = 0.2, high: float = 5.0, close: float = 1e-10, most: int = 300) -> DataFrame:
    """(by, beta, cpc, mean_miles): the doubly constrained model of each key, with the exponent at which its mean distance
    is the observed one; null beta and cpc where that isn't between ``low`` and ``high``.

    All keys are calibrated together.  A step tries one exponent for each open key, with balancing to ``close`` within
    ``most`` rounds; balanced keys drop out of a step's rounds, and calibrated ones out of the search (false position,
    with the kept end's gap halved).  Balancing starts from the factors of the step before."""
    spark = edges.sparkSession
    steps = Iterates(spark, "calibrate")
    e = with_distance(without_loops(edges).groupBy(by, "o", "d").agg(F.sum("trips").alias("trips")), zones).where("miles > 0")
    out = e.groupBy(by, "o").agg(F.sum("trips").cast("double").alias("out_total"))
    inn = e.groupBy(by, "d").agg(F.sum("trips").cast("double").alias("in_total"))
    pairs = with_distance(out.join(inn, by).where("o <> d"), zones).where("miles > 0")
    grid = steps.keep("grid", pairs.join(e.select(by, "o", "d", "trips"), [by, "o", "d"], "left").select(by, "o", "d", "miles", "out_total", "in_total", F.coalesce("trips", F.lit(0)).alias("obs")))
    start = steps.keep("start", grid.select(by, "d", F.lit(1.0).alias("b")).distinct())

    def balanced(tries: DataFrame) -> DataFrame:
        """Modelled trips of the grid for each (by, beta) of ``tries``."""
        nonlocal start
        keys = [by, "beta"]
        cells = steps.keep("cells", grid.join(F.broadcast(tries.select(*keys)), by).withColumn("f", F.pow("miles", -F.col("beta"))).drop("miles", "obs"))
        inverse = lambda x: F.try_divide(F.lit(1.0), F.sum(x * F.col("f")))
        b = steps.keep("b", start.join(F.broadcast(tries.select(*keys)), by).select(*keys, "d", "b", F.lit(float("inf")).alias("last")))
        for _ in range(-(-most // BURST)):
            off = b.groupBy(*keys).agg(F.max(F.abs(F.col("b") - F.col("last"))).alias("off")).where(F.col("off") >= close).select(*keys)
            if not off.limit(1).count():
                break
            open_, new = cells.join(F.broadcast(off), keys, "left_semi"), b.join(F.broadcast(off), keys, "left_semi")
            last = new.select(*keys, "d", F.col("b").alias("last"))
            for _round in range(BURST):
                a = open_.join(new.select(*keys, "d", "b"), [*keys, "d"]).groupBy(*keys, "o").agg(inverse(F.col("b") * F.col("in_total")).alias("a"))
                new = open_.join(a, [*keys, "o"]).groupBy(*keys, "d").agg(inverse(F.col("a") * F.col("out_total")).alias("b"))
            b = steps.keep("b", new.join(last, [*keys, "d"]).select(*keys, "d", "b", "last").union(b.join(F.broadcast(off), keys, "left_anti").select(*keys, "d", "b", "last")))
        done = b.select(*keys, "d", "b")
        start = steps.keep("start", done.select(by, "d", "b").union(start.join(F.broadcast(tries.select(by)), by, "left_anti")))
        a = cells.join(done, [*keys, "d"]).groupBy(*keys, "o").agg(inverse(F.col("b") * F.col("in_total")).alias("a"))
        value = F.col("a") * F.col("b") * F.col("out_total") * F.col("in_total") * F.col("f")
        model = cells.join(done, [*keys, "d"]).join(a, [*keys, "o"]).select(*keys, "o", "d", value.alias("model"))
        return model.join(grid.select(by, "o", "d", "obs", "miles"), [by, "o", "d"])

    mean = lambda w: safe_ratio(F.sum(F.col(w) * F.col("miles")), F.sum(w))
    gap = lambda model: model.groupBy(by, "beta").agg((mean("model") - mean("obs")).alias("gap"))
    found = steps.keep("state", gap(balanced(grid.select(by).distinct().withColumn("beta", F.lit(low)))).select(by, F.col("beta").alias("x0"), F.col("beta").alias("x1"), F.col("gap").alias("g0"), F.col("gap").alias("g1"), F.when(F.col("gap") == 0, F.col("beta")).alias("root")))
    # The mean distance falls as the exponent rises, so the upper end is sought from below, where balancing is fast.
    for upper in [x for x in PROBES if low < x < high] + [high]:
        tries = found.where("root is null and g0 > 0 and g1 > 0").select(by, F.lit(upper).alias("beta"))
        if tries.limit(1).count():
            seen = gap(balanced(tries))
            moved = [F.when(F.col("gap").isNotNull(), F.col("x1")).otherwise(F.col("x0")).alias("x0"), F.coalesce("beta", "x1").alias("x1"), F.when(F.col("gap").isNotNull(), F.col("g1")).otherwise(F.col("g0")).alias("g0"), F.coalesce("gap", "g1").alias("g1")]
            found = steps.keep("state", found.join(seen, by, "left").select(by, *moved, F.coalesce("root", F.when(F.col("gap") == 0, F.col("beta"))).alias("root")))
    for _ in range(60):
        next_ = F.col("x0") - F.col("g0") * F.try_divide(F.col("x1") - F.col("x0"), F.col("g1") - F.col("g0"))
        tries = found.where("root is null and g0 * g1 < 0").select(by, next_.alias("beta"))
        if not tries.limit(1).count():
            break
        seen = gap(balanced(tries))
        same = F.signum("gap") == F.signum("g1")
        moved = found.join(seen, by, "left").select(
            by,
            F.when(F.col("gap").isNull() | same, F.col("x0")).otherwise(F.col("x1")).alias("x0"),
            F.coalesce("beta", "x1").alias("x1"),
            F.when(F.col("gap").isNull(), F.col("g0")).when(same, F.col("g0") / 2).otherwise(F.col("g1")).alias("g0"),
            F.coalesce("gap", "g1").alias("g1"),
            F.coalesce("root", F.when((F.abs("gap") < 1e-11) | (F.abs(F.col("beta") - F.col("x1")) < 1e-10), F.col("beta"))).alias("root"),
        )
        found = steps.keep("state", moved)
    fit = common_part_by(balanced(found.where("root is not null").select(by, F.col("root").alias("beta"))), by)
    seen = grid.groupBy(by).agg(mean("obs").alias("mean_miles"))
    result = steps.keep("result", seen.join(found.select(by, F.col("root").alias("beta")), by, "left").join(fit, by, "left").select(by, "beta", "cpc", "mean_miles"))
    steps.result("result")
    return result


def radiation(edges: DataFrame, zones: DataFrame) -> DataFrame:
    """(o, d, obs, miles, model) of the radiation model: a zone's trips go to others by their mass, its own, and that of all
    strictly nearer zones, scaled so that each origin's trips are kept.  A zone's mass is its trips in both directions.

    Intervening mass is a prefix sum over an origin's distances; zones at the same distance don't intervene."""
    e = with_distance(without_loops(edges).groupBy("o", "d").agg(F.sum("trips").alias("trips")), zones).where("miles > 0").select("o", "d", "trips")
    ends = F.explode(F.array(F.struct(F.col("o").alias("id"), "trips"), F.struct(F.col("d").alias("id"), "trips")))
    mass = e.select(ends.alias("x")).groupBy("x.id").agg(F.sum("x.trips").cast("double").alias("m"))
    out = e.groupBy("o").agg(F.sum("trips").cast("double").alias("out_total"))
    pairs = pair_distances(zones).where("miles > 0").select("o", "d", "miles").join(out, "o")
    pairs = pairs.join(mass.select(F.col("id").alias("o"), F.col("m").alias("mo")), "o").join(mass.select(F.col("id").alias("d"), F.col("m").alias("md")), "d")
    rings = pairs.groupBy("o", "miles").agg(F.sum("md").alias("ring"))
    nearer = F.coalesce(F.sum("ring").over(Window.partitionBy("o").orderBy("miles").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    met = pairs.join(rings.select("o", "miles", nearer.alias("s")), ["o", "miles"])
    odds = F.col("mo") * F.col("md") / ((F.col("mo") + F.col("s")) * (F.col("mo") + F.col("md") + F.col("s")))
    share = met.withColumn("odds", odds).withColumn("model", F.col("out_total") * safe_ratio(F.col("odds"), F.sum("odds").over(Window.partitionBy("o"))))
    return share.join(e, ["o", "d"], "left").select("o", "d", F.coalesce("trips", F.lit(0)).alias("obs"), "miles", "model")


def common_part_by(model: DataFrame, *by: str) -> DataFrame:
    return model.groupBy(*by).agg(safe_ratio(2 * F.sum(F.least("obs", "model")), F.sum("obs") + F.sum("model")).alias("cpc"))


def common_part(model: DataFrame) -> DataFrame:
    """Share of trips that model and data have in common."""
    return model.agg(safe_ratio(2 * F.sum(F.least("obs", "model")), F.sum("obs") + F.sum("model")).alias("cpc"))


def mean_miles_gap(model: DataFrame) -> DataFrame:
    """Modelled minus observed mean trip distance: zero at the calibrated exponent."""
    mean = lambda w: safe_ratio(F.sum(F.col(w) * F.col("miles")), F.sum(w))
    return model.agg((mean("model") - mean("obs")).alias("gap"))


def deviance_residuals(model: DataFrame, least: float = 20.0) -> DataFrame:
    """Signed root of each cell's Poisson deviance where the model expects at least ``least`` trips."""
    t, m = F.col("obs"), F.col("model")
    part = F.when(t > 0, t * F.log(t / m)).otherwise(0.0) - (t - m)
    return model.where(m >= least).withColumn("resid", F.signum(t - m) * F.sqrt(F.greatest(2 * part, F.lit(0.0))))


def surprise(residuals: DataFrame) -> DataFrame:
    """Mean of a zone's mean outward and mean inward residual; one of them where the other is missing."""
    out = residuals.groupBy(F.col("o").alias("zone_id")).agg(F.avg("resid").alias("outward"))
    inn = residuals.groupBy(F.col("d").alias("zone_id")).agg(F.avg("resid").alias("inward"))
    both = out.join(inn, "zone_id", "full_outer")
    return both.withColumn("surprise", F.coalesce((F.col("outward") + F.col("inward")) / 2, F.col("outward"), F.col("inward")))
