"""Kernel operators: sources, seeds, strategies and years spread over tasks.

The kernels need the whole zone graph.  ``matrix`` reads it on the driver only after a count of its nodes: graphs of
zones have a few hundred.  A larger graph raises; for those, ``centrality`` and ``structure`` have the measures that joins can express.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odflux.kernels import graph as G
from odflux.kernels import tails as T
from odflux.operators.aggregates import endpoints, without_loops

#: A dense matrix of this many nodes is 32 MB.
MOST_NODES = 2_000


def matrix(edges: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted node ids, trips) of a zone graph without self-loops."""
    proper = without_loops(edges).groupBy("o", "d").agg(F.sum("trips").alias("trips"))
    n = endpoints(proper).count()
    if n > MOST_NODES:
        raise ValueError(f"{n} nodes: the dense kernels take {MOST_NODES} at most")
    rows = proper.toPandas()
    ids = np.unique(rows[["o", "d"]].to_numpy()) if len(rows) else np.zeros(0, dtype=int)
    trips = np.zeros((len(ids), len(ids)))
    trips[np.searchsorted(ids, rows["o"]), np.searchsorted(ids, rows["d"])] = rows["trips"]
    return ids, trips


def fan_out(spark: SparkSession, n: int, schema: str, work: Callable[[int], list[tuple]]) -> DataFrame:
    """Rows of ``work(i)`` for i below n, a task for each few."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame([row for i in df["id"] for row in work(int(i))], columns=names)

    return spark.range(0, n, 1, max(1, min(n, spark.sparkContext.defaultParallelism * 2))).mapInPandas(run, schema)


def betweenness(edges: DataFrame, normalised: bool = True) -> DataFrame:
    """Weighted betweenness over cost 1 / trips: one source a row, added up by node."""
    ids, trips = matrix(edges)
    cost, n = G.lengths(trips), len(ids)
    parts = fan_out(edges.sparkSession, n, "zone_id long, part double", lambda s: list(zip(ids.tolist(), G.betweenness_from(cost, s).tolist())))
    scale = 1 / ((n - 1) * (n - 2)) if normalised and n > 2 else 1.0
    return parts.groupBy("zone_id").agg((F.sum("part") * scale).alias("betweenness"))


def path_efficiency(edges: DataFrame) -> DataFrame:
    """Global efficiency by hops and by cost, from per-source rows."""
    ids, trips = matrix(edges)
    cost, hops, n = G.lengths(trips), G.lengths((trips > 0).astype(float)), len(ids)

    def from_source(s: int) -> list[tuple]:
        out = []
        for name, length in (("cost", cost), ("hops", hops)):
            d = length[s].copy()
            for _ in range(n):
                new = np.minimum(d, (d[:, None] + length).min(axis=0))
                if (new == d).all():
                    break
                d = new
            off = np.delete(d, s)
            out.append((name, float(np.where(np.isfinite(off), 1 / np.where(off > 0, off, np.inf), 0).sum())))
        return out

    parts = fan_out(edges.sparkSession, n, "measure string, part double", from_source)
    return parts.groupBy("measure").agg((F.sum("part") / max(1, n * (n - 1))).alias("efficiency"))


def local_efficiency(edges: DataFrame) -> DataFrame:
    ids, trips = matrix(edges)
    return fan_out(edges.sparkSession, len(ids), "zone_id long, local_efficiency double", lambda i: [(int(ids[i]), G.local_efficiency(trips, i))])


def circuity(edges: DataFrame, distances: DataFrame, least: float = 0.5) -> DataFrame:
    """(o, d, straight, network, circuity) for pairs at least ``least`` apart; edges as long as their straight distance."""
    ids, trips = matrix(edges)
    straight = np.full(trips.shape, np.nan)
    for r in distances.select("o", "d", "miles").where("miles > 0").toLocalIterator():
        i, j = np.searchsorted(ids, r["o"]), np.searchsorted(ids, r["d"])
        if i < len(ids) and j < len(ids) and ids[i] == r["o"] and ids[j] == r["d"]:
            straight[i, j] = r["miles"]
    length = np.where((trips > 0) & np.isfinite(straight), straight, np.inf)
    np.fill_diagonal(length, 0)
    path = G.all_pairs(length)

    def of(i: int) -> list[tuple]:
        ok = np.flatnonzero(np.isfinite(straight[i]) & np.isfinite(path[i]) & (straight[i] >= least))
        return [(int(ids[i]), int(ids[j]), float(straight[i, j]), float(path[i, j]), float(path[i, j] / straight[i, j])) for j in ok]

    return fan_out(edges.sparkSession, len(ids), "o long, d long, straight double, network double, circuity double", of)


FRACTIONS = [round(0.02 * k, 2) for k in range(31)]
SWEEP = "strategy string, seed int, f double, wcc_frac double, scc_frac double, eff_frac double, trip_frac double"


def _sweep_row(strategy: str, seed: int, f: float, trips: np.ndarray, order: np.ndarray, base: float, with_eff: bool) -> tuple:
    alive = np.ones(len(trips), dtype=bool)
    alive[order[: round(f * len(trips))]] = False
    m = G.survivors(trips, alive, base, with_eff)
    return strategy, seed, f, m["wcc_frac"], m["scc_frac"], m["eff_frac"] if with_eff else None, m["trip_frac"]


def targeted_attacks(edges: DataFrame) -> DataFrame:
    """Survivor metrics as nodes go by strength, betweenness and PageRank order, one row a strategy and fraction."""
    ids, trips = matrix(edges)
    base = G.efficiency(G.all_pairs(G.lengths(trips)))
    out = trips.sum(axis=1, keepdims=True)
    step, rank = np.where(out > 0, trips / np.where(out > 0, out, 1), 1 / max(1, len(ids))), np.full(len(ids), 1 / max(1, len(ids)))
    for _ in range(100):
        rank = 0.85 * rank @ step + 0.15 / max(1, len(ids))
    scores = {"strength": trips.sum(axis=0) + trips.sum(axis=1), "betweenness": G.betweenness(G.lengths(trips)), "pagerank": rank}
    plans = [(name, np.argsort(-s, kind="stable"), f) for name, s in scores.items() for f in FRACTIONS]
    return fan_out(edges.sparkSession, len(plans), SWEEP, lambda i: [_sweep_row(plans[i][0], 0, plans[i][2], trips, plans[i][1], base, True)])


def random_failure(edges: DataFrame, seeds: int = 100, with_efficiency: int = 20) -> DataFrame:
    """Random removal: one seed a row of work; efficiency for the first seeds only."""
    ids, trips = matrix(edges)
    base = G.efficiency(G.all_pairs(G.lengths(trips)))

    def of(seed: int) -> list[tuple]:
        order = np.random.default_rng(seed).permutation(len(ids))
        return [_sweep_row("random", seed, f, trips, order, base, seed < with_efficiency) for f in FRACTIONS]

    runs = fan_out(edges.sparkSession, seeds, SWEEP, of)
    return runs.groupBy("strategy", "f").agg(*[F.avg(c).alias(c) for c in ("wcc_frac", "scc_frac", "eff_frac", "trip_frac")])


def recomputed_attack(edges: DataFrame) -> DataFrame:
    """The strongest remaining node goes each time; sequential, so one row of work."""
    ids, trips = matrix(edges)
    base = G.efficiency(G.all_pairs(G.lengths(trips)))

    def of(_: int) -> list[tuple]:
        left, order = trips.copy(), []
        for _k in range(len(ids)):
            s = left.sum(axis=0) + left.sum(axis=1)
            s[order] = -1
            order.append(int(s.argmax()))
            left[order[-1]] = left[:, order[-1]] = 0
        return [_sweep_row("strength_recomputed", 0, f, trips, np.asarray(order, dtype=int), base, True) for f in FRACTIONS]

    return fan_out(edges.sparkSession, 1, SWEEP, of)


def sweep_summary(sweep: DataFrame, column: str = "wcc_frac") -> DataFrame:
    """Mean of a curve over the swept fractions, its first fraction below half, and its value at the fraction nearest 0.1."""
    return sweep.groupBy("strategy").agg(
        F.avg(column).alias("schneider_r"), F.min(F.when(F.col(column) < 0.5, F.col("f"))).alias("critical_f"), F.min_by("trip_frac", F.abs(F.col("f") - 0.1)).alias("trip_frac_at_10")
    )


def attack_gap(attacks: DataFrame, failures: DataFrame, at: float = 0.1) -> DataFrame:
    """One row at the swept fraction nearest ``at``: what random failure leaves of trips and efficiency, what the worst attack
    leaves (the one that leaves fewest trips, the first by name among equals), and the gap between their trips."""
    near = lambda df: df.withColumn("_far", F.abs(F.col("f") - at)).groupBy("strategy").agg(F.min_by(F.struct("f", "trip_frac", "eff_frac"), F.struct("_far", "f")).alias("p")).select("strategy", "p.*")
    worst = near(attacks).agg(F.min_by(F.struct("strategy", "trip_frac", "eff_frac"), F.struct("trip_frac", "strategy")).alias("w"))
    random = near(failures.where("strategy = 'random'")).select("f", F.col("trip_frac").alias("random_trip_frac"), F.col("eff_frac").alias("random_eff_frac"))
    return random.join(worst).select(
        "f", "random_trip_frac", "random_eff_frac", F.col("w.strategy").alias("worst_attack"), F.col("w.trip_frac").alias("attack_trip_frac"), F.col("w.eff_frac").alias("attack_eff_frac"), (F.col("random_trip_frac") - F.col("w.trip_frac")).alias("trip_frac_gap")
    )


def cascades(edges: DataFrame, tolerances: list[float]) -> DataFrame:
    ids, trips = matrix(edges)
    schema = "alpha double, g_wcc double, failed long, failed_frac double, flow_frac double, injectors long, absorbers long, steps long"
    return fan_out(edges.sparkSession, len(tolerances), schema, lambda i: [(tolerances[i], *G.cascade(trips, tolerances[i]).values())])


METHODS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "louvain": lambda t, seed: G.louvain(t + t.T, seed),
    "leiden": lambda t, seed: G.louvain(t + t.T, seed, refine=True),
    "greedy": lambda t, seed: G.agglomerate(t + t.T),
    "infomap": lambda t, seed: G.infomap(t, seed),
}


def communities(edges: DataFrame, method: str, seeds: int = 1) -> DataFrame:
    """(seed, zone_id, community) of a method for each seed."""
    ids, trips = matrix(edges)
    find = METHODS[method]
    return fan_out(edges.sparkSession, seeds, "seed int, zone_id long, community int", lambda s: [(s, int(z), int(c)) for z, c in zip(ids, find(trips, s))])


def resolution_sweep(edges: DataFrame, resolutions: list[float]) -> DataFrame:
    ids, trips = matrix(edges)
    w = trips + trips.T

    def of(i: int) -> list[tuple]:
        part = G.louvain(w, 42, resolutions[i])
        return [(resolutions[i], int(part.max()) + 1, G.modularity(w, part))]

    return fan_out(edges.sparkSession, len(resolutions), "resolution double, communities long, modularity double", of)


def seed_stability(edges: DataFrame, seeds: int) -> DataFrame:
    """Mode and range of community counts, and mean and least adjusted Rand and mutual information over pairs of seeds."""
    ids, trips = matrix(edges)
    runs = communities(edges, "leiden", seeds).groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("zone_id", "community"))).alias("m"))
    runs = runs.select("seed", F.col("m.community").alias("m"))
    pairs = runs.join(runs.select(F.col("seed").alias("seed_b"), F.col("m").alias("mb")), F.col("seed") < F.col("seed_b"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            a, b = [np.asarray(x) for x in df.m], [np.asarray(x) for x in df.mb]
            yield pd.DataFrame({"ari": [G.rand_index(x, y) for x, y in zip(a, b)], "ami": [G.mutual_information(x, y) for x, y in zip(a, b)]})

    scores = pairs.mapInPandas(compare, "ari double, ami double").agg(F.avg("ari").alias("mean_ari"), F.min("ari").alias("min_ari"), F.avg("ami").alias("mean_ami"))
    sizes = runs.select((F.array_max("m") + 1).alias("k")).agg(F.mode("k", True).alias("mode"), F.min("k").alias("least"), F.max("k").alias("most"))
    return sizes.join(scores)


def null_summary(values: DataFrame) -> DataFrame:
    """(null_type, metric, observed, null_mean, null_std, z, percentile) of null draws (null_type, metric, observed, value)."""
    v = values.where("value is not null and not isnan(value)")
    out = v.groupBy("null_type", "metric").agg(F.max("observed").alias("observed"), F.avg("value").alias("null_mean"), F.stddev_pop("value").alias("null_std"), (F.avg((F.col("value") < F.col("observed")).cast("double")) * 100).alias("percentile"))
    return out.withColumn("z", F.try_divide(F.col("observed") - F.col("null_mean"), F.col("null_std")))


def null_models(edges: DataFrame, kind: str, seeds: int) -> DataFrame:
    """Statistics of seeded null graphs: ``er`` (same size), ``configuration`` (same degrees), ``weights`` (same topology)."""
    ids, trips = matrix(edges)
    observed = G.statistics(trips)

    def of(seed: int) -> list[tuple]:
        rng = np.random.default_rng(seed)
        if kind == "er":
            g = G.erdos_renyi(len(ids), int((trips > 0).sum()), rng)
        elif kind == "configuration":
            g = G.configuration(trips, rng)[0]
        else:
            g = G.shuffled_weights(trips, rng)
        base = G.statistics((trips > 0).astype(float)) if kind != "weights" else observed
        return [(kind, name, base[name], value) for name, value in G.statistics(g).items()]

    return null_summary(fan_out(edges.sparkSession, seeds, "null_type string, metric string, observed double, value double", of))


def modularity_significance(edges: DataFrame, seeds: int) -> DataFrame:
    """Modularity of one fixed partition against permuted weights on the same pairs."""
    ids, trips = matrix(edges)
    w = trips + trips.T
    part = G.louvain(w, 42, refine=True)
    q = G.modularity(w, part)

    def of(seed: int) -> list[tuple]:
        upper = np.triu(w, 1)
        x = G.shuffled_weights(upper, np.random.default_rng(seed))
        return [("weights", "modularity", q, G.modularity(x + x.T, part))]

    return null_summary(fan_out(edges.sparkSession, seeds, "null_type string, metric string, observed double, value double", of))


def rich_club_null(edges: DataFrame, percentiles: list[float], seeds: int) -> DataFrame:
    """Weighted rich club against weights permuted over all pairs, strengths recomputed each time."""
    ids, trips = matrix(edges)
    w = np.triu(trips + trips.T, 1)

    def phi(x: np.ndarray, p: float) -> float:
        s = x.sum(axis=0) + x.sum(axis=1)
        rich = s >= np.percentile(s, p)
        inner = x[np.ix_(rich, rich)]
        k = int(rich.sum() * (rich.sum() - 1) // 2)
        best = np.sort(x[x > 0])[::-1][:k].sum()
        return float(inner.sum() / best) if best else 0.0

    def of(seed: int) -> list[tuple]:
        x, cells = np.zeros(w.shape), np.triu_indices(len(w), 1)
        x[cells] = np.random.default_rng(seed).permutation(w[cells])
        return [("weights", f"rich_club_{p:g}", phi(w, p), phi(x, p)) for p in percentiles]

    return null_summary(fan_out(edges.sparkSession, seeds, "null_type string, metric string, observed double, value double", of))


def morans_p(values: DataFrame, neighbours: DataFrame, permutations: int) -> DataFrame:
    """Two-sided permutation p of Moran's I around its expectation."""
    v = values.orderBy("zone_id").toPandas()
    near = neighbours.select("o", "d").toPandas()
    at = {z: i for i, z in enumerate(v["zone_id"])}
    pairs = [(at[o], at[d]) for o, d in zip(near["o"], near["d"]) if o in at and d in at]
    i, j = np.asarray(pairs, dtype=int).reshape(-1, 2).T
    x = v["value"].to_numpy(dtype=float)
    x = x - x.mean()
    k = max(1, len(i) / max(1, len(x)))
    moran = lambda z: float((z[i] * z[j]).sum() / k / (z * z).sum()) if (z * z).sum() else 0.0
    observed, expected = moran(x), -1 / max(1, len(x) - 1)
    draws = fan_out(values.sparkSession, permutations, "value double", lambda s: [(moran(np.random.default_rng(s).permutation(x)),)])
    far = F.abs(F.col("value") - expected) >= abs(observed - expected)
    return draws.agg(F.lit(observed).alias("morans_i"), F.lit(expected).alias("expected"), ((F.count_if(far) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


FIT = "quantity string, n long, alpha double, xmin long, distance double, n_tail long"


def tail_fits(quantities: dict[str, np.ndarray], spark: SparkSession) -> DataFrame:
    names = sorted(quantities)

    def of(i: int) -> list[tuple]:
        x = quantities[names[i]]
        xmin, a, d, n = T.fit(x)
        return [(names[i], len(x), a, xmin, d, n)]

    return fan_out(spark, len(names), FIT, of)


def tail_goodness(x: np.ndarray, spark: SparkSession, reps: int) -> DataFrame:
    """Share of synthetic data sets that fit worse than the data."""
    xmin, a, d, _ = T.fit(x)
    draws = fan_out(spark, reps, "distance double", lambda s: [(T.bootstrap_distance(x, xmin, a, s),)])
    return draws.agg(F.lit(xmin).cast("long").alias("xmin"), F.lit(a).alias("alpha"), F.lit(d).alias("distance"), F.avg((F.col("distance") >= d).cast("double")).alias("p"))


def tail_comparisons(x: np.ndarray, spark: SparkSession, reps: int) -> DataFrame:
    """Vuong tests of the power law against other tails, and the nested test against its truncated form."""
    fitted = tail_goodness(x, spark, reps).first()
    xmin, a, plausible = fitted["xmin"], fitted["alpha"], fitted["p"]

    def of(_: int) -> list[tuple]:
        ll = T.tail_likelihoods(x[x >= xmin], xmin, a)
        rows = [(name, *T.vuong(ll["power"], ll[name])) for name in ("exponential", "lognormal")]
        ratio, p = T.nested(ll["power"], ll["truncated"])
        verdict = T.verdict(plausible, {n: (r, p) for n, r, _v, p in rows})
        return [(*r, verdict) for r in [*rows, ("truncated", -ratio, None, p)]]

    return fan_out(spark, 1, "alternative string, log_ratio double, vuong double, p double, verdict string", of)


def calibrate(edges: DataFrame, distances: DataFrame, low: float = 0.2, high: float = 5.0, rounds: int = 300) -> DataFrame:
    """Exponent at which the doubly constrained model's mean distance meets the observed one, by bisection; null if not bracketed."""
    ids, trips = matrix(edges)
    miles = np.full(trips.shape, np.nan)
    for r in distances.where("miles > 0").toLocalIterator():
        i, j = np.searchsorted(ids, r["o"]), np.searchsorted(ids, r["d"])
        if i < len(ids) and j < len(ids) and ids[i] == r["o"] and ids[j] == r["d"]:
            miles[i, j] = r["miles"]
    ok = np.isfinite(miles)
    t = np.where(ok, trips, 0)
    out, inn = t.sum(axis=1), t.sum(axis=0)

    def model(beta: float) -> np.ndarray:
        f = np.where(ok, np.where(ok, miles, 1) ** -beta, 0)
        b = np.ones(len(ids))
        for _ in range(rounds):
            s = f @ (b * inn)
            a = np.where(s > 0, 1 / np.where(s > 0, s, 1), 0)
            s = f.T @ (a * out)
            new = np.where(s > 0, 1 / np.where(s > 0, s, 1), 0)
            if np.abs(new - b).max() < 1e-10:
                b = new
                break
            b = new
        return a[:, None] * b[None, :] * out[:, None] * inn[None, :] * f

    def of(_: int) -> list[tuple]:
        mean = lambda m: float(np.where(ok, m * np.where(ok, miles, 0), 0).sum() / m.sum())
        want, a, b = mean(t), low, high
        gap = lambda x: mean(model(x)) - want
        if gap(a) * gap(b) > 0:
            return [(None, None, want)]
        for _k in range(50):
            mid = (a + b) / 2
            a, b = (mid, b) if gap(a) * gap(mid) > 0 else (a, mid)
        m = model((a + b) / 2)
        return [((a + b) / 2, float(2 * np.minimum(m, t).sum() / (m.sum() + t.sum())), want)]

    return fan_out(edges.sparkSession, 1, "beta double, cpc double, mean_miles double", of)
