"""Hand-computed fixtures of the trip model and its kernels."""

from __future__ import annotations

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from odflux.functions import expressions as E
from odflux.kernels import graph as G
from odflux.kernels import tails
from odflux.operators import aggregates as A
from odflux.operators import cleaning, network, spatial, structure
from odflux.sources import sinks, trips


def at(hour, minute=0, second=0, micro=0, year=2015):
    return dt.datetime(year, 3, 4, hour, minute, second, micro)


RAW = "pu long, do long, t0 timestamp_ntz, t1 timestamp_ntz, fare double, total double, dist double, tip double, rate long"


@pytest.fixture(scope="module")
def dirty(spark):
    """One valid trip, and one for each reason to drop one."""
    good = dict(pu=1, do=2, t0=at(8), t1=at(8, 30), fare=10.0, total=12.0, dist=3.0, tip=1.0, rate=1)
    changes = [{}, {"pu": 0}, {"do": 264}, {"pu": None}, {"t0": None}, {"t1": at(8)}, {"t1": at(8, 0, 30)}, {"t1": at(14, 1)}, {"fare": 0.0}, {"fare": None}, {"dist": 101.0}]
    names = [x.split()[0] for x in RAW.split(", ")]
    return spark.createDataFrame([tuple({**good, **c}[n] for n in names) for c in changes], RAW)


def test_each_reason_drops_its_row(dirty):
    names = set(dirty.columns)
    dropped = dirty if "do_" in names else dirty.withColumnRenamed("do", dirty.columns[1])
    kept = cleaning.clean(dropped).collect()
    assert len(kept) == 1 and kept[0]["dur"] == 30.0 and (kept[0]["wd"], kept[0]["hr"], kept[0]["mo"]) == (2, 8, 3)


def test_seconds_are_boundaries_crossed(spark):
    df = spark.createDataFrame([(at(0, 0, 0, 900_000), at(0, 0, 1, 100_000))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(E.duration_minutes(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1 / 60)


def test_dayparts_of_the_week(spark):
    cells = spark.range(168).select((F.col("id") / 24).cast("int").alias("wd"), (F.col("id") % 24).cast("int").alias("hr"))
    got = {(r["wd"], r["hr"]): r["p"] for r in cells.withColumn("p", E.daypart(F.col("wd"), F.col("hr"))).collect()}
    assert got[5, 23] == got[6, 3] == "late_night_weekend" and got[0, 6] == got[4, 9] == "am_peak" and got[2, 19] == "pm_peak"
    assert got[6, 12] == got[0, 10] == "midday" and got[0, 22] == got[5, 21] == got[0, 5] == "evening" and got[0, 2] == got[5, 7] == "other"


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame([(1, 2, 10), (2, 1, 4), (2, 3, 6), (3, 4, 2), (4, 1, 8), (1, 1, 5)], "o int, d int, trips long")


def test_toy_graph(toy):
    s = A.graph_scalars(toy, 5).first()
    assert (s["total_trips"], s["self_trips"], s["active_nodes"], s["active_edges"], s["filtered_edges"]) == (35, 5, 4, 5, 3)
    assert 8 / 30 in [pytest.approx(x) for x in structure.weighted_reciprocity(toy).first() if isinstance(x, float)]
    r = [x for x in structure.reciprocity(toy).first() if isinstance(x, float)]
    assert 2 / 5 in [pytest.approx(x) for x in r] and (2 / 5 - 5 / 12) / (1 - 5 / 12) in [pytest.approx(x) for x in r]


def test_an_origin_with_one_partner_is_kept(toy):
    got = {(r["o"], r["d"]): r for r in structure.backbone(toy, 0.05).collect()}
    assert got[4, 1]["keep"] and got[4, 1]["alpha"] == 0


def brute_paths(length):
    """Betweenness and distances by listing all simple paths."""
    n = len(length)
    best = np.full((n, n), np.inf)
    through = np.zeros(n)
    for s, t in itertools.permutations(range(n), 2):
        paths = []
        for k in range(n - 1):
            for mid in itertools.permutations([v for v in range(n) if v not in (s, t)], k):
                path = (s, *mid, t)
                cost = sum(length[a, b] for a, b in itertools.pairwise(path))
                if np.isfinite(cost):
                    paths.append((cost, path))
        if paths:
            low = min(c for c, _ in paths)
            best[s, t] = low
            short = [p for c, p in paths if c <= low * (1 + 1e-9)]
            for p in short:
                for v in p[1:-1]:
                    through[v] += 1 / len(short)
    return best, through


def test_paths_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(8):
        w = rng.integers(0, 4, (6, 6)) * (rng.random((6, 6)) < 0.6)
        np.fill_diagonal(w, 0)
        length = G.lengths(w.astype(float))
        best, through = brute_paths(length)
        d = G.all_pairs(length)
        off = ~np.eye(6, dtype=bool)
        assert np.allclose(np.where(np.isfinite(d[off]), d[off], -1), np.where(np.isfinite(best[off]), best[off], -1))
        assert np.allclose(G.betweenness(length), through)
        assert G.efficiency(d) == pytest.approx(np.where(np.isfinite(best[off]), 1 / best[off], 0).sum() / 30)


def test_two_cliques_and_a_bridge():
    w = np.zeros((8, 8))
    w[:4, :4] = w[4:, 4:] = 5
    np.fill_diagonal(w, 0)
    w[3, 4] = w[4, 3] = 1
    truth = np.repeat([0, 1], 4)
    for part in (G.louvain(w, 1), G.louvain(w, 1, refine=True), G.agglomerate(w), G.infomap(w, 1)):
        assert G.rand_index(part, truth) == pytest.approx(1) and G.mutual_information(part, truth) == pytest.approx(1)
    b = G.betweenness(G.lengths(w))
    assert set(np.argsort(-b)[:2]) == {3, 4}
    assert G.survivors(w, np.arange(8) != 3, 1.0, False)["wcc_frac"] == 0.5
    assert G.modularity(w, truth) == pytest.approx(120 / 122 - 2 * 0.25)


def test_cascade_without_load_fails_one_node():
    w = np.ones((5, 5)) - np.eye(5)
    got = G.cascade(w, 1.0)
    assert got["failed"] == 1 and got["steps"] == 0 and got["flow_frac"] == pytest.approx(12 / 20)


def test_zeta_and_power_law():
    assert tails.zeta(2.0, 1.0)[0] == pytest.approx(np.pi**2 / 6, abs=1e-10)
    assert tails.zeta(3.5, 4.0)[0] == pytest.approx(sum((4.0 + k) ** -3.5 for k in range(200_000)), abs=1e-8)
    x = tails.draw(5, 2.5, 4000, np.random.default_rng(0))
    assert x.min() >= 5 and tails.alpha_of(x, 5) == pytest.approx(2.5, abs=0.1)


def test_power_law_scan_tries_every_cut_off():
    x = np.random.default_rng(3).integers(1, 5000, 200)
    for values in (x, np.concatenate([x[:150] % 90 + 1, tails.draw(91, 2.5, 60, np.random.default_rng(1))])):
        cuts = [int(k) for k in np.unique(values)[:-9] if (values >= k).sum() >= 10]
        best = min((tails.ks(values[values >= k], k, tails.alpha_of(values[values >= k], k)), k) for k in cuts)
        xmin, alpha, distance, n = tails.fit(values)
        assert xmin == best[1] and distance == pytest.approx(best[0], abs=1e-6)
        assert alpha == pytest.approx(tails.alpha_of(values[values >= xmin], xmin), abs=1e-6) and n == (values >= xmin).sum()


def test_verdict_follows_the_bootstrap(spark):
    x = tails.draw(5, 2.5, 300, np.random.default_rng(0))
    p = network.tail_goodness(x, spark, 20).first()["p"]
    heads = {r["verdict"].split(";")[0] for r in network.tail_comparisons(x, spark, 20).collect()}
    assert p > 0.1 and heads == {"plausible"}


def test_points_in_polygons(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.2), (3, 9.0, 9.0)], "point_id long, x double, y double")
    shapes = spark.createDataFrame([(7, [0.0, 2.0, 2.0, 0.0], [0.0, 0.0, 2.0, 2.0]), (8, [0.0, 1.0, 0.0], [0.0, 0.0, 1.2])], "poly_id long, xs array<double>, ys array<double>")
    got = sorted(map(tuple, spatial.point_in_polygon(points, shapes, 1.0).collect()), key=str)
    assert got == [(1, 7), (1, 8), (2, 7), (3, None)]


def test_sinks_replace_only_the_partitions_at_hand(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.createDataFrame([(1, 1, 10), (1, 2, 20)], "year int, month int, n int"), path, "year", "month")
    sinks.write_table(spark.createDataFrame([(1, 2, 21)], "year int, month int, n int"), path, "year", "month")
    assert sorted(r["n"] for r in trips.scan_months(spark, path).collect()) == [10, 21]
    sinks.write_pipe(spark.createDataFrame([(1, "N/A")], "a int, b string"), str(tmp_path / "p"))
    assert trips.scan_csv(spark, str(tmp_path / "p"), sep="|").first()["b"] is None


def test_download_plan(spark):
    present = spark.createDataFrame([(2015, m) for m in range(1, 13)] + [(2016, 1)], "year int, month int")
    assert [r["year"] for r in trips.ready_years(present).collect()] == [2015]
    assert trips.wanted_months(spark, [2015, 2016], present).where("not present").count() == 11
    assert [r["year"] for r in trips.common_years(present, present.where("year = 2016")).collect()] == [2016]
