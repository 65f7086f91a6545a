"""Settled scores against dense linear algebra, core numbers and components of several graphs, timelines."""

from __future__ import annotations

import random

import numpy as np
import pytest

from odflux.operators import centrality, evolution, network
from odflux.sources import trips


@pytest.fixture(scope="module")
def graph(spark):
    rnd = random.Random(6)
    rows = [(o, d, rnd.randint(1, 40)) for o in range(14) for d in range(14) if o != d and rnd.random() < 0.3] + [(20, 3, 5), (3, 21, 2), (4, 4, 9)]
    return spark.createDataFrame(rows, "o int, d int, trips long")


def matrix(graph):
    rows = [r for r in graph.collect() if r["o"] != r["d"]]
    ids = sorted({x for r in rows for x in (r["o"], r["d"])})
    t = np.zeros((len(ids), len(ids)))
    for r in rows:
        t[ids.index(r["o"]), ids.index(r["d"])] = r["trips"]
    return ids, t


def test_pagerank_settles(graph):
    ids, t = matrix(graph)
    out = t.sum(axis=1, keepdims=True)
    step = np.where(out > 0, t / np.where(out > 0, out, 1), 1 / len(ids))
    rank = np.full(len(ids), 1 / len(ids))
    for _ in range(200):
        rank = 0.85 * rank @ step + 0.15 / len(ids)
    got = {r["zone_id"]: r["rank"] for r in centrality.settled_pagerank(graph, close=1e-13).collect()}
    assert [got[i] for i in ids] == pytest.approx(rank.tolist(), abs=1e-10)
    loose = [r["rank"] for r in centrality.settled_pagerank(graph).collect()]
    assert sum(loose) == pytest.approx(1) and max(abs(got[r["zone_id"]] - r["rank"]) for r in centrality.settled_pagerank(graph).collect()) < 1e-4
    assert centrality.settled_pagerank(graph.limit(0)).count() == 0


def test_hubs_and_authorities_are_singular_vectors(graph):
    ids, t = matrix(graph)
    u, _s, v = np.linalg.svd(t)
    got = {r["zone_id"]: r for r in centrality.settled_hits(graph).collect()}
    assert [got[i]["hub"] for i in ids] == pytest.approx(np.abs(u[:, 0]).tolist(), abs=1e-7)
    assert [got[i]["authority"] for i in ids] == pytest.approx(np.abs(v[0]).tolist(), abs=1e-7)


def test_eigenvector_is_the_leading_one(graph, spark):
    ids, t = matrix(graph)
    w, x = np.linalg.eig(t.T)
    want = np.abs(np.real(x[:, w.real.argmax()]))
    got = {r["zone_id"]: r["eigenvector"] for r in centrality.settled_eigenvector(graph).collect()}
    assert [got[i] for i in ids] == pytest.approx((want / np.linalg.norm(want)).tolist(), abs=1e-6)
    two = spark.createDataFrame([(1, 2, 3), (2, 1, 3)], "o int, d int, trips long")
    assert [r["eigenvector"] for r in centrality.settled_eigenvector(two).collect()] == pytest.approx([2**-0.5] * 2)


def test_cores_of_several_graphs(spark):
    rnd, rows = random.Random(3), []
    for g in range(4):
        rows += [(g, rnd.randrange(15), rnd.randrange(15), 1) for _ in range(20 + 20 * g)]
    got = {(r["g"], r["zone_id"]): r["core"] for r in centrality.core_numbers(spark.createDataFrame(rows, "g int, o int, d int, trips long"), "g").collect()}
    for g in range(4):
        near: dict = {}
        for _, o, d, _ in [r for r in rows if r[0] == g and r[1] != r[2]]:
            near.setdefault(o, set()).add(d)
            near.setdefault(d, set()).add(o)
        want, k = {}, 0
        while near:
            least = min(near, key=lambda x: len(near[x]))
            k = max(k, len(near[least]))
            want[least] = k
            for other in near.pop(least):
                near[other].discard(least)
        assert {z: c for (x, z), c in got.items() if x == g} == want


def test_a_long_path_is_one_component(spark):
    rnd = random.Random(9)
    order = list(range(300))
    rnd.shuffle(order)
    path = [(a, b, 1) for a, b in zip(order[:200], order[1:200])] + [(a, b, 1) for a, b in zip(order[200:], order[201:])]
    got = {r["zone_id"]: r["component"] for r in centrality.weak_components(spark.createDataFrame(path, "o int, d int, trips long")).collect()}
    assert got == {**{i: min(order[:200]) for i in order[:200]}, **{i: min(order[200:]) for i in order[200:]}}


def test_timeline_fills_months(spark):
    df = spark.createDataFrame([(2000, 11, 4), (2001, 2, 8)], "yr int, mo int, trips long")
    got = [(r["yr"], r["mo"], r["value"], r["share_of_peak"], r["is_least"]) for r in evolution.timeline(df, "trips").orderBy("yr", "mo").collect()]
    assert got == [(2000, 11, 4, 0.5, False), (2000, 12, 0, 0.0, True), (2001, 1, 0, 0.0, True), (2001, 2, 8, 1.0, False)]
    assert evolution.timeline(df.limit(0), "trips").count() == 0


def test_valid_files_are_told_by_their_last_bytes(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    whole = next((tmp_path / "t").glob("*.parquet"))
    (tmp_path / "cut.parquet").write_bytes(whole.read_bytes()[:-3])
    (tmp_path / "small.parquet").write_bytes(b"AR1")
    (tmp_path / "whole.parquet").write_bytes(whole.read_bytes())
    with (tmp_path / "big.parquet").open("wb") as f:  # three gibibytes of hole, which nobody reads
        f.seek(3 << 30)
        f.write(b"PAR1")
    got = {r["path"].rsplit("/", 1)[1]: r["valid"] for r in trips.listing(spark, str(tmp_path / "*.parquet"), 100).collect()}
    assert got == {"cut.parquet": False, "small.parquet": False, "whole.parquet": True, "big.parquet": True}


def test_betweenness_of_a_path(spark):
    df = spark.createDataFrame([(1, 2, 1), (2, 3, 1)], "o int, d int, trips long")
    assert {r["zone_id"]: r["betweenness"] for r in network.betweenness(df).collect()} == {1: 0.0, 2: 0.5, 3: 0.0}


def test_gap_of_the_worst_attack(spark):
    schema = "strategy string, f double, trip_frac double, eff_frac double"
    attacks = spark.createDataFrame([("a", 0.1, 0.5, 0.4), ("a", 0.2, 0.0, 0.0), ("b", 0.1, 0.3, 0.6), ("b", 0.08, 0.9, 0.9)], schema)
    failures = spark.createDataFrame([("random", 0.1, 0.8, 0.7), ("random", 0.0, 1.0, 1.0)], schema)
    r = network.attack_gap(attacks, failures).first()
    assert (r["worst_attack"], r["attack_trip_frac"], r["attack_eff_frac"], r["random_trip_frac"]) == ("b", 0.3, 0.6, 0.8) and r["trip_frac_gap"] == pytest.approx(0.5)
