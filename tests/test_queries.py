"""Every query of the trip model: against its SQL where it has one, and against invariants where it hasn't."""

from __future__ import annotations

import numpy as np
import pytest

from odflux.plans import geometry, networks, reaching  # noqa: F401  they register their queries
from odflux.plans.catalog import ORACLES, QUERIES

PLAIN = sorted(set(QUERIES) - set(ORACLES) - {"gravity_by_year", "year_panel_full"})  # a test against bisection is below


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", PLAIN)
def test_query_repeats_itself(name, spark, sf_dir):
    first = sorted(map(str, QUERIES[name](spark, sf_dir).collect()))
    assert first
    if "streamed" not in name:
        assert sorted(map(str, QUERIES[name](spark, sf_dir).collect())) == first


def test_streamed_flows_equal_the_batch(spark, sf_dir):
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    want = events.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()
    got = QUERIES["streamed_hourly_flows"](spark, sf_dir).select("hour", "event_type", "n").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def bisected(t, miles):
    """Exponent and common part of the doubly constrained model, balanced to 1e-10 within 300 rounds, by bisection."""
    far = miles > 0
    t = np.where(far, t, 0.0)
    out, inn = t.sum(axis=1), t.sum(axis=0)

    def model(beta):
        f = np.where(far, np.where(far, miles, 1) ** -beta, 0)
        b = np.ones(len(t))
        for _ in range(300):
            a = np.where(out > 0, 1 / np.maximum(f @ (b * inn), 1e-300), 0)
            new = np.where(inn > 0, 1 / np.maximum(f.T @ (a * out), 1e-300), 0)
            if np.abs(new - b).max() < 1e-10:
                break
            b = new
        return np.outer(a * out, b * inn) * f

    mean = lambda x: (x * miles)[far].sum() / x[far].sum()
    low, high = -1.0, 5.0
    if not mean(model(low)) >= mean(t) >= mean(model(high)):
        return None, None
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(model(mid)) > mean(t) else (low, mid)
    m = model(low)
    return low, 2 * np.minimum(m, t).sum() / (m.sum() + t.sum())


def test_whole_panel_equals_its_parts_and_bisection_of_each_year(spark, sf_dir):
    from odflux.operators import aggregates
    from odflux.plans.catalog import clean_orders
    from odflux.sources import views

    at = {r["zone_id"]: (r["cx_ft"], r["cy_ft"]) for r in views.zones(spark, sf_dir).collect() if r["cx_ft"] is not None}
    ids = sorted(at)
    miles = np.array([[np.hypot(at[i][0] - at[j][0], at[i][1] - at[j][1]) / 5280 for j in ids] for i in ids])
    trips: dict = {}
    for r in aggregates.edges(clean_orders(spark, sf_dir), "yr").collect():
        if r["o"] in at and r["d"] in at:
            trips.setdefault(r["yr"], np.zeros(miles.shape))[ids.index(r["o"]), ids.index(r["d"])] = r["trips"]
    rows = {r["yr"]: r for r in QUERIES["year_panel_full"](spark, sf_dir).collect()}
    for r in QUERIES["year_panel"](spark, sf_dir).collect():
        assert all(rows[r["yr"]][c] == r[c] for c in r.asDict())
    for r in rows.values():
        assert 0 < r["global_efficiency"] and 0 < r["schneider_r"] <= 1 and 0 < r["max_kcore"] < r["n_nodes"] and r["n_communities"] >= 1 and -0.5 <= r["modularity_q"] <= 1
        hubs = [int(h.split(":")[2]) for h in r["top_hubs"].split(",")]
        assert len(hubs) == 3 and hubs == sorted(hubs, reverse=True)
    got = {yr: (r["gravity_beta"], r["gravity_cpc"]) for yr, r in rows.items()}
    assert set(got) == set(trips) and any(b is not None for b, _ in got.values())
    for yr, t in trips.items():
        beta, cpc = bisected(t, miles)
        if beta is None:
            assert got[yr] == (None, None)
        else:
            assert got[yr] == (pytest.approx(beta, abs=1e-5), pytest.approx(cpc, abs=1e-5))


def test_attack_curves_fall_from_one(spark, sf_dir):
    curves: dict = {}
    for r in QUERIES["static_attacks"](spark, sf_dir).collect():
        curves.setdefault(r["strategy"], []).append((r["f"], r["wcc_frac"]))
    assert len(curves) == 3
    for curve in curves.values():
        curve.sort()
        shares = [x for _, x in curve]
        assert shares[0] > 0.9 and shares == sorted(shares, reverse=True) and len(shares) == 31


def test_structure_bundle_equals_its_parts(spark, sf_dir):
    got = QUERIES["structure_bundle"](spark, sf_dir).collect()
    assert len(got) == 1
    parts = {"rho": "gl_reciprocity", "weighted_reciprocity": "weighted_reciprocity", "mean_imbalance": "flow_imbalance", "median_imbalance": "flow_imbalance"}
    for column, name in parts.items():
        assert got[0][column] == QUERIES[name](spark, sf_dir).first()[column]
    near: dict = {}
    for r in QUERIES["undirected_projection"](spark, sf_dir).collect():
        near.setdefault(r["u"], set()).add(r["v"])
        near.setdefault(r["v"], set()).add(r["u"])
    k = 0
    while near:
        least = min(near, key=lambda x: len(near[x]))
        k = max(k, len(near[least]))
        for other in near.pop(least):
            near[other].discard(least)
    assert got[0]["max_kcore"] == k


def test_node_analysis_has_one_row_a_node(spark, sf_dir):
    rows = QUERIES["node_analysis"](spark, sf_dir).collect()
    nodes = {r["zone_id"]: r for r in QUERIES["node_table"](spark, sf_dir).collect() if r["out_strength"] + r["in_strength"]}
    assert len(rows) == len({r["zone_id"] for r in rows}) == len(nodes)
    for r in rows:
        want = nodes[r["zone_id"]]
        assert all(r[c] == want[c] for c in ("out_strength", "in_strength", "self_trips", "zone"))
        assert r["coreness"] > 0 and r["leiden_community"] is not None
    assert abs(sum(r["pagerank"] for r in rows) - 1) < 1e-3


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "asymmetry" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
