"""Strong components, shortest paths, mutual information, the monthly store and the streams by small cases."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from odflux.functions.expressions import log_factorial
from odflux.operators import aggregates as A
from odflux.operators import density, evolution, interaction, iterate, reach
from odflux.sources import store
from odflux.streaming import hourly


def components(edges):
    """Smallest id of each node's strong component, by reachability."""
    ids = sorted({x for e in edges for x in e})
    out = {i: {i} for i in ids}
    grown = True
    while grown:
        grown = False
        for a, b in edges:
            for i in ids:
                if a in out[i] and b not in out[i]:
                    out[i].add(b)
                    grown = True
    return {i: min(j for j in ids if j in out[i] and i in out[j]) for i in ids}


def test_components_of_many_graphs_at_once(spark):
    rnd, rows = random.Random(4), []
    for g in range(12):
        n = rnd.randint(2, 14)
        rows += [(g, rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(1, 22))]
    rows += [(20, i, i + 1) for i in range(15)] + [(21, i + 1, i) for i in range(15)] + [(22, i, (i + 1) % 15) for i in range(15)] + [(23, 1, 1)]
    df = spark.createDataFrame(rows, "g int, o int, d int")
    got = {}
    for r in reach.strong_components(df, "g", nodes=spark.createDataFrame([(23, 1), (23, 7)], "g int, id int")).collect():
        got.setdefault(r["g"], {})[r["id"]] = r["component"]
    for g in {r[0] for r in rows} - {23}:
        proper = [(o, d) for x, o, d in rows if x == g and o != d]
        assert got.get(g, {}) == (components(proper) if proper else {}), g
    assert got[23] == {1: 1, 7: 7}
    assert reach.strong_components(df.limit(0), "g").count() == 0


def test_a_circle_falls_apart_as_nodes_go(spark):
    circle = spark.createDataFrame([(i, (i + 1) % 10) for i in range(10)], "o int, d int")
    curves = {(r["seed"], r["gone"]): (r["largest"], r["n"]) for r in reach.failure_curves(circle, 3, 5).collect()}
    assert curves == {(s, g): (10 if g == 0 else 1, 10) for s in range(3) for g in (0, 5)}
    assert reach.schneider_random(circle, 3, 5).first()["schneider_r"] == pytest.approx((1 + 0.1) / 2)


def test_paths_equal_floyd_warshall(spark):
    rnd = random.Random(8)
    rows = [(g, rnd.randrange(12), rnd.randrange(12), rnd.choice([0.0, 0.5, 1.25, 3.0, 9.0])) for g in range(3) for _ in range(30)]
    got = {(r["g"], r["o"], r["d"]): r["length"] for r in reach.shortest_paths(spark.createDataFrame(rows, "g int, o int, d int, length double"), "g").collect()}
    for g in range(3):
        best = {(o, d): min(x[3] for x in rows if x[:3] == (g, o, d)) for gg, o, d, _ in rows if gg == g and o != d}
        for k, i, j in itertools.product(range(12), repeat=3):
            if i != j and (i, k) in best and (k, j) in best:
                best[i, j] = min(best.get((i, j), math.inf), best[i, k] + best[k, j])
        assert {k[1:]: v for k, v in got.items() if k[0] == g} == pytest.approx(best)


def test_detours(spark):
    paths = spark.createDataFrame([(1, 2, 3.0), (2, 1, 5.0), (1, 3, 0.2)], "o int, d int, length double")
    far = spark.createDataFrame([(1, 2, 2.0), (2, 1, 2.0), (1, 3, 0.1), (3, 1, 0.1)], "o int, d int, miles double")
    pairs = reach.detours(paths, far)
    got = reach.detour_summary(pairs).first()
    assert (got["n_pairs"], got["mean"], got["median"], got["max"]) == (3, pytest.approx(2.0), pytest.approx(2.0), pytest.approx(2.5))
    assert [(r["o"], r["d"]) for r in reach.corridors(pairs, 2).collect()] == [(2, 1), (1, 2)]


def test_log_factorials(spark):
    rows = spark.range(400).select("id", log_factorial(F.col("id")).alias("x")).collect()
    assert all(r["x"] == pytest.approx(math.lgamma(r["id"] + 1), abs=1e-9, rel=1e-13) for r in rows)


def mutual(a, b):
    """Adjusted mutual information by its definition, the expectation by all permutations."""
    n = len(a)
    count = lambda x: {v: x.count(v) for v in set(x)}

    def mi(x, y):
        pairs, cx, cy = count(list(zip(x, y))), count(list(x)), count(list(y))
        return sum(k / n * math.log(n * k / (cx[p] * cy[q])) for (p, q), k in pairs.items())

    h = lambda x: -sum(k / n * math.log(k / n) for k in count(list(x)).values())
    every = [mi(a, p) for p in itertools.permutations(b)]
    expected = sum(every) / len(every)
    return (mi(a, b) - expected) / ((h(a) + h(b)) / 2 - expected)


def test_mutual_information_equals_its_mean_over_permutations(spark):
    cases = {"x": ("aabbbcc", "1122233"), "y": ("aabbbcc", "1212121"), "z": ("aaabbbb", "1111112")}
    rows = [(k, a, b) for k, (x, y) in cases.items() for a, b in zip(x, y)]
    rows += [("same", "a", "b")] * 4 + [("one", "a", "b")] + [("alike", str(i % 3), str(i % 3)) for i in range(9)]
    got = {r["k"]: r for r in evolution.agreement(spark.createDataFrame(rows, "k string, a string, b string"), "k").collect()}
    for k, (x, y) in cases.items():
        assert got[k]["ami"] == pytest.approx(mutual(list(x), list(y)), abs=1e-9)
    assert got["same"]["ami"] == 1 and got["alike"]["ami"] == pytest.approx(1) and got["alike"]["ari"] == pytest.approx(1)
    assert got["one"]["items"] == 1 and got["one"]["ami"] is None and got["one"]["ari"] is None
    whole = evolution.adjusted_mutual(spark.createDataFrame([r for r in rows if r[0] == "y"], "k string, a string, b string")).first()
    assert whole["ami"] == pytest.approx(got["y"]["ami"])


def test_calibration_drops_what_has_no_exponent(spark):
    zones = spark.createDataFrame([(i, 5280.0 * x, 5280.0 * y) for i, (x, y) in enumerate([(0, 0), (1, 0), (0, 2), (5, 1), (7, 7)])], "zone_id int, cx_ft double, cy_ft double")
    at = [(0, 0), (1, 0), (0, 2), (5, 1), (7, 7)]
    near = [(1, i, j, round(1000 * math.dist(at[i], at[j]) ** -1.3)) for i in range(5) for j in range(5) if i != j]
    far = [(2, i, j, round(10 * math.dist(at[i], at[j]) ** 3)) for i in range(5) for j in range(5) if i != j]
    got = {r["k"]: r for r in interaction.calibrate(spark.createDataFrame(near + far, "k int, o int, d int, trips long"), zones, "k").collect()}
    assert got[1]["beta"] == pytest.approx(1.3, abs=0.01) and got[1]["cpc"] > 0.999
    assert got[2]["beta"] is None and got[2]["cpc"] is None and got[2]["mean_miles"] > got[1]["mean_miles"]


def test_radiation_keeps_an_origins_trips_and_lets_ties_pass(spark):
    zones = spark.createDataFrame([(1, 0.0, 0.0), (2, 5280.0, 0.0), (3, -5280.0, 0.0), (4, 10560.0, 0.0)], "zone_id int, cx_ft double, cy_ft double")
    e = spark.createDataFrame([(1, 2, 6), (1, 4, 3), (2, 1, 5), (3, 1, 4), (4, 1, 2)], "o int, d int, trips long")
    got = {(r["o"], r["d"]): r["model"] for r in interaction.radiation(e, zones).collect()}
    m = {1: 20.0, 2: 11.0, 3: 4.0, 4: 5.0}
    odds = {2: m[1] * m[2] / (m[1] * (m[1] + m[2])), 3: m[1] * m[3] / (m[1] * (m[1] + m[3])), 4: m[1] * m[4] / ((m[1] + 15) * (m[1] + m[4] + 15))}
    assert {d: got[1, d] for d in odds} == pytest.approx({d: 9 * x / sum(odds.values()) for d, x in odds.items()})


def test_density_equals_direct_sums(spark):
    rnd = random.Random(2)
    pts = [(float(rnd.randint(-6, 6)), float(rnd.randint(-9, 9)), rnd.randint(1, 5)) for _ in range(40)]
    got = density.kernel_density(spark.createDataFrame(pts, "x double, y double, w int"), 1.0, 8.0).collect()
    n = sum(w for *_, w in pts)
    sd = [math.sqrt((sum(w * p[k] ** 2 for *p, w in pts) - sum(w * p[k] for *p, w in pts) ** 2 / n) / (n - 1)) for k in (0, 1)]
    hx, hy = (s * n ** (-1 / 6) for s in sd)
    for r in got[::7]:
        want = sum(w * math.exp(-(((r["gx"] - x) / hx) ** 2) / 2 - ((r["gy"] - y) / hy) ** 2 / 2) for x, y, w in pts) / (2 * math.pi * hx * hy * n)
        assert abs(r["density"] - want) < 1e-6
    assert sum(r["density"] for r in got) == pytest.approx(1, abs=1e-3)
    assert density.kernel_density(spark.createDataFrame([(1.0, 2.0, 3)], "x double, y double, w int"), 1.0).count() == 0


@pytest.fixture()
def months(spark):
    rows = [(o, d, 10.0 + o, 5.0 * d, 6.0 * d, 1.0, 0.5, 1, (o + d) % 7, (3 * o + mo) % 24, mo, 2001) for mo in range(1, 8) for o in range(1, 6) for d in range(1, 6)]
    return store.month_of(spark.createDataFrame(rows, "o int, d int, dur double, fare double, total double, dist double, tip double, rate int, wd int, hr int, mo int, yr int"))


def test_store_goes_on_where_it_broke_off(spark, months, tmp_path):
    made = store.Store(spark, str(tmp_path / "store"))
    assert made.manifest().count() == 0
    with pytest.raises(store.Interrupted):
        made.build(months, 3, stop_before="cost_duration")
    assert made.manifest().count() == 0
    assert made.build(months.where("mo <= 3"), 3) == ["m200101", "m200102", "m200103"]
    with pytest.raises(store.Interrupted):
        made.build(months, 2, stop_before="samples")
    assert made.merged("edges").agg(F.sum("trips")).first()[0] == 75
    assert made.build(months, 10) == ["m200104", "m200105", "m200106", "m200107"]
    assert made.build(months, 10) == []
    made.redo("m200102")
    assert made.merged("hour_weekday").agg(F.sum("trips")).first()[0] == 150
    assert made.build(months, 10) == ["m200102"]
    sorted_rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert sorted_rows(made.merged("edges"), "o", "d", *store.SUMS) == sorted_rows(A.edges(months), "o", "d", *store.SUMS)
    assert sorted_rows(made.merged("hour_weekday"), "wd", "hr", "trips") == sorted_rows(A.hour_weekday(months), "wd", "hr", "trips")
    whole = A.zone_hourly(months)
    assert sorted_rows(made.merged("zone_hourly"), "zone_id", "weekend", "hr", "pickups", "dropoffs") == sorted_rows(whole, "zone_id", "weekend", "hr", "pickups", "dropoffs")
    once = store.PARTIALS["samples"][0](months.withColumn("slice", F.lit("all")))
    assert sorted_rows(made.merged("samples"), "period", "hash", "o", "d") == sorted_rows(once, "period", "hash", "o", "d")


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def test_late_rows_are_dropped_and_batches_replace_themselves(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda rows: spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    put([(1, at(1, 5), 1, "a", 1.0), (2, at(1, 50), 1, "a", 2.0), (3, at(5), 1, "b", 1.0)])
    hourly.appended(stream(), out)
    assert [(r["hour"], r["event_type"], r["n"], r["total"]) for r in hourly.read_batches(spark, out).collect()] == [(at(1), "a", 2, 3.0)]
    put([(4, at(1, 30), 1, "a", 100.0), (5, at(4, 30), 1, "c", 4.0), (6, at(9), 1, "b", 1.0)])
    hourly.appended(stream(), out)
    got = sorted((r["hour"], r["event_type"], r["n"], r["total"]) for r in hourly.read_batches(spark, out).collect())
    assert got == [(at(1), "a", 2, 3.0), (at(4), "c", 1, 4.0), (at(5), "b", 1, 1.0)]
    hourly.appended(stream(), out)
    assert hourly.read_batches(spark, out).count() == 3
    again = spark.createDataFrame([(at(7), "z", 1, 1.0)], "hour timestamp_ntz, event_type string, n long, total double")
    for _ in range(2):
        hourly.batch_sink(f"{out}/hours")(again, 99)
    assert hourly.read_batches(spark, out).count() == 4


def test_iterates_leave_only_the_result(spark):
    steps = iterate.Iterates(spark, "t")
    a = steps.keep("a", spark.range(3))
    a = steps.keep("a", a.select((F.col("id") + 1).alias("id")))
    steps.keep("b", a)
    steps.result("a")
    assert sorted(r[0] for r in a.collect()) == [1, 2, 3] and list(steps.paths) == ["a"]
