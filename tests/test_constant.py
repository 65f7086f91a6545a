"""Measures of tables in which something doesn't vary: null, never an error."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from odflux.functions.expressions import safe_corr
from odflux.operators import evolution, spatial, structure


@pytest.fixture(scope="module")
def complete(spark):
    """Every ordered pair of four zones, in two years."""
    rows = [(yr, o, d, 3 + o, 1.0) for yr in (2001, 2002) for o, d in itertools.permutations(range(1, 5), 2)]
    return spark.createDataFrame(rows, "yr int, o int, d int, trips long, sum_dist double")


def test_correlation_needs_two_columns_that_vary(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0, None), (2.0, 4.0, 7.0, 1.0), (3.0, 7.0, 7.0, None)], "a double, b double, c double, d double")
    got = df.select(safe_corr(F.col("a"), F.col("b")), F.corr("a", "b"), safe_corr(F.col("a"), F.col("c")), safe_corr(F.col("a"), F.col("d"))).first()
    assert got[0] == pytest.approx(got[1]) and got[2] is None and got[3] is None
    assert df.limit(0).select(safe_corr(F.col("a"), F.col("b"))).first()[0] is None


def test_a_constant_tenth_doesnt_vary(spark):
    df = spark.range(10).select(F.lit(0.1).alias("x"), F.col("id").alias("y"))
    assert df.select(safe_corr(F.col("x"), F.col("y"))).first()[0] is None


def test_complete_graph(complete):
    assert structure.assortativity(complete.where("yr = 2001")).first()[0] is None
    rows = evolution.panel(complete).collect()
    assert len(rows) == 2 and all(r["degree_assortativity"] is None and r["density"] == 1.0 and r["reciprocity_rho"] is None for r in rows)


def test_rank_correlation_with_a_constant_column(spark):
    df = spark.createDataFrame([(1, 5, 3), (2, 5, 1), (3, 5, 2)], "a int, b int, c int")
    got = {(r["x"], r["y"]): r["rho"] for r in evolution.spearman(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] is None and got["b", "c"] is None and got["a", "c"] == pytest.approx(-0.5)


def test_years_that_share_one_zone(spark):
    rows = [(1, 1, 0), (1, 2, 1), (2, 2, 0), (2, 3, 0), (3, 2, 0), (3, 3, 1)]
    got = {r["yr"]: (r["shared_zones"], r["ari"]) for r in evolution.alignment(spark.createDataFrame(rows, "yr int, zone_id int, community int")).collect()}
    assert got[2] == (1, None) and got[3][0] == 2


def test_one_zone_has_no_expected_autocorrelation(spark):
    zones = spark.createDataFrame([(1, 0.0, 0.0)], "zone_id int, cx_ft double, cy_ft double")
    got = spatial.morans_i(zones.withColumn("v", F.lit(3.0)), zones, "v", 2).collect()
    assert len(got) == 1 and got[0]["morans_i"] is None and got[0]["expected"] is None
