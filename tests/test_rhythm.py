"""Clusters of hourly profiles: planted rhythms are told apart, and each profile belongs to its nearest mean."""

from __future__ import annotations

import numpy as np

from odflux.operators import temporal
from odflux.plans.networks import user_hours

SCHEMA = "zone_id long, hr int, weekend boolean, pickups long"


def test_planted_rhythms(spark):
    peaks = {0: 8, 1: 18, 2: 23}
    rows = [(z, h, False, 500 + z if h == peaks[z % 3] else 5) for z in range(12) for h in range(24)]
    rows += [(z, 3, True, 10**6) for z in range(12)] + [(99, 1, False, 1)]
    got = temporal.rhythm_clusters(spark.createDataFrame(rows, SCHEMA), 100, k=3).persist()
    labels = {r["zone_id"]: r["rhythm_cluster"] for r in got.collect()}
    assert labels == {z: z % 3 for z in range(12)}
    told = {r["rhythm_cluster"]: r for r in temporal.describe_rhythms(got).collect()}
    assert {c: (r["size"], r["peak_hour"], r["examples"]) for c, r in told.items()} == {c: (4, peaks[c], [c + 9, c + 6, c + 3, c]) for c in range(3)}


def test_one_zone_or_none(spark):
    one = spark.createDataFrame([(1, 5, False, 100), (2, 5, True, 100)], SCHEMA)
    assert [tuple(r) for r in temporal.rhythm_clusters(one, 10).select("zone_id", "volume", "rhythm_cluster").collect()] == [(1, 100, 0)]
    assert temporal.rhythm_clusters(one.limit(0), 10).count() == 0


def test_each_profile_is_nearest_to_its_own_mean(spark, sf_dir):
    rows = temporal.rhythm_clusters(user_hours(spark, sf_dir), 20).collect()
    x, c = np.array([r["shares"] for r in rows]), np.array([r["rhythm_cluster"] for r in rows])
    assert np.allclose(x.sum(axis=1), 1) and list(np.bincount(c)) == sorted(np.bincount(c), reverse=True)
    means = np.stack([x[c == k].mean(axis=0) for k in range(c.max() + 1)])
    away = ((x[:, None] - means[None]) ** 2).sum(axis=2)
    assert (away[np.arange(len(x)), c] <= away.min(axis=1) + 1e-3).all()
