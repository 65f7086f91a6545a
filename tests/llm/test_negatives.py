"""Hard negatives against every anchor's inner products with every row."""

from __future__ import annotations

import math

import numpy as np
import pytest

from odflux.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    kept = []
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    anchors = {(i, lab, tuple(v)) for i, lab, v in kept if i % 50 == 0}
    out = []
    for a, la, va in anchors:
        near = sorted((-sum(x * y for x, y in zip(va, v)), i, lab) for i, lab, v in kept if i != a)
        for s, p, _ in [r for r in near if r[2] == la][:5]:
            fits = [(-t, i) for t, i, lab in near if lab != la and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, k + 1, i, -s, t) for k, (t, i) in enumerate(fits[:3])]
    return sorted(out)


def clusters(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return [(int(i), [float(x) for x in centres[i % 12] + rng.normal(size=dims) * rng.choice([0.02, 0.5])], int(rng.integers(0, 4))) for i in range(n)]


AWKWARD = [
    *[(1000 + i, [1.0, 0.5, -0.25], i % 3) for i in range(700)],
    *[(i, [math.sin(i), math.cos(i), (i % 9) / 4], i % 4) for i in range(300)],
    (50, [math.sin(50), math.cos(50), 5 / 4], 2),
    (100, [0.1, 0.2, 0.3], 1),
    (2000, None, 1),
    (2050, [1.0, None, 2.0], 1),
    (2100, [1.0, float("nan"), 2.0], 1),
    (2150, [1.0, float("inf"), 2.0], 1),
    (2200, [1.0, 1.0, 1.0], None),
    (None, [1.0, 1.0, 1.0], 1),
    (2250, [1.0], 1),
    (2300, [], 1),
    (2350, [0.0, 0.0, 0.0], 1),
    (-50, [-1.0, -0.5, 0.1], 2),
    (2401, [3000.0, 3000.0, 3000.0], 3),
]


def result(df):
    return sorted(map(tuple, negatives.mine(df).collect()))


@pytest.mark.parametrize("dims", [2, 16])
def test_clusters_equal_brute_force(spark, dims):
    rows = clusters(3000, dims)
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_awkward_rows_equal_brute_force(spark):
    assert result(spark.createDataFrame(AWKWARD, SCHEMA)) == brute(AWKWARD)


def test_rounds_change_nothing(spark, monkeypatch):
    rows = clusters(900, 4)
    monkeypatch.setattr(negatives, "ROUND", 5)
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_bounds_leave_cells_out(spark):
    """Rows of far apart groups: an anchor's searches need few of the cells."""
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(4 * f(i % 16 * np.pi / 8) + rng.normal() * 0.01) for f in (np.cos, np.sin)], int(rng.integers(0, 3))) for i in range(4000)]
    space, index, path = negatives.build(negatives.usable(spark.createDataFrame(rows, SCHEMA)))
    near = index.where("vec_id = 50").toPandas()
    low, high = np.array([negatives.LOW / 100 * 1e6]), np.array([np.inf])
    search = negatives.Search(space, near, np.array([0]), low, high, 3, False)
    assert len(space.reaches) >= 8 and 0 < len(search.cells()) <= len(space.reaches) // 2
    assert index.count() == len(rows)


def test_big_components_are_exact(spark):
    rows = [(i, [float(2**24 - i), float(i * i), 3.0], i % 2) for i in range(0, 200)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_other_columns_and_nothing(spark):
    rows = [(*r, "x", 1) for r in clusters(120, 3)]
    df = spark.createDataFrame(rows, SCHEMA + ", cell string, unit int")
    assert result(df) == brute(rows)
    assert result(df.limit(0)) == [] and negatives.mine(df.limit(0)).columns == [c.split()[0] for c in negatives.RESULT.split(", ")]
    assert result(df.where("vec_id % 50 <> 0")) == []
