"""Dissolved polygons against their areas, outlines and rings worked out by hand or piece by piece."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from odflux.operators import spatial

SCHEMA = "by string, xs array<double>, ys array<double>, hole boolean"


def box(x0, y0, x1, y1):
    return [x0, x1, x1, x0], [y0, y0, y1, y1]


def dissolved(spark, rows):
    out = {}
    for r in spatial.dissolve_polygons(spark.createDataFrame([(by, [float(x) for x in xs], [float(y) for y in ys], hole) for by, xs, ys, hole in rows], SCHEMA), 1.5).collect():
        out.setdefault(r["by"], []).append((r["area"], [(p["x"], p["y"]) for p in r["points"]]))
    return {k: sorted(v) for k, v in out.items()}


def shoelace(points):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1])) / 2


def test_two_boxes_with_a_corner_inside_a_side(spark):
    got = dissolved(spark, [("a", *box(0, 0, 4, 1), False), ("a", *box(1, 1, 2, 3), False), ("b", *box(0, 0, 1, 1), False)])
    assert [a for a, _ in got["a"]] == [6.0] and [a for a, _ in got["b"]] == [1.0]
    assert got["a"][0][1] == [(0, 0), (4, 0), (4, 1), (2, 1), (2, 3), (1, 3), (1, 1), (0, 1)]


def test_slanted_polygons_in_either_direction(spark):
    left, right = ([0, 2, 3, 1], [0, 0, 2, 2]), ([2, 5, 3], [0, 0, 2])
    got = dissolved(spark, [("a", *left, False), ("a", right[0][::-1], right[1][::-1], False)])
    assert [a for a, _ in got["a"]] == [7.0]
    assert got["a"][0][1][0] == (0, 0) and set(got["a"][0][1]) == {(0, 0), (2, 0), (5, 0), (3, 2), (1, 2)}


def test_a_frame_keeps_its_hole_and_a_filled_one_loses_it(spark):
    frame = [("a", *box(0, 0, 3, 1), False), ("a", *box(0, 2, 3, 3), False), ("a", *box(0, 1, 1, 2), False), ("a", *box(2, 1, 3, 2), False)]
    got = dissolved(spark, frame)["a"]
    assert [a for a, _ in got] == [-1.0, 9.0] and all(shoelace(p) == a for a, p in got)
    assert [a for a, _ in dissolved(spark, [*frame, ("a", *box(1, 1, 2, 2), False)])["a"]] == [9.0]
    holed = [("a", *box(0, 0, 4, 4), False), ("a", *box(1, 1, 2, 2), True), ("a", *box(1, 1, 2, 1.5), False)]
    assert [a for a, _ in dissolved(spark, holed)["a"]] == [-0.5, 16.0]


def test_parts_that_touch_at_a_corner_stay_apart(spark):
    got = dissolved(spark, [("a", *box(0, 0, 1, 1), False), ("a", *box(1, 1, 2, 2), False), ("a", *box(5, 5, 6, 7), False)])["a"]
    assert [a for a, _ in got] == [1.0, 1.0, 2.0]


def test_a_long_ring_is_in_order(spark):
    cells = [("a", *box(x, 0, x + 1, 1), False) for x in range(60)] + [("a", *box(x, 1, x + 1, 3), False) for x in range(0, 60, 2)]
    got = dissolved(spark, cells)["a"]
    assert len(got) == 1 and got[0][0] == 60 + 60 == shoelace(got[0][1])
    assert all(a[0] == b[0] or a[1] == b[1] for a, b in zip(got[0][1], got[0][1][1:] + got[0][1][:1]))


@pytest.mark.parametrize("rows", [[], [("a", [0.0, 1.0, 1.0], [0.0, 0.0, 0.0], False)]])
def test_nothing(spark, rows):
    df = spatial.dissolve_polygons(spark.createDataFrame(rows, SCHEMA), 1.0)
    assert df.agg(F.coalesce(F.sum("area"), F.lit(0.0))).first()[0] == 0
