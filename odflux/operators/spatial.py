"""Spatial joins, neighbours and autocorrelation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odflux.operators.interaction import nearest
from odflux.operators.iterate import Iterates


def in_box(points: DataFrame, x0: float, x1: float, y0: float, y1: float, x: str = "cx_ft", y: str = "cy_ft") -> DataFrame:
    return points.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def morans_i(nodes: DataFrame, zones: DataFrame, column: str, k: int) -> DataFrame:
    """Observed autocorrelation over the k nearest neighbours, each weighing 1/k, and its expectation."""
    x = nodes.where("cx_ft is not null").select("zone_id", F.col(column).cast("double").alias("v"))
    mean = x.agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    z = x.join(F.broadcast(mean)).select("zone_id", (F.col("v") - F.col("m")).alias("z"), "n")
    near = nearest(zones, k).select("o", "d")
    a, b = z.select(F.col("zone_id").alias("o"), F.col("z").alias("za")), z.select(F.col("zone_id").alias("d"), F.col("z").alias("zb"))
    num = near.join(a, "o").join(b, "d").agg((F.sum(F.col("za") * F.col("zb")) / k).alias("num"))
    den = z.agg(F.sum(F.col("z") * F.col("z")).alias("den"), F.max("n").alias("n"))
    return num.join(den).select("n", F.try_divide("num", "den").alias("morans_i"), F.try_divide(F.lit(-1.0), (F.col("n") - 1).cast("double")).alias("expected"))


def _boxed(polygons: DataFrame) -> DataFrame:
    """Polygons (poly_id, xs, ys) with their bounding boxes."""
    return polygons.select("poly_id", "xs", "ys", F.array_min("xs").alias("x0"), F.array_max("xs").alias("x1"), F.array_min("ys").alias("y0"), F.array_max("ys").alias("y1"))


def point_in_polygon(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """(point_id, poly_id) for points inside polygons; null where none: a grid join on ``cell``-sized squares, then ray casting.

    A polygon is put into each grid square that its box touches, so the join is an equi-join.
    """
    boxed = _boxed(polygons)
    squares = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    gridded = boxed.withColumn("gx", F.explode(squares("x0", "x1"))).withColumn("gy", F.explode(squares("y0", "y1")))
    keyed = points.select("point_id", "x", "y", F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"))
    near = keyed.join(gridded, ["gx", "gy"]).where("x between x0 and x1 and y between y0 and y1").select("point_id", "x", "y", "poly_id", "xs", "ys")

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield df.loc[[_inside(*r) for r in zip(df["x"], df["y"], df["xs"], df["ys"])], ["point_id", "poly_id"]]

    hits = near.mapInPandas(inside, "point_id long, poly_id long")
    return points.select("point_id").join(hits, "point_id", "left")


def _inside(x: float, y: float, xs: np.ndarray, ys: np.ndarray) -> bool:
    xs, ys = np.asarray(xs), np.asarray(ys)
    xn, yn = np.roll(xs, -1), np.roll(ys, -1)
    spans = (ys > y) != (yn > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        crossing = xs + (y - ys) * (xn - xs) / (yn - ys)
    return bool((spans & (x < crossing)).sum() % 2)


def _meet(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> bool:
    """Whether two simple polygons share a point: an edge crossing, or one inside the other."""
    ax, ay, bx, by = map(np.asarray, (ax, ay, bx, by))
    p, q = np.stack([ax, ay], 1)[:, None], np.stack([np.roll(ax, -1), np.roll(ay, -1)], 1)[:, None]
    r, s = np.stack([bx, by], 1)[None], np.stack([np.roll(bx, -1), np.roll(by, -1)], 1)[None]
    turn = lambda a, b, c: np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))
    proper = (turn(p, q, r) * turn(p, q, s) <= 0) & (turn(r, s, p) * turn(r, s, q) <= 0)
    boxes = (np.minimum(p, q) <= np.maximum(r, s)).all(-1) & (np.minimum(r, s) <= np.maximum(p, q)).all(-1)
    return bool((proper & boxes).any()) or _inside(ax[0], ay[0], bx, by) or _inside(bx[0], by[0], ax, ay)


def polygons_intersect(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """(left_id, n): how many polygons of ``right`` each polygon of ``left`` meets."""
    squares = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    grid = lambda p, name: _boxed(p).select(F.col("poly_id").alias(f"{name}_id"), F.col("xs").alias(f"{name}_xs"), F.col("ys").alias(f"{name}_ys"), F.explode(squares("x0", "x1")).alias("gx"), squares("y0", "y1").alias("g")).withColumn("gy", F.explode("g")).drop("g")
    pairs = grid(left, "left").join(grid(right, "right"), ["gx", "gy"]).dropDuplicates(["left_id", "right_id"]).drop("gx", "gy")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield df.loc[[_meet(*r) for r in zip(df.left_xs, df.left_ys, df.right_xs, df.right_ys)], ["left_id", "right_id"]]

    hits = pairs.mapInPandas(meet, "left_id long, right_id long").groupBy("left_id").agg(F.count_distinct("right_id").alias("n"))
    return left.select(F.col("poly_id").alias("left_id")).join(hits, "left_id", "left").na.fill(0, ["n"])


def dissolve(cells: DataFrame, by: str) -> DataFrame:
    """Unit squares (x, y) merged by a key: area, and the outline's length as the sides that no square of the key shares."""
    sides = F.array(*[F.struct(F.lit(k).alias("h"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for k, dx, dy in ((0, 0, 0), (0, 0, 1), (1, 0, 0), (1, 1, 0))])
    edges = cells.select(by, F.explode(sides).alias("s")).groupBy(by, "s").agg(F.count(F.lit(1)).alias("n"))
    outline = edges.where("n = 1").groupBy(by).agg(F.count(F.lit(1)).alias("perimeter"))
    return cells.groupBy(by).agg(F.count(F.lit(1)).alias("area")).join(outline, by)


def _turn(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """How far left of an incoming direction a an outgoing direction b turns, from a half turn right to one left."""
    cross, dot = ax * by - ay * bx, ax * bx + ay * by
    return F.atan2(cross, dot)


def split_at_corners(segments: DataFrame, cell: float) -> DataFrame:
    """Directed segments (by, x0, y0, x1, y1) cut wherever a corner of the same ``by`` lies inside them.

    Corners and segments meet by the grid squares of ``cell`` that a segment's box touches."""
    square = lambda c: F.floor(F.col(c) / cell)
    along = lambda a, b: F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))
    numbered = segments.select("by", "x0", "y0", "x1", "y1").distinct()
    spread = numbered.withColumn("gx", F.explode(along("x0", "x1"))).withColumn("gy", F.explode(along("y0", "y1")))
    corners = segments.select("by", F.col("x0").alias("x"), F.col("y0").alias("y")).union(segments.select("by", "x1", "y1")).distinct().withColumns({"gx": square("x"), "gy": square("y")})
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    t = (F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy
    on = ((F.col("x") - F.col("x0")) * dy - (F.col("y") - F.col("y0")) * dx == 0) & (t > 0) & (t < dx * dx + dy * dy)
    cuts = spread.join(corners, ["by", "gx", "gy"]).where(on).groupBy("by", "x0", "y0", "x1", "y1").agg(F.sort_array(F.collect_set(F.struct(t.alias("t"), "x", "y"))).alias("cuts"))
    met = segments.join(cuts, ["by", "x0", "y0", "x1", "y1"], "left")
    inner = F.coalesce(F.transform("cuts", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))), F.array().cast("array<struct<x:double,y:double>>"))
    points = F.concat(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"))), inner, F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))))
    pieces = met.select("by", points.alias("p")).select("by", F.explode(F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("a"), F.slice("p", F.lit(2), F.size("p") - 1).alias("b"))).alias("s"))
    return pieces.select("by", F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1"))


def outlines(polygons: DataFrame, cell: float) -> DataFrame:
    """Directed boundary segments of the union of each group's polygons (by, xs, ys), which don't overlap; the inside is on
    the left.  A segment that two polygons have in opposite directions is inside the union and cancels.

    A polygon's corners may run either way round; rings of holes are rows of their own, with ``hole`` true."""
    after = lambda c: F.concat(F.slice(c, F.lit(2), F.size(c) - 1), F.slice(c, 1, 1))
    sides = F.arrays_zip(F.col("xs").alias("x0"), F.col("ys").alias("y0"), after("xs").alias("x1"), after("ys").alias("y1"))
    area = F.aggregate(sides, F.lit(0.0), lambda s, e: s + e["x0"] * e["y1"] - e["x1"] * e["y0"])
    ways = polygons.select("by", F.explode(sides).alias("s"), ((area < 0) != F.col("hole")).alias("back"))
    one = lambda a, b: F.when(F.col("back"), F.col(f"s.{b}")).otherwise(F.col(f"s.{a}"))
    directed = ways.select("by", one("x0", "x1").alias("x0"), one("y0", "y1").alias("y0"), one("x1", "x0").alias("x1"), one("y1", "y0").alias("y1")).where("x0 <> x1 or y0 <> y1")
    cut = split_at_corners(directed, cell)
    ahead = F.struct("x0", "y0") < F.struct("x1", "y1")
    ends = [F.when(ahead, F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("x0", "x1", "ax"), ("y0", "y1", "ay"), ("x1", "x0", "bx"), ("y1", "y0", "by_"))]
    net = cut.select("by", *ends, F.when(ahead, 1).otherwise(-1).alias("way")).groupBy("by", "ax", "ay", "bx", "by_").agg(F.sum("way").alias("net")).where("net <> 0")
    flip = lambda a, b: F.when(F.col("net") > 0, F.col(a)).otherwise(F.col(b))
    return net.select("by", flip("ax", "bx").alias("x0"), flip("ay", "by_").alias("y0"), flip("bx", "ax").alias("x1"), flip("by_", "ay").alias("y1"))


def rings(boundary: DataFrame) -> DataFrame:
    """(by, ring, points, area): the rings that directed boundary segments form, in order from their least corner; outer
    rings have a positive area and holes a negative one.

    Each segment is followed by that which turns farthest left of those that leave its end: parts that touch at a corner
    stay apart, and a hole that touches the outline at a corner is a part of it.  Rings are found by pointer doubling: rounds grow with the logarithm of the longest ring."""
    steps = Iterates(boundary.sparkSession, "rings")
    key = F.struct("x0", "y0", "x1", "y1")
    sides = steps.keep("sides", boundary.select("by", key.alias("e"), "x0", "y0", "x1", "y1"))
    out = sides.select("by", F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("e").alias("f"))
    turn = _turn(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("f.x1") - F.col("x1"), F.col("f.y1") - F.col("y1"))
    follow = sides.join(out, ["by", "x1", "y1"]).where("not (f.x1 = x0 and f.y1 = y0)").groupBy("by", "e").agg(F.max_by("f", turn).alias("next"))
    # the least segment of the ring, as far as seen, and how many steps on it lies
    state = steps.keep("state", follow.select("by", "e", "next", F.col("e").alias("least"), F.lit(0).cast("long").alias("at"), F.lit(1).cast("long").alias("jump")))
    longest = state.groupBy("by").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(1, int(longest)).bit_length()):
        ahead = state.select("by", F.col("e").alias("next"), F.col("next").alias("next2"), F.col("least").alias("least2"), F.col("at").alias("at2"))
        met = state.join(ahead, ["by", "next"])
        lower = F.col("least2") < F.col("least")
        state = steps.keep("state", met.select("by", "e", F.col("next2").alias("next"), F.least("least", "least2").alias("least"), F.when(lower, F.col("jump") + F.col("at2")).otherwise(F.col("at")).alias("at"), (F.col("jump") * 2).alias("jump")))
    size = Window.partitionBy("by", "least")
    placed = state.select("by", "least", "e", F.pmod(-F.col("at"), F.count(F.lit(1)).over(size)).alias("place"))
    shoelace = F.sum(F.col("e.x0") * F.col("e.y1") - F.col("e.x1") * F.col("e.y0")) / 2
    made = placed.groupBy("by", "least").agg(F.sort_array(F.collect_list(F.struct("place", F.col("e.x0").alias("x"), F.col("e.y0").alias("y")))).alias("p"), shoelace.alias("area"))
    result = steps.keep("rings", made.select("by", F.struct(F.col("least.x0").alias("x"), F.col("least.y0").alias("y")).alias("ring"), F.transform("p", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias("points"), "area"))
    steps.result("rings")
    return result


def dissolve_polygons(polygons: DataFrame, cell: float) -> DataFrame:
    """(by, ring, points, area) of the unions of polygons (by, xs, ys, hole); see ``outlines`` and ``rings``."""
    return rings(outlines(polygons, cell))
