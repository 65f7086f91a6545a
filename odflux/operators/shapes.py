"""Multipolygons with holes: put together from rings, points within them, and which of them meet.

Shapes are rows (id, polygons), the polygons of the type ``odflux.sources.wkb.POLYGONS``.  A multipolygon is taken apart into
its polygons, which are connected; each lies in the grid squares of ``cell`` that its box touches, so that every join is one
of equal squares.  A point on a lower or left side is inside, one on an upper or right side isn't; shapes that only touch
meet.  Null or empty polygons hold nothing and meet nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflux.operators.spatial import point_in_polygon
from odflux.sources.wkb import closed

Coordinates = list[np.ndarray]


def assembled(rings: DataFrame, cell: float) -> DataFrame:
    """(by, polygons) of rings (by, ring, points, area): each hole, of negative area, joins the smallest outline around it."""
    keyed = rings.select(F.xxhash64("by", "ring").alias("id"), "by", "ring", closed(F.col("points")).alias("points"), "area")
    outlines, holes = keyed.where("area > 0"), keyed.where("area < 0")
    flat = lambda c: F.transform("points", lambda p: p[c])
    at = holes.select(F.col("id").alias("point_id"), F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"))
    around = point_in_polygon(at, outlines.select(F.col("id").alias("poly_id"), flat("x").alias("xs"), flat("y").alias("ys")), cell).where("poly_id is not null")
    owners = outlines.select(F.col("id").alias("poly_id"), F.col("by").alias("owner"), "area")
    hung = around.join(holes.select(F.col("id").alias("point_id"), "by", F.col("points").alias("hole")), "point_id").join(owners, "poly_id").where(F.col("by").eqNullSafe(F.col("owner")))
    owned = hung.groupBy("point_id").agg(F.min_by(F.struct("poly_id", "hole"), F.struct("area", "poly_id")).alias("o")).groupBy(F.col("o.poly_id").alias("id")).agg(F.sort_array(F.collect_list("o.hole")).alias("holes"))
    whole = outlines.join(owned, "id", "left").select("by", "ring", F.concat(F.array("points"), F.coalesce("holes", F.slice(F.array("points"), 1, 0))).alias("polygon"))
    placed = whole.groupBy("by").agg(F.sort_array(F.collect_list(F.struct("ring", "polygon"))).alias("p"))
    return placed.select("by", F.transform("p", lambda p: p["polygon"]).alias("polygons"))


def _squares(low: Column, high: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))


def _parts(shapes: DataFrame, cell: float, name: str) -> DataFrame:
    """A row for each polygon and grid square: its number within the shape, the coordinates of its rings, its outline's box."""
    part = shapes.select(F.col("id").alias(f"{name}_id"), F.posexplode("polygons").alias(f"{name}_part", "p")).where(F.size("p") > 0)
    flat = lambda c: F.transform("p", lambda r: F.transform(r, lambda q: q[c]))
    part = part.select(f"{name}_id", f"{name}_part", flat("x").alias(f"{name}_xs"), flat("y").alias(f"{name}_ys")).where(F.size(F.col(f"{name}_xs")[0]) > 0)
    box = [(f"{name}_{a}{e}", f(F.col(f"{name}_{a}s")[0])) for a in "xy" for e, f in ((0, F.array_min), (1, F.array_max))]
    boxed = part.withColumns(dict(box))
    return boxed.withColumn("gx", _squares(F.col(f"{name}_x0"), F.col(f"{name}_x1"), cell)).withColumn("gy", _squares(F.col(f"{name}_y0"), F.col(f"{name}_y1"), cell))


def _sides(xs: Coordinates, ys: Coordinates) -> np.ndarray:
    """Sides of closed rings as rows (x0, y0, x1, y1)."""
    return np.concatenate([np.stack([x[:-1], y[:-1], x[1:], y[1:]], 1) for x, y in zip(map(np.asarray, xs), map(np.asarray, ys))])


def _holds(sides: np.ndarray, x: float, y: float) -> bool:
    x0, y0, x1, y1 = sides[(sides[:, 1] > y) != (sides[:, 3] > y)].T
    return bool((x < x0 + (y - y0) * (x1 - x0) / (y1 - y0)).sum() % 2)


def _touch(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether a side of one shape shares a point with a side of the other."""
    for x0, y0, x1, y1 in a:
        near = b[(np.minimum(b[:, 0], b[:, 2]) <= max(x0, x1)) & (np.maximum(b[:, 0], b[:, 2]) >= min(x0, x1)) & (np.minimum(b[:, 1], b[:, 3]) <= max(y0, y1)) & (np.maximum(b[:, 1], b[:, 3]) >= min(y0, y1))]
        left = lambda px, py: np.sign((x1 - x0) * (py - y0) - (y1 - y0) * (px - x0))  # noqa: E731, B023
        dx, dy = near[:, 2] - near[:, 0], near[:, 3] - near[:, 1]
        across = lambda px, py: np.sign(dx * (py - near[:, 1]) - dy * (px - near[:, 0]))  # noqa: E731, B023
        if ((left(near[:, 0], near[:, 1]) * left(near[:, 2], near[:, 3]) <= 0) & (across(x0, y0) * across(x1, y1) <= 0)).any():
            return True
    return False


def _meet(axs: Coordinates, ays: Coordinates, bxs: Coordinates, bys: Coordinates) -> bool:
    a, b = _sides(axs, ays), _sides(bxs, bys)
    return _touch(a, b) or _holds(b, *a[0, :2]) or _holds(a, *b[0, :2])


def within(points: DataFrame, shapes: DataFrame, cell: float) -> DataFrame:
    """(point_id, id) for each point (point_id, x, y) and each shape that it lies in; null where there is none."""
    keyed = points.select("point_id", "x", "y", F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"))
    near = keyed.join(_parts(shapes, cell, "s"), ["gx", "gy"]).where("x between s_x0 and s_x1 and y between s_y0 and s_y1").select("point_id", "x", "y", "s_id", "s_xs", "s_ys")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            hits = [_holds(_sides(xs, ys), x, y) for x, y, xs, ys in zip(df.x, df.y, df.s_xs, df.s_ys)]
            yield df.loc[hits, ["point_id", "s_id"]].rename(columns={"s_id": "id"})

    return points.select("point_id").join(near.mapInPandas(keep, "point_id long, id long").distinct(), "point_id", "left")


def meeting(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """(left_id, right_id) of the shapes that share a point; a pair of polygons is looked at in the first square of both."""
    both = _parts(left, cell, "l").join(_parts(right, cell, "r"), ["gx", "gy"])
    first = [F.col(g) == F.floor(F.greatest(f"l_{a}0", f"r_{a}0") / cell) for g, a in (("gx", "x"), ("gy", "y"))]
    boxes = [(F.col(f"l_{a}0") <= F.col(f"r_{a}1")) & (F.col(f"r_{a}0") <= F.col(f"l_{a}1")) for a in "xy"]
    near = both.where(first[0] & first[1] & boxes[0] & boxes[1]).select("l_id", "l_xs", "l_ys", "r_id", "r_xs", "r_ys")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            hits = [_meet(*r) for r in zip(df.l_xs, df.l_ys, df.r_xs, df.r_ys)]
            yield df.loc[hits, ["l_id", "r_id"]].rename(columns={"l_id": "left_id", "r_id": "right_id"})

    return near.mapInPandas(keep, "left_id long, right_id long").distinct()


def crosswalk(zones: DataFrame, centres: DataFrame, tracts: DataFrame, cell: float) -> DataFrame:
    """(id, rep_tract, n_tracts): the tract around each zone's centre (id, cx, cy), the least of several, and how many it meets."""
    rep = within(centres.select(F.col("id").alias("point_id"), F.col("cx").alias("x"), F.col("cy").alias("y")), tracts, cell)
    rep = rep.groupBy(F.col("point_id").alias("id")).agg(F.min("id").alias("rep_tract"))
    n = meeting(zones, tracts, cell).groupBy(F.col("left_id").alias("id")).agg(F.count(F.lit(1)).alias("n_tracts"))
    return zones.select("id").join(rep, "id", "left").join(n, "id", "left").na.fill(0, ["n_tracts"])
