"""Kernel density of weighted points on a grid."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kernel_density(points: DataFrame, cell: float, reach: float = 6.0) -> DataFrame:
    """(gx, gy, density) of points (x, y, w): a Gaussian for each, with Scott's bandwidth for each axis, at the grid points
    up to ``reach`` bandwidths away.

    Points are first counted into the cells around the grid points, so the work is that of occupied cells times a kernel's
    cells, whatever the number of points; the bandwidths come from one aggregate.  No spread on an axis, or no weight,
    leaves no density.
    """
    bins = points.groupBy(F.round(F.col("x") / cell).cast("long").alias("bx"), F.round(F.col("y") / cell).cast("long").alias("by")).agg(F.sum("w").cast("double").alias("w"))
    n = F.sum("w").cast("double")
    spread = lambda c: F.sqrt(F.try_divide(F.sum(F.col("w") * F.col(c) * F.col(c)) - F.try_divide(F.sum(F.col("w") * F.col(c)) * F.sum(F.col("w") * F.col(c)), n), n - 1)) * F.pow(n, F.lit(-1 / 6))
    scale = points.agg(n.alias("n"), spread("x").alias("hx"), spread("y").alias("hy")).where("hx > 0 and hy > 0")
    wide = lambda h: F.floor(F.col(h) * reach / cell).cast("long")
    spreading = bins.join(F.broadcast(scale)).withColumn("i", F.explode(F.sequence(-wide("hx"), wide("hx")))).withColumn("j", F.explode(F.sequence(-wide("hy"), wide("hy"))))
    bell = lambda k, h: F.exp(-0.5 * F.pow(F.col(k) * cell / F.col(h), F.lit(2.0)))
    value = F.col("w") * bell("i", "hx") * bell("j", "hy") / (2 * math.pi * F.col("hx") * F.col("hy") * F.col("n"))
    return spreading.groupBy((F.col("bx") + F.col("i")).alias("gx"), (F.col("by") + F.col("j")).alias("gy")).agg(F.sum(value).alias("density"))
