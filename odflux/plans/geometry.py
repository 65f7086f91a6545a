"""Queries of geometry files, of the zone and tract dimensions, and of their crosswalk."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from odflux.operators import shapes, spatial
from odflux.operators.iterate import Iterates, delete, shared_folder
from odflux.plans.catalog import query, rounded
from odflux.plans.reaching import bricks
from odflux.sources import geoparquet, shapefile, views, wkb

CELL = 2.0

BLOCKS_SQL = "blocks AS (SELECT n_nationkey, n_name, r_regionkey, r_name, 2 * (n_nationkey % 5) + 0.75::DOUBLE * ((n_nationkey // 5) % 2) AS x, CAST(n_nationkey // 5 AS DOUBLE) AS y FROM nation JOIN region ON n_regionkey = r_regionkey)"
REGIONS_SQL = f"{BLOCKS_SQL}, regions AS (SELECT r_regionkey, r_name, 2.0::DOUBLE * count(*) AS area, avg(x + 1.25::DOUBLE) AS cx, avg(y + 0.5::DOUBLE) AS cy FROM blocks GROUP BY ALL)"


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def blocks(spark, sf_dir):
    """A polygon for each nation, as WKB: (tract, name, zone, region, geometry)."""
    ring = wkb.closed(F.zip_with("xs", "ys", lambda x, y: F.struct(x.alias("x"), y.alias("y"))))
    return bricks(spark, sf_dir).select(F.col("n_nationkey").cast("long").alias("tract"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("zone"), F.col("by").alias("region"), wkb.multipolygon(F.array(F.array(ring))).alias("geometry"))


@query("SELECT zone_id, zone, cx_ft AS x, cy_ft AS y, CASE WHEN cx_ft IS NOT NULL THEN 21 END AS geometry_bytes FROM zones", views.ZONES)
def zones_geoparquet(spark, sf_dir):
    """The zones' points written as GeoParquet and read back."""
    path = _folder(spark, "zones")
    geoparquet.write(views.zones(spark, sf_dir).select("zone_id", "zone", wkb.point(F.col("cx_ft"), F.col("cy_ft")).alias("geometry")), path)
    at = wkb.point_of(F.col("geometry"))
    return geoparquet.read(spark, path).select("zone_id", "zone", at["x"].alias("x"), at["y"].alias("y"), F.octet_length("geometry").alias("geometry_bytes"))


@query("SELECT n_nationkey AS tract, n_name AS name, r_name AS region, 2.0::DOUBLE AS area, x + 1.25::DOUBLE AS cx, y + 0.5::DOUBLE AS cy FROM blocks", BLOCKS_SQL)
def blocks_shapefile(spark, sf_dir):
    """The nations' polygons written as shapefiles and read back, with area and centroid."""
    path = _folder(spark, "blocks")
    shapefile.write(blocks(spark, sf_dir), path)
    read = shapefile.read(spark, path, ["tract", "name", "region", "geometry"])
    return rounded(read.select("tract", "name", "region", wkb.measures(wkb.polygons_of(F.col("geometry"))).alias("m")).select("tract", "name", "region", "m.*"))


def zone_dimension_table(spark, sf_dir):
    """Path of the regions, dissolved from a shapefile of blocks, with area and centroid, as GeoParquet."""
    source, path = _folder(spark, "blocks"), _folder(spark, "regions")
    shapefile.write(blocks(spark, sf_dir), source)
    read = shapefile.read(spark, source, ["zone", "region", "geometry"])
    ring = F.explode(F.flatten(F.transform(wkb.polygons_of(F.col("geometry")), lambda p: F.transform(p, lambda r, i: F.struct(F.slice(r, F.lit(1), F.size(r) - 1).alias("r"), (i > 0).alias("hole"))))))
    flat = read.select(F.col("zone").alias("by"), ring.alias("s")).select("by", F.transform("s.r", lambda p: p["x"]).alias("xs"), F.transform("s.r", lambda p: p["y"]).alias("ys"), F.col("s.hole").alias("hole"))
    made = shapes.assembled(spatial.dissolve_polygons(flat, CELL), CELL).select(F.col("by").alias("zone"), "polygons", wkb.measures(F.col("polygons")).alias("m"))
    named = made.join(read.groupBy("zone").agg(F.min("region").alias("region")), "zone")
    geoparquet.write(named.select("zone", "region", "m.area", "m.cx", "m.cy", wkb.multipolygon(F.col("polygons")).alias("geometry")), path)
    delete(spark, source)
    return path


@query("SELECT r_regionkey AS zone, r_name AS region, round(area, 6) AS area, round(cx, 6) AS cx, round(cy, 6) AS cy FROM regions", REGIONS_SQL)
def zone_dimension(spark, sf_dir):
    return rounded(geoparquet.read(spark, zone_dimension_table(spark, sf_dir)).drop("geometry"))


@query(
    """SELECT g.r_regionkey AS zone, min(b.n_nationkey) AS rep_tract, min(n_tracts) AS n_tracts FROM regions g LEFT JOIN blocks b
  ON y <= cy AND cy < y + 1 AND x + (cy - y) / 2 <= cx AND cx < x + 2 + (cy - y) / 2 JOIN touched t ON t.r_regionkey = g.r_regionkey GROUP BY 1""",
    f"""{REGIONS_SQL}, touched AS (SELECT a.r_regionkey, count(DISTINCT b.n_nationkey) AS n_tracts FROM blocks a JOIN blocks b
  ON (a.y = b.y AND abs(a.x - b.x) <= 2) OR (b.y = a.y + 1 AND b.x - a.x BETWEEN -1.5 AND 2.5) OR (a.y = b.y + 1 AND a.x - b.x BETWEEN -1.5 AND 2.5) GROUP BY 1)""",
)
def zone_crosswalk(spark, sf_dir):
    """The block around each region's centroid, and the blocks that it meets; polygons are decoded once and stored."""
    steps, path = Iterates(spark, "crosswalk"), _folder(spark, "tracts")
    geoparquet.write(blocks(spark, sf_dir), path)
    decoded = lambda df, key: df.select(F.col(key).alias("id"), wkb.polygons_of(F.col("geometry")).alias("polygons"))
    zones = geoparquet.read(spark, zone_dimension_table(spark, sf_dir))
    tracts = steps.keep("tracts", decoded(geoparquet.read(spark, path), "tract"))
    found = shapes.crosswalk(steps.keep("zones", decoded(zones, "zone")), zones.select(F.col("zone").alias("id"), "cx", "cy"), tracts, CELL)
    return found.withColumnRenamed("id", "zone")
