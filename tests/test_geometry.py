"""WKB, GeoParquet and shapefiles: against struct, pyarrow and bytes laid out by hand."""

from __future__ import annotations

import json
import math
import struct

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from odflux.sources import geoparquet, shapefile, wkb

DOUBLES = [0.0, -0.0, 1.0, -1.0, 0.1, 1 / 3, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -123456.789, 2.0**-1022, 2.0**1023, 4503599627370497.5, 0.9999999999999999, math.inf, -math.inf, math.nan]
SQUARE = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
FAR = [(10.0, 10.0), (10.0, 12.0), (11.0, 12.0), (11.0, 10.0), (10.0, 10.0)]


def coded(polygons, order):
    mark = b"\1" if order == "<" else b"\0"
    ring = lambda r: struct.pack(f"{order}I", len(r)) + b"".join(struct.pack(f"{order}dd", *p) for p in r)
    one = lambda p: mark + struct.pack(f"{order}II", 3, len(p)) + b"".join(map(ring, p))
    return mark + struct.pack(f"{order}II", 6, len(polygons)) + b"".join(map(one, polygons))


def plain(polygons):
    return None if polygons is None else [[[(p["x"], p["y"]) for p in r] for r in rings] for rings in polygons]


def test_doubles_keep_every_bit(spark):
    df = spark.createDataFrame([(x,) for x in [*DOUBLES, None]], "x double").select("x", wkb.double_bits(F.col("x")).alias("bits"))
    for r in df.withColumn("back", wkb.bits_double(F.col("bits"))).collect():
        if r["x"] is None:
            assert r["bits"] is None and r["back"] is None
        elif math.isnan(r["x"]):
            assert math.isnan(r["back"])
        else:
            assert struct.pack(">q", r["bits"]) == struct.pack(">d", r["x"]) == struct.pack(">d", r["back"])


@pytest.mark.parametrize("order", "<>")
def test_polygons_of_both_byte_orders(spark, order):
    rows = [(1, coded([[SQUARE, HOLE], [FAR]], order)), (2, coded([], order)), (3, None), (4, coded([[SQUARE]], order)[9:]), (5, struct.pack(f"{order}BIdd", order == "<", 1, 3.5, -2.25))]
    got = {r["id"]: r for r in spark.createDataFrame(rows, "id int, g binary").select("id", wkb.polygons_of(F.col("g")).alias("p"), wkb.point_of(F.col("g")).alias("at")).collect()}
    assert plain(got[1]["p"]) == [[SQUARE, HOLE], [FAR]]
    assert plain(got[2]["p"]) == [] and got[3]["p"] is None and plain(got[4]["p"]) == [[SQUARE]]
    assert got[5]["p"] is None and tuple(got[5]["at"]) == (3.5, -2.25) and got[1]["at"] is None


def test_written_wkb_and_measures(spark):
    rows = [(1, [[SQUARE, HOLE], [FAR]]), (2, [[SQUARE[::-1], HOLE[::-1]]]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, f"id int, p {wkb.POLYGONS}")
    got = {r["id"]: r for r in df.select("id", wkb.multipolygon(F.col("p")).alias("g"), wkb.measures(F.col("p")).alias("m")).collect()}
    assert bytes(got[1]["g"]) == coded([[SQUARE, HOLE], [FAR]], ">") and got[4]["g"] is None
    assert got[1]["m"]["area"] == 17 and got[2]["m"]["area"] == 15 and got[3]["m"]["cx"] is None
    assert got[2]["m"]["cx"] == pytest.approx((16 * 2 - 1.5) / 15) and got[1]["m"]["cy"] == pytest.approx((16 * 2 - 1.5 + 2 * 11) / 17)


def geometries(spark):
    rows = [("a", 1, 2.5, True, coded([[SQUARE, HOLE], [FAR]], "<")), ("b é", None, None, None, None), ("c", -7, 1e-300, False, coded([[SQUARE[::-1]]], ">"))]
    return spark.createDataFrame(rows, "name string, n long, v double, flag boolean, geometry binary")


def test_shapefile_round_trip_by_ranges(spark, tmp_path):
    path = str(tmp_path / "shapes")
    shapefile.write(geometries(spark).repartition(2), path)
    back = shapefile.read(spark, path, records=1)
    assert back.rdd.getNumPartitions() == 3
    got = {r["name"]: r for r in back.withColumn("p", wkb.polygons_of(F.col("geometry"))).collect()}
    assert [got["a"][c] for c in ("n", "v", "flag")] == [1, 2.5, True] and plain(got["a"]["p"]) == [[SQUARE, HOLE], [FAR]]
    assert [got["b é"][c] for c in ("n", "v", "flag", "geometry")] == [None] * 4
    assert [got["c"][c] for c in ("n", "v", "flag")] == [-7, 1e-300, False] and plain(got["c"]["p"]) == [[SQUARE]]
    narrow = shapefile.read(spark, path, ["name"])
    assert narrow.columns == ["name"] and narrow.count() == 3
    shapefile.write(geometries(spark).limit(1), path)
    assert shapefile.read(spark, path).count() == 1
    assert all(not p.name.startswith("_pending") for p in (tmp_path / "shapes").iterdir())


def test_shapefile_bytes_are_the_format_s(spark, tmp_path):
    path = tmp_path / "shapes"
    shapefile.write(geometries(spark).coalesce(1), str(path))
    data, index = next(path.glob("*.shp")).read_bytes(), next(path.glob("*.shx")).read_bytes()
    code, words = struct.unpack_from(">i20xi", data)
    assert (code, words * 2, struct.unpack_from(">i", index, 24)[0] * 2) == (9994, len(data), len(index))
    assert struct.unpack_from("<ii4d", data, 28) == (1000, 5, 0.0, 0.0, 11.0, 12.0)
    at, kinds = 100, []
    for number in (1, 2, 3):
        got, length = struct.unpack_from(">ii", data, at)
        assert got == number and struct.unpack_from(">ii", index, 92 + 8 * number) == (at // 2, length)
        kinds.append(struct.unpack_from("<i", data, at + 8)[0])
        at += 8 + 2 * length
    assert kinds == [5, 0, 5] and at == len(data)


def test_shapefile_refuses_what_it_can_t_keep(spark, tmp_path):
    base = geometries(spark)
    for df in (base.withColumn("name", F.lit("x" * 255)), base.withColumnRenamed("name", "a_very_long_name"), base.drop("geometry"), base.withColumn("geometry", F.lit(b"\1\2\0\0\0\0\0\0\0"))):
        with pytest.raises(Exception):
            shapefile.write(df, str(tmp_path / "bad"))
    shapefile.write(base.limit(0), str(tmp_path / "none"))
    with pytest.raises(Exception):
        shapefile.read(spark, str(tmp_path / "none")).count()


def test_geoparquet_is_read_by_another_library(spark, tmp_path):
    path = str(tmp_path / "geo")
    geoparquet.write(geometries(spark).coalesce(1), path)
    table = pq.read_table(path)
    geo = json.loads(table.schema.metadata[b"geo"])
    assert geo["version"] == "1.0.0" and geo["primary_column"] == "geometry" and geo["columns"]["geometry"]["encoding"] == "WKB"
    assert sorted(map(str, table.column("name").to_pylist())) == ["a", "b é", "c"]
    assert {r["name"]: r["geometry"] for r in geoparquet.read(spark, path).collect()} == {r["name"]: r["geometry"] for r in geometries(spark).collect()}
    with pytest.raises(Exception):
        geoparquet.write(geometries(spark), path, geometry="shape")


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


#: A frame with a hole, a box in the hole, one over the frame's side, one that touches a corner, one far away with two parts.
SHAPES = {1: [[box(0.0, 0.0, 8.0, 8.0), box(2.0, 2.0, 6.0, 6.0)[::-1]]], 2: [[box(3.0, 3.0, 5.0, 5.0)]], 3: [[box(7.0, 1.0, 9.0, 2.0)]], 4: [[box(8.0, 8.0, 9.0, 9.0)]], 5: [[box(20.0, 20.0, 21.0, 21.0)], [box(4.0, 4.0, 4.5, 4.5)]], 6: [], 7: None}


def test_points_within_and_shapes_that_meet(spark):
    from odflux.operators import shapes

    table = spark.createDataFrame(list(SHAPES.items()), f"id long, polygons {wkb.POLYGONS}").repartition(3).persist()
    points = [(1, 1.0, 1.0), (2, 4.0, 4.0), (3, 8.0, 4.0), (4, 0.0, 0.0), (5, 4.25, 4.25), (6, 20.5, 20.5), (7, 30.0, 0.0), (8, 7.5, 1.5), (9, 2.0, 2.0)]
    want = {(1, 1), (2, 2), (2, 5), (3, None), (4, 1), (5, 2), (5, 5), (6, 5), (7, None), (8, 1), (8, 3), (9, None)}
    pairs = {(a, a) for a in (1, 2, 3, 4, 5)} | {(1, 3), (3, 1), (1, 4), (4, 1), (2, 5), (5, 2)}
    for cell in (1.5, 50.0):
        assert {tuple(r) for r in shapes.within(spark.createDataFrame(points, "point_id long, x double, y double"), table, cell).collect()} == want
        met = [tuple(r) for r in shapes.meeting(table, table, cell).collect()]
        assert len(met) == len(set(met)) and set(met) == pairs
    table.unpersist()


def test_holes_join_the_smallest_outline_around_them(spark):
    from odflux.operators import shapes

    whole = {"a": [(box(0, 0, 9, 9), 81.0), (box(1, 1, 8, 8)[::-1], -49.0), (box(2, 2, 7, 7), 25.0), (box(3, 3, 4, 4)[::-1], -1.0), (box(5, 5, 6, 6)[::-1], -1.0)], "b": [(box(0, 0, 2, 2), 4.0)]}
    rows = [(by, tuple(map(float, r[0])), [tuple(map(float, p)) for p in r[:-1]], area) for by, found in whole.items() for r, area in found]
    rings = spark.createDataFrame(rows, "by string, ring struct<x:double,y:double>, points array<struct<x:double,y:double>>, area double")
    got = {r["by"]: plain(r["polygons"]) for r in shapes.assembled(rings, 2.0).collect()}
    assert got["b"] == [[box(0, 0, 2, 2)]] and [len(p) for p in got["a"]] == [2, 3]
    assert got["a"][0] == [box(0, 0, 9, 9), box(1, 1, 8, 8)[::-1]] and got["a"][1][0] == box(2, 2, 7, 7)
