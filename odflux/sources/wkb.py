"""Geometry as well-known binary (WKB), coded and read by column expressions, and its measures.

A polygon column has the type ``POLYGONS``: polygons of closed rings, an outline first and then its holes.  Every double is
kept to its last bit.  Written WKB is in network byte order; both orders are read.

Defined cases: null in, null out; an empty list of polygons is an empty multipolygon, with area 0 and no centroid; points are
read by ``point_of`` and polygons by ``polygons_of``, any other kind of geometry gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"
POLYGONS = f"array<array<{RING}>>"
#: Geometry types of the format, and the bits of special doubles.
POINT, POLYGON, MULTIPOLYGON = 1, 3, 6
NAN, INFINITY, SIGN = 0x7FF8 << 48, 0x7FF0 << 48, -(1 << 63)
HALF = 2.0**537


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def double_bits(x: Column) -> Column:
    """The bits of a double as a long: powers of two scale it exactly, so its exponent and fraction can be worked out."""
    return _let(x, lambda x: _let(F.floor(F.log2(F.abs(x))), lambda guess: _double_bits(x, guess)))


def _double_bits(x: Column, guess: Column) -> Column:
    a = F.abs(x)
    e = guess + F.when(a >= F.pow(F.lit(2.0), guess + 1), 1).when(a < F.pow(F.lit(2.0), guess), -1).otherwise(0)
    normal = (e + 1023) * (1 << 52) + ((a * F.pow(F.lit(2.0), -e) - 1) * 2.0**52).cast("long")
    size = F.when(F.isnan(x), NAN).when(a == float("inf"), INFINITY).when(a < 2.0**-1022, (a * HALF * HALF).cast("long")).otherwise(normal)
    negative = (x < 0) | ((x == 0) & F.startswith(x.cast("string"), F.lit("-")))
    return F.when(negative, size.cast("long").bitwiseOR(F.lit(SIGN))).otherwise(size.cast("long"))


def bits_double(bits: Column) -> Column:
    """The double that a long's bits stand for."""
    return _let(bits, _bits_double)


def _bits_double(bits: Column) -> Column:
    field = F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(2047))
    part = bits.bitwiseAND(F.lit((1 << 52) - 1))
    whole = (part + F.when(field > 0, 1 << 52).otherwise(0)).cast("double") * F.pow(F.lit(2.0), F.greatest(field, F.lit(1)) - 1075)
    size = F.when(field < 2047, whole).when(part == 0, float("inf")).otherwise(float("nan"))
    return F.when(bits < 0, -size).when(bits >= 0, size)


def _hex_int(n: Column) -> Column:
    return F.lpad(F.hex(n.cast("long")), 8, "0")


def _hex_double(x: Column) -> Column:
    return F.lpad(F.hex(double_bits(x)), 16, "0")


def _hex_point(p: Column) -> Column:
    return F.concat(_hex_double(p["x"]), _hex_double(p["y"]))


def _hex_list(items: Column, one) -> Column:
    return F.concat(_hex_int(F.size(items)), F.array_join(F.transform(items, one), ""))


def _header(kind: int) -> Column:
    return F.lit(f"00{kind:08X}")


def point(x: Column, y: Column) -> Column:
    """WKB of a point; null where a coordinate is null."""
    return F.unhex(F.concat(_header(POINT), _hex_double(x), _hex_double(y)))


def multipolygon(polygons: Column) -> Column:
    """WKB of a column of the type ``POLYGONS``."""
    ring = lambda r: _hex_list(r, _hex_point)
    return F.unhex(F.concat(_header(MULTIPOLYGON), _hex_list(polygons, lambda p: F.concat(_header(POLYGON), _hex_list(p, ring)))))


def closed(points: Column) -> Column:
    """A ring whose first point is its last as well."""
    return F.when(F.size(points) == 0, points).when(points[0] == F.element_at(points, -1), points).otherwise(F.concat(points, F.slice(points, 1, 1)))


def _bytes(wkb: Column, at: Column, n: int, little: Column) -> Column:
    """Signed number of ``n`` bytes at a place counted from 1."""
    digits = F.hex(F.substring(wkb, at, F.lit(n)))
    swapped = lambda d: F.concat(*[F.substring(d, 2 * i + 1, 2) for i in reversed(range(n))])
    return _let(digits, lambda d: F.conv(F.when(little, swapped(d)).otherwise(d), 16, -10).cast("long"))


def _little(wkb: Column, at: Column) -> Column:
    return F.hex(F.substring(wkb, at, F.lit(1))) == "01"


def _kind(wkb: Column, at: Column) -> Column:
    return _bytes(wkb, at + 1, 4, _little(wkb, at))


def _point_at(wkb: Column, at: Column, little: Column) -> Column:
    return F.struct(bits_double(_bytes(wkb, at, 8, little)).alias("x"), bits_double(_bytes(wkb, at + 8, 8, little)).alias("y"))


def point_of(wkb: Column) -> Column:
    """(x, y) of a WKB point."""
    return F.when(_kind(wkb, F.lit(1)) == POINT, _point_at(wkb, F.lit(6), _little(wkb, F.lit(1))))


def _walk(count: Column, start: Column, kind: str, step: Callable[[Column], Column]) -> Column:
    """``count`` items that lie one after another: ``step`` takes the place of one and gives (the place after it, the item)."""
    first = F.struct(start.cast("int").alias("at"), F.array().cast(f"array<{kind}>").alias("got"))

    def add(state: Column, _: Column) -> Column:
        return _let(step(state["at"]), lambda s: F.struct(s["at"].cast("int").alias("at"), F.concat(state["got"], F.array(s["item"])).alias("got")))

    return F.aggregate(F.array_repeat(F.lit(0), count.cast("int")), first, add)


def _step(at: Column, item: Column) -> Column:
    return F.struct(at.alias("at"), item.alias("item"))


def _polygon_at(wkb: Column, at: Column) -> Column:
    def ring(place: Column, little: Column) -> Column:
        def points(n: Column) -> Column:
            body = F.substring(wkb, place + 4, n * 16)
            return _step(place + 4 + n * 16, _let(body, lambda b: F.transform(F.array_repeat(F.lit(0), n), lambda _, i: _point_at(b, i * 16 + 1, little))))

        return _let(_bytes(wkb, place, 4, little).cast("int"), points)

    return _let(_little(wkb, at), lambda little: _walk(_bytes(wkb, at + 5, 4, little), at + 9, RING, lambda place: ring(place, little)))


def polygons_of(wkb: Column) -> Column:
    """The polygons of a WKB polygon or multipolygon, as a column of the type ``POLYGONS``."""

    kind = _kind(wkb, F.lit(1))
    head = F.when(kind == POLYGON, 1).when(kind == MULTIPOLYGON, _bytes(wkb, F.lit(6), 4, _little(wkb, F.lit(1))))
    start = F.when(kind == POLYGON, 1).otherwise(10)
    part = lambda place: _let(_polygon_at(wkb, place), lambda p: _step(p["at"], p["got"]))
    return F.when(head.isNotNull(), _walk(head, start, f"array<{RING}>", part)["got"])


def _moments(ring: Column) -> Column:
    """(a, x, y) of a closed ring: twice its signed area, and six times its signed first moments about its first point.

    Coordinates are taken from the ring's first point, so that far origins cost no digits."""
    at = ring[0]
    sides = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda p, q: F.struct((p["x"] - at["x"]).alias("px"), (p["y"] - at["y"]).alias("py"), (q["x"] - at["x"]).alias("qx"), (q["y"] - at["y"]).alias("qy")))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, e: Column) -> Column:
        cross = e["px"] * e["qy"] - e["qx"] * e["py"]
        return F.struct((s["a"] + cross).alias("a"), (s["x"] + (e["px"] + e["qx"]) * cross).alias("x"), (s["y"] + (e["py"] + e["qy"]) * cross).alias("y"))

    return F.when(F.size(ring) > 3, F.aggregate(sides, zero, add)).otherwise(zero)


def measures(polygons: Column) -> Column:
    """(area, cx, cy): area and centroid of polygons, whichever way round their rings run."""

    def ring(r: Column, i: Column) -> Column:
        return _let(_moments(r), lambda m: shifted(r, i, m))

    def shifted(r: Column, i: Column, m: Column) -> Column:
        sign = F.signum(m["a"]) * F.when(i == 0, 1).otherwise(-1)
        area = sign * m["a"] / 2
        return F.struct(area.alias("a"), (sign * m["x"] / 6 + area * r[0]["x"]).alias("x"), (sign * m["y"] / 6 + area * r[0]["y"]).alias("y"))

    rings = F.flatten(F.transform(polygons, lambda p: F.transform(p, ring)))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in "axy"])
    total = F.aggregate(rings, zero, lambda s, r: F.struct(*[(s[c] + r[c]).alias(c) for c in "axy"]))
    return _let(total, lambda t: F.struct(t["a"].alias("area"), F.try_divide(t["x"], t["a"]).alias("cx"), F.try_divide(t["y"], t["a"]).alias("cy")))
