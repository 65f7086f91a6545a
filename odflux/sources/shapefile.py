"""Shapefiles as a Spark data source: pieces of .shp, .shx and .dbf, read by ranges of records and written by tasks.

A task reads its own range of the index, the bytes of its shapes and its attribute rows by positioned reads; nothing else of
the files is touched, and .shp isn't opened unless the geometry is asked for (option ``columns``).  Rings become WKB
multipolygons: outlines run clockwise, and a hole joins the smallest outline around it.

Defined cases: a null shape is a null geometry; empty attributes are null, but text is always text, so a null text is read
back as an empty one; a folder without pieces or a file without records has no rows; shapes other than null, points and
polygons, and text longer than its field, raise an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from odflux.sources.pieces import PieceWriter, Pieces, opened

#: Records of one partition and of one Arrow batch; records and bytes of shapes that end a written piece.
RANGE, BATCH, PIECE, PIECE_BYTES = 100_000, 1_000, 100_000, 256 << 20
#: Fixed values of the format: file code, version, shape types, header sizes, widths of attribute fields.
CODE, VERSION, NULL, POINT, POLYGON = 9994, 1000, 0, 1, 5
HEADER, INDEX_ROW, FIELD_ROW, TEXT_WIDTH, NUMBER_WIDTH = 100, 8, 32, 254, 24


@dataclass
class Field:
    name: str
    kind: str
    at: int
    width: int
    decimals: int

    @property
    def type(self) -> DataType:
        if self.kind in "NF":
            return LongType() if self.kind == "N" and not self.decimals and self.width < 19 else DoubleType()
        return BooleanType() if self.kind == "L" else StringType()

    def values(self, rows: list[bytes]) -> list:
        texts = [r[self.at : self.at + self.width] for r in rows]
        if self.kind == "L":
            return [None if t in b"? " else t in b"TtYy" for t in texts]
        plain = [t.decode().rstrip("\0 ") if self.kind not in "NF" else t.strip(b"\0 *").decode() for t in texts]
        if self.kind in "NF":
            make = int if isinstance(self.type, LongType) else float
            return [make(t) if t else None for t in plain]
        return plain


@dataclass
class Attributes:
    """Layout of a .dbf file."""

    rows: int
    start: int
    size: int
    fields: list[Field]

    @classmethod
    def of(cls, system: fs.FileSystem, path: str) -> Attributes:
        with system.open_input_file(path) as f:
            rows, start, size = struct.unpack("<4xIHH", f.read(12))
            f.seek(32)
            found, at = [], 1
            for name, kind, width, decimals in struct.iter_unpack("<11sc4xBB14x", f.read((start - 33) // FIELD_ROW * FIELD_ROW)):
                found.append(Field(name.split(b"\0")[0].decode(), kind.decode(), at, width, decimals))
                at += width
        return cls(rows, start, size, found)


@dataclass
class Records(InputPartition):
    stem: str
    first: int
    end: int


def _area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def _around(ring: np.ndarray, point: np.ndarray) -> bool:
    (x, y), (px, py) = ring.T, point
    spans = (y[:-1] > py) != (y[1:] > py)
    a, b = ring[:-1][spans], ring[1:][spans]
    return bool((px < a[:, 0] + (py - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])).sum() % 2)


def _coded(kind: int, items: list[bytes]) -> bytes:
    return struct.pack("<BII", 1, kind, len(items)) + b"".join(items)


def shape_wkb(body: bytes) -> bytes | None:
    """WKB of one shape record's content."""
    kind = struct.unpack_from("<i", body)[0]
    if kind == NULL:
        return None
    if kind == POINT:
        return struct.pack("<BI", 1, 1) + body[4:20]
    if kind != POLYGON:
        raise ValueError(f"shape type {kind} isn't read")
    parts, points = struct.unpack_from("<ii", body, 36)
    starts = [*struct.unpack_from(f"<{parts}i", body, 44), points]
    xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
    rings = [xy[a:b] for a, b in zip(starts, starts[1:]) if b > a]
    outlines = [[r] for r in rings if _area(r) <= 0]
    for hole in (r for r in rings if _area(r) > 0):
        within = [(abs(_area(o[0])), i) for i, o in enumerate(outlines) if _around(o[0], hole[:2].mean(axis=0))]
        outlines[min(within)[1]].append(hole) if within else outlines.append([hole])
    ring = lambda r: struct.pack("<I", len(r)) + np.ascontiguousarray(r).tobytes()
    return _coded(6, [_coded(3, [ring(r) for r in o]) for o in outlines])


def wkb_shape(wkb: bytes | None) -> bytes:
    """A shape record's content from the WKB of a point, polygon or multipolygon."""
    if wkb is None:
        return struct.pack("<i", NULL)
    order = "<" if wkb[0] else ">"
    kind, n = struct.unpack_from(f"{order}II", wkb, 1)
    if kind == 1:
        return struct.pack("<idd", POINT, *struct.unpack_from(f"{order}dd", wkb, 5))
    if kind not in (3, 6):
        raise ValueError(f"geometry type {kind} isn't written")
    rings, at = [], 0 if kind == 3 else 9
    for _ in range(1 if kind == 3 else n):
        order = "<" if wkb[at] else ">"
        count, at = struct.unpack_from(f"{order}I", wkb, at + 5)[0], at + 9
        for place in range(count):
            size = struct.unpack_from(f"{order}I", wkb, at)[0]
            ring = np.frombuffer(wkb, f"{order}f8", 2 * size, at + 4).reshape(-1, 2).astype("<f8")
            at += 4 + 16 * size
            if size:
                rings.append(ring if (_area(ring) <= 0) == (place == 0) else ring[::-1])
    if not rings:
        return struct.pack("<i", NULL)
    xy = np.concatenate(rings)
    starts = np.cumsum([0, *[len(r) for r in rings[:-1]]]).astype("<i4")
    return struct.pack("<i4dii", POLYGON, *xy.min(axis=0), *xy.max(axis=0), len(rings), len(xy)) + starts.tobytes() + xy.tobytes()


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], schema: StructType, size: int):
        self.path, self.columns, self.wanted, self.size = path, columns, schema, size

    def partitions(self) -> list[Records]:
        system = opened(self.path)[0]
        found = []
        for stem in stems(self.path):
            rows = (system.get_file_info(f"{stem}.shx").size - HEADER) // INDEX_ROW
            found += [Records(stem, at, min(at + self.size, rows)) for at in range(0, rows, self.size)]
        return found or [Records("", 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        system = opened(self.path)[0]
        for first in range(partition.first, partition.end, BATCH):
            n = min(BATCH, partition.end - first)
            columns = self._attributes(system, partition.stem, first, n) if any(c != "geometry" for c in self.columns) else {}
            if "geometry" in self.columns:
                columns["geometry"] = self._shapes(system, partition.stem, first, n)
            kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], kinds[f.dataType.simpleString()]) for f in self.wanted], names=self.wanted.names)

    def _attributes(self, system: fs.FileSystem, stem: str, first: int, n: int) -> dict[str, list]:
        layout = Attributes.of(system, f"{stem}.dbf")
        with system.open_input_file(f"{stem}.dbf") as f:
            f.seek(layout.start + first * layout.size)
            data = f.read(n * layout.size)
        rows = [data[i : i + layout.size] for i in range(0, len(data), layout.size)]
        return {field.name: field.values(rows) for field in layout.fields if field.name in self.columns}

    def _shapes(self, system: fs.FileSystem, stem: str, first: int, n: int) -> list[bytes | None]:
        with system.open_input_file(f"{stem}.shx") as f:
            f.seek(HEADER + first * INDEX_ROW)
            index = np.frombuffer(f.read(n * INDEX_ROW), ">i4").reshape(-1, 2).astype(int) * 2
        shapes = []
        with system.open_input_file(f"{stem}.shp") as f:
            for offset, length in index:
                f.seek(int(offset) + 8)
                shapes.append(shape_wkb(f.read(int(length))))
        return shapes


class ShapefileWriter(PieceWriter):
    suffixes = (".shp", ".shx", ".dbf")

    def __init__(self, path: str, overwrite: bool, schema: StructType):
        super().__init__(path, overwrite)
        self.fields = [f for f in schema.fields if f.name != "geometry"]
        kinds = {LongType: ("N", 18), IntegerType: ("N", 11), DoubleType: ("F", NUMBER_WIDTH), StringType: ("C", TEXT_WIDTH), BooleanType: ("L", 1)}
        if unfit := [f.name for f in self.fields if type(f.dataType) not in kinds or len(f.name.encode()) > 10]:
            raise ValueError(f"names of more than ten bytes, or types that aren't written: {unfit}")
        if "geometry" not in schema.names:
            raise ValueError("no column geometry")
        self.layout = [(f.name, *kinds[type(f.dataType)]) for f in self.fields]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Pieces:
        names, shapes, rows = [], [], []
        for batch in iterator:
            columns = [batch.column(name).to_pylist() for name, _, _ in self.layout]
            shapes += [wkb_shape(g) for g in batch.column("geometry").to_pylist()]
            rows += [b" " + b"".join(self._cell(v, *spec) for v, spec in zip(values, self.layout)) for values in (zip(*columns) if columns else [()] * batch.num_rows)]
            if len(shapes) >= PIECE or sum(map(len, shapes)) >= PIECE_BYTES:
                names.append(self._piece(shapes, rows))
                shapes, rows = [], []
        if shapes:
            names.append(self._piece(shapes, rows))
        return Pieces(names)

    @staticmethod
    def _cell(value: object, name: str, kind: str, width: int) -> bytes:
        if kind == "L":
            return b"?" if value is None else b"T" if value else b"F"
        data = b"" if value is None else (repr(value) if kind == "F" else str(value)).encode()
        if len(data) > width:
            raise ValueError(f"a value of {name} is longer than {width} bytes")
        return data.ljust(width) if kind == "C" else data.rjust(width)

    def _piece(self, shapes: list[bytes], rows: list[bytes]) -> str:
        at, index, body = HEADER // 2, [], []
        for number, shape in enumerate(shapes, 1):
            words = len(shape) // 2
            index.append(struct.pack(">ii", at, words))
            body.append(struct.pack(">ii", number, words) + shape)
            at += words + 4
        kinds = {struct.unpack_from("<i", s)[0] for s in shapes} - {NULL}
        if len(kinds) > 1:
            raise ValueError("points and polygons don't go into one shapefile")
        boxes = [np.frombuffer(s, "<f8", 2 if kinds == {POINT} else 4, 4) for s in shapes if len(s) > 4]
        box = (*np.min([b[:2] for b in boxes], axis=0), *np.max([b[-2:] for b in boxes], axis=0)) if boxes else (0.0,) * 4
        head = lambda words: struct.pack(">i20xi", CODE, words) + struct.pack("<ii8d", VERSION, max(kinds, default=NULL), *box, 0, 0, 0, 0)
        fields = b"".join(struct.pack("<11sc4xBB14x", n.encode(), k.encode(), w, 0) for n, k, w in self.layout)
        size = 1 + sum(w for _, _, w in self.layout)
        dbf = struct.pack("<B3BIHH20x", 3, 95, 7, 26, len(rows), 33 + len(fields), size) + fields + b"\r" + b"".join(rows) + b"\x1a"
        return self.save({".shp": head(at) + b"".join(body), ".shx": head((HEADER + INDEX_ROW * len(index)) // 2) + b"".join(index), ".dbf": dbf})


def stems(path: str) -> list[str]:
    """Paths without suffix of one shapefile, or of those in a folder."""
    system, root = opened(path)
    if root.endswith(".shp"):
        return [root[:-4]]
    return sorted(i.path[:-4] for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.path.endswith(".shp"))


class ShapefileSource(DataSource):
    """Options: ``path``, a .shp file or a folder of them with the same fields; ``columns``, those to read, comma-joined;
    ``records``, the records of one partition."""

    @classmethod
    def name(cls) -> str:
        return "odflux_shapefile"

    def schema(self) -> StructType:
        found = stems(self.options["path"])
        if not found:
            raise ValueError(f"no shapefile at {self.options['path']}; give a schema to read an empty folder")
        layout = Attributes.of(opened(self.options["path"])[0], f"{found[0]}.dbf")
        fields = [StructField(f.name, f.type) for f in layout.fields] + [StructField("geometry", BinaryType())]
        wanted = self._wanted()
        return StructType([f for f in fields if wanted is None or f.name in wanted])

    def _wanted(self) -> list[str] | None:
        named = self.options.get("columns")
        return [c.strip() for c in named.split(",")] if named else None

    def reader(self, schema: StructType) -> ShapefileReader:
        return ShapefileReader(self.options["path"], schema.names, schema, int(self.options.get("records", RANGE)))

    def writer(self, schema: StructType, overwrite: bool) -> ShapefileWriter:
        return ShapefileWriter(self.options["path"], overwrite, schema)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, records: int = RANGE) -> DataFrame:
    spark.dataSource.register(ShapefileSource)
    reader = spark.read.format(ShapefileSource.name()).option("records", records)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.sparkSession.dataSource.register(ShapefileSource)
    df.write.format(ShapefileSource.name()).mode(mode).save(path)
