"""GeoParquet: Parquet files with WKB columns, and metadata that says so.

Files are read by Spark's own Parquet scan, with its pruning and pushed filters; only writing needs a data source, as the
metadata belongs into each file's footer.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from odflux.sources.pieces import PieceWriter, Pieces

#: Rows and bytes that a file has at most, but for its last batch.
ROWS, BYTES = 1_000_000, 256 << 20


def metadata(geometry: list[str], crs: dict | None = None) -> dict:
    """The metadata of format version 1.0.0; the first geometry column is the primary one."""
    column = {"encoding": "WKB", "geometry_types": [], "crs": crs}
    return {"version": "1.0.0", "primary_column": geometry[0], "columns": {name: column for name in geometry}}


class GeoParquetWriter(PieceWriter):
    suffixes = (".parquet",)

    def __init__(self, path: str, overwrite: bool, geometry: list[str], crs: dict | None):
        super().__init__(path, overwrite)
        self.geo = json.dumps(metadata(geometry, crs))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Pieces:
        names, held, rows, size = [], [], 0, 0
        for batch in iterator:
            held, rows, size = [*held, batch], rows + batch.num_rows, size + batch.nbytes
            if rows >= ROWS or size >= BYTES:
                names.append(self._file(held))
                held, rows, size = [], 0, 0
        if held:
            names.append(self._file(held))
        return Pieces(names)

    def _file(self, batches: list[pa.RecordBatch]) -> str:
        table, out = pa.Table.from_batches(batches), io.BytesIO()
        pq.write_table(table.replace_schema_metadata({**(table.schema.metadata or {}), b"geo": self.geo.encode()}), out)
        return self.save({".parquet": out.getvalue()})


class GeoParquetSource(DataSource):
    """Options: ``path``; ``geometry``, the WKB columns, comma-joined; ``crs``, PROJJSON."""

    @classmethod
    def name(cls) -> str:
        return "odflux_geoparquet"

    def schema(self) -> StructType:
        raise ValueError("read GeoParquet by spark.read.parquet")

    def writer(self, schema: StructType, overwrite: bool) -> GeoParquetWriter:
        names = [c.strip() for c in self.options.get("geometry", "geometry").split(",")]
        if missing := [c for c in names if c not in schema.names]:
            raise ValueError(f"no geometry column {missing}")
        crs = self.options.get("crs")
        return GeoParquetWriter(self.options["path"], overwrite, names, json.loads(crs) if crs else None)


def write(df: DataFrame, path: str, geometry: str = "geometry", crs: str | None = None, mode: str = "overwrite") -> None:
    df.sparkSession.dataSource.register(GeoParquetSource)
    writer = df.write.format(GeoParquetSource.name()).mode(mode).option("geometry", geometry)
    (writer.option("crs", crs) if crs else writer).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
