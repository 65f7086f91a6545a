"""Scans of trip tables and the checks that a batch run needs before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the trip model, whatever the source calls them.
TRIP_COLUMNS = ("pu", "do", "t0", "t1", "fare", "total", "dist", "tip", "rate")


def scan_months(spark: SparkSession, *paths: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Parquet scan of one or more monthly files, only the columns asked for."""
    df = spark.read.option("mergeSchema", "false").parquet(*paths)
    return df.select(*columns) if columns else df


def scan_csv(spark: SparkSession, *paths: str, columns: tuple[str, ...] | None = None, sep: str = ",") -> DataFrame:
    """Header CSV with ``N/A`` as null; files are concatenated."""
    df = spark.read.option("header", True).option("sep", sep).option("nullValue", "N/A").option("inferSchema", True).csv(list(paths))
    return df.select(*columns) if columns else df


def describe(df: DataFrame) -> DataFrame:
    """(position, name, type, is_coordinate) of a table's columns."""
    rows = [(i, f.name, f.dataType.simpleString(), any(k in f.name.lower() for k in ("longitude", "latitude"))) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, is_coordinate boolean")


def listing(spark: SparkSession, pattern: str, least: int = 1 << 20) -> DataFrame:
    """(path, bytes, valid) of files: valid ones have at least ``least`` bytes and end in the Parquet magic.

    Lengths come from the file listing; of a file long enough only its last four bytes are read, at their position, whatever
    store it is in.  Files are those of a download run, a few hundred."""
    files = spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"))
    tails = [(r["path"], r["bytes"], r["bytes"] >= max(4, least) and _tail(spark, r["path"], r["bytes"]) == b"PAR1") for r in files.collect()]
    return spark.createDataFrame(tails, "path string, bytes long, valid boolean")


def _tail(spark: SparkSession, path: str, length: int) -> bytes:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(sc._jsc.hadoopConfiguration()).open(at)
    try:
        stream.seek(length - 4)
        return bytes(stream.read() for _ in range(4))
    finally:
        stream.close()


def wanted_months(spark: SparkSession, years: list[int], present: DataFrame) -> DataFrame:
    """(year, month, present): what a download run still lacks, against a (year, month) table of valid files."""
    years_df = spark.createDataFrame([(y,) for y in years], "year int")
    grid = years_df.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    have = present.select("year", "month").distinct().withColumn("present", F.lit(True))
    return grid.join(have, ["year", "month"], "left").na.fill(False, ["present"])


def ready_years(present: DataFrame) -> DataFrame:
    """Years with all twelve months present."""
    return present.groupBy("year").agg(F.count_distinct("month").alias("months")).where("months = 12").select("year")


def common_years(*tables: DataFrame) -> DataFrame:
    """Years that every table has."""
    out = tables[0].select("year").distinct()
    for t in tables[1:]:
        out = out.intersect(t.select("year"))
    return out
