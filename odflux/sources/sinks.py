"""Sinks: partitioned tables, a results document, GeoJSON features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, *partitions: str, mode: str = "overwrite") -> None:
    """Parquet sink; with partition columns only the partitions at hand are replaced, so a month can be redone."""
    writer = df.write.mode(mode)
    if partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partitions)
    writer.parquet(path)


def write_pipe(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "|").csv(path)


def results_document(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, payload): each section's rows as one JSON array, in column order of its rows."""
    out = None
    for name, df in sections.items():
        one = df.select(F.to_json(F.struct(*df.columns)).alias("row")).agg(F.sort_array(F.collect_list("row")).alias("rows"))
        one = one.select(F.lit(name).alias("section"), F.concat(F.lit("["), F.array_join("rows", ","), F.lit("]")).alias("payload"))
        out = one if out is None else out.unionByName(one)
    return out


def merge_results(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored sections with those of ``new`` replaced or added."""
    return stored.join(new.select("section"), "section", "left_anti").unionByName(new)


def zone_features(zones: DataFrame, yearly: DataFrame) -> DataFrame:
    """(zone_id, feature): one GeoJSON feature a zone, its yearly records nested by year, coordinates to 5 places.

    ``yearly`` has one row for each (zone_id, year); the years of a zone are few.
    """
    record = F.struct(*[c for c in yearly.columns if c not in ("zone_id", "year")])
    nested = yearly.groupBy("zone_id").agg(F.sort_array(F.collect_list(F.struct(F.col("year").cast("string").alias("key"), record.alias("value")))).alias("entries"))
    joined = zones.join(nested, "zone_id", "left")
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round("lon", 5), F.round("lat", 5)).alias("coordinates"))
    properties = F.struct("zone_id", "zone", "borough", F.map_from_entries("entries").alias("years"))
    return joined.select("zone_id", F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), properties.alias("properties"))).alias("feature"))
