"""Hourly counts over a stream of events: appended once an hour is closed, or the whole table anew with each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odflux.operators.iterate import shared_folder


def windowed(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """(hour, event_type, n, total) of rows (ts, event_type, value).

    In append mode an hour is put out once the newest row is ``late`` beyond its end, and rows of such hours are dropped;
    in complete mode nothing is ever late."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own number, so a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put


def appended(stream: DataFrame, path: str, late: str = "2 hours") -> None:
    """Run ``stream`` over what is there now; closed hours go to ``path``/hours, the stream's place to ``path``/place."""
    query = windowed(stream, late).writeStream.outputMode("append").option("checkpointLocation", f"{path}/place").foreachBatch(batch_sink(f"{path}/hours")).trigger(availableNow=True).start()
    query.awaitTermination()


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("hour timestamp_ntz, event_type string, n long, total double").parquet(f"{path}/hours/batch=*")


def event_stream(spark: SparkSession, sf_dir: str, files_at_once: int = 1) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(path if _is_folder(spark, path) else sf_dir + "/events*.parquet")


def _path(spark: SparkSession, label: str) -> str:
    from uuid import uuid4

    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid4().hex}"


def closed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that the stream of the events table has closed."""
    path = _path(spark, "closed-hours")
    appended(event_stream(spark, sf_dir), path)
    return read_batches(spark, path)


def hourly_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hours so far: each batch writes the whole table to a folder of its own, and the last one is read."""
    path = _path(spark, "hourly-flows")
    last: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch_sink(f"{path}/hours")(batch, number)
        last.append(number)

    stream = windowed(event_stream(spark, sf_dir, 1000)).writeStream.outputMode("complete").option("checkpointLocation", f"{path}/place").foreachBatch(put).trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{path}/hours/batch={last[-1]}")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
