"""A store of clean trips and their partial aggregates by month, which a broken run leaves in order.

A batch of months is cleaned and written once; the seven partial tables are made from what was written.  Only when all are
there does the manifest, which is only ever appended to, name the months as done.  A run takes the months that it doesn't
name, and overwrites what an earlier one may have left of them.  Partial tables are sums, or smallest hashes, so merging
months in any order gives the aggregates of all trips.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odflux.functions.expressions import capped_bin, daypart, integer_hash, is_weekend
from odflux.operators import aggregates as A

SUMS = ("trips", "sum_dist", "sum_fare", "sum_dur")
MANIFEST = "slice string, version int, done boolean, kept long"
SAMPLE = 40


def _hash() -> Column:
    return integer_hash(F.col("o"), F.col("d"), F.floor(F.col("dur") * 60), F.floor(F.col("fare") * 100))


def _sample(rows: DataFrame, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys, "period").orderBy("hash", "o", "d", "dur", "fare")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE).drop("_n")


#: Partial tables of clean trips with a slice: how a slice's table is made, the keys by which months merge, and the sums.
PARTIALS: dict[str, tuple[Callable[[DataFrame], DataFrame], list[str], tuple[str, ...]]] = {
    "edges": (lambda t: A.edges(t, "slice"), ["o", "d"], SUMS),
    "daypart_edges": (lambda t: A.edges(t.withColumn("period", daypart(F.col("wd"), F.col("hr"))), "period", "slice"), ["o", "d", "period"], SUMS),
    "zone_hourly": (
        lambda t: t.select("slice", F.explode(F.array(F.struct(F.col("o").alias("zone_id"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("d").alias("zone_id"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"), is_weekend(F.col("wd")).alias("weekend"), "hr")
        .groupBy("slice", "e.zone_id", "weekend", "hr").agg(F.sum("e.up").alias("pickups"), F.sum("e.down").alias("dropoffs")),
        ["zone_id", "weekend", "hr"],
        ("pickups", "dropoffs"),
    ),
    "monthly_volume": (lambda t: t.groupBy("slice", F.col("mo").alias("month")).agg(F.count(F.lit(1)).alias("trips"), F.sum("fare").alias("sum_fare"), F.sum("total").alias("sum_total")), ["month"], ("trips", "sum_fare", "sum_total")),
    "hour_weekday": (lambda t: t.groupBy("slice", "wd", "hr").agg(F.count(F.lit(1)).alias("trips")), ["wd", "hr"], ("trips",)),
    "cost_duration": (lambda t: t.groupBy("slice", capped_bin(F.col("dur")).alias("dur_bin"), capped_bin(F.col("fare")).alias("fare_bin")).agg(F.count(F.lit(1)).alias("trips")), ["dur_bin", "fare_bin"], ("trips",)),
    "samples": (lambda t: _sample(t.select("slice", daypart(F.col("wd"), F.col("hr")).alias("period"), _hash().alias("hash"), "o", "d", "dur", "fare"), "slice"), ["period"], ()),
}


class Interrupted(RuntimeError):
    """A run that was told to stop before one of its tables."""


def month_of(trips: DataFrame) -> DataFrame:
    """Trips with the slice that they belong to: m and the year and month."""
    return trips.withColumn("slice", F.concat(F.lit("m"), (F.col("yr") * 100 + F.col("mo")).cast("string")))


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _put(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice").parquet(f"{self.path}/{name}")

    def _log(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/manifest")

    def manifest(self) -> DataFrame:
        """The last word on each slice."""
        jvm_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not jvm_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
            return self.spark.createDataFrame([], MANIFEST)
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        return rows.groupBy("slice").agg(F.max_by(F.struct("version", "done", "kept"), "version").alias("m")).select("slice", "m.*")

    def build(self, clean: DataFrame, batch: int = 12, stop_before: str | None = None) -> list[str]:
        """Store the slices of ``clean`` (trips with their slice) that the manifest doesn't name; the list of those stored.

        There are as many slices as months, so their names go through the driver."""
        known = {r["slice"]: r for r in self.manifest().collect()}
        pending = sorted(r["slice"] for r in clean.select("slice").distinct().collect() if not (r["slice"] in known and known[r["slice"]]["done"]))
        for first in range(0, len(pending), batch):
            slices = pending[first : first + batch]
            self._put(clean.where(F.col("slice").isin(slices)).repartition("slice"), "clean")
            stored = self.table("clean", clean).where(F.col("slice").isin(slices))
            for name, (make, _keys, _sums) in PARTIALS.items():
                if name == stop_before:
                    raise Interrupted(name)
                self._put(make(stored), name)
            version = {s: known[s]["version"] + 1 if s in known else 1 for s in slices}
            versions = F.create_map(*[F.lit(x) for kv in version.items() for x in kv])
            self._log(stored.groupBy("slice").agg(F.count(F.lit(1)).alias("kept")).select("slice", versions[F.col("slice")].alias("version"), F.lit(True).alias("done"), "kept"))
        return pending

    def redo(self, *slices: str) -> None:
        """Take slices off the manifest, so that the next run stores them again."""
        self._log(self.manifest().where(F.col("slice").isin(*slices)).select("slice", (F.col("version") + 1).alias("version"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("kept")))

    def table(self, name: str, like: DataFrame) -> DataFrame:
        """A stored table, read with the columns of ``like``."""
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}").select(*like.columns)

    def finished(self, name: str) -> DataFrame:
        """Rows of a partial table that belong to finished slices."""
        rows = self.spark.read.parquet(f"{self.path}/{name}").withColumn("slice", F.col("slice").cast("string"))
        return rows.join(F.broadcast(self.manifest().where("done").select("slice")), "slice", "left_semi")

    def merged(self, name: str) -> DataFrame:
        """A partial table over all finished slices."""
        _make, keys, sums = PARTIALS[name]
        rows = self.finished(name)
        if not sums:
            return _sample(rows.drop("slice"))
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
