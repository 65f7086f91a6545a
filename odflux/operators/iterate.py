"""Frames of a loop, stored so that its lineage stays short and lost executors cost nothing that is finished."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster must set it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="odflux-loop-")
        sc.setCheckpointDir(named)
    return named


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Iterates:
    """Named frames, each written to the shared folder; its version before goes once the next one is there."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.at, self.paths = spark, f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}", {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.at}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.drop(name)
        self.paths[name] = path
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                delete(self.spark, self.paths.pop(name))

    def result(self, name: str) -> None:
        """Let go of all frames but the one that the loop returns."""
        self.drop(*[n for n in self.paths if n != name])
