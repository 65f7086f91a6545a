"""Helpers of the training-data operators: shared storage, lineage cuts, global row numbers, words."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_POSITION_MASK = (1 << 33) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary folder; on a cluster that folder would be lost with its
    machine, so there the setting is demanded.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="odflux-checkpoint-"))
    return named or sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, so that lost executors change nothing downstream."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Narrow rows of a checkpointed frame that one task may take, and the most rows of a look-up table that is broadcast.
TASK_ROWS = 1 << 18
LOOK_UP = 1 << 16


def settled(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` of a few numbers a row, checkpointed, and its row count.

    Its partitions are merged until each has about ``TASK_ROWS`` rows: a small frame needn't cost a task for each
    shuffle partition in every later step, and a frame of one partition needs no shuffle at all.
    """
    df = durable(df)
    rows = df.count()
    return df.coalesce(max(1, -(-rows // TASK_ROWS))), rows


def replaced(rows: DataFrame, column: str, names: DataFrame, total: int) -> DataFrame:
    """``rows`` with ``column`` replaced by its entry in ``names`` (old, new; ``total`` rows), if it has one there.

    Up to ``LOOK_UP`` names are broadcast; more are joined by shuffle.
    """
    names = names.toDF("_old", "_new")
    met = rows.join(F.broadcast(names) if total <= LOOK_UP else names, F.col(column) == F.col("_old"), "left")
    return met.withColumn(column, F.coalesce("_new", column)).select(*rows.columns)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffles, broadcasts and checkpoints of frames that nothing refers to any more.

    Executors' disks hold them until the driver collects its garbage, which a long chain of small jobs may put off.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it back; the columnar form of ``durable`` for wide rows."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Keep Arrow batches of whole texts small, in rows and in bytes: texts may be very long.

    The limits are the session's and are read when a query runs, so they stay lowered; they change no result.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(name).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


#: Bits of a bitmap for each id, and of the largest bitmap that is broadcast; and the most keys that ``meet`` broadcasts.
BITS_PER_ID = 16
BITMAP_BITS = 26
HEAVY = 1 << 16


def least_heavy(rows: int) -> int:
    """Rows that make a key heavy: at most ``HEAVY`` keys can have so many of ``rows`` rows."""
    return max(64, -(-rows // HEAVY))


def meet(rows: DataFrame, groups: DataFrame, key: str, least: int, salt: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``groups``, an aggregate by ``key`` that has the number of rows of each key as ``k``.

    Keys with ``least`` rows or more are broadcast, which ``least_heavy`` bounds; their rows are dealt out by ``salt``
    instead, so no task gets all rows of a key.  A null key meets nothing.
    """
    names = [c for c in groups.columns if c not in (key, "k")]
    heavy = F.broadcast(groups.where(F.col("k") >= least).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in names]))
    light = groups.where(F.col("k") < least).select(F.col(key).alias("_lk"), *[F.col(c).alias(f"_l_{c}") for c in names])
    alone = F.col("_hk").isNull() & F.col(key).isNotNull()
    spot = F.when(alone, F.xxhash64(key)).otherwise(F.xxhash64(*salt))
    first = rows.join(heavy, F.col(key) == F.col("_hk"), "left").withColumn("_spot", spot)
    met = first.join(light, (F.col("_spot") == F.xxhash64("_lk")) & (F.col(key) == F.col("_lk")) & F.col("_hk").isNull(), "left")
    if how == "inner":
        met = met.where("_hk is not null or _lk is not null")
    return met.select(*rows.columns, *[F.coalesce(f"_h_{c}", f"_l_{c}").alias(c) for c in names])


def marked(ids: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column that tells whether a document may be among ``ids`` (durable): false is certain.

    A bitmap of ``BITS_PER_ID`` bits for each id, as a table of 64-bit words, is broadcast; where that would pass
    ``BITMAP_BITS``, no bitmap is made and every document may be.
    """
    bits = max(6, (BITS_PER_ID * ids.count()).bit_length())
    if bits > BITMAP_BITS:
        return docs.withColumn(name, F.lit(True))
    word, words = fresh(docs, "_word"), fresh(docs, "_bits")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {1 << bits}) % 64 as int))")
    table = ids.select(F.shiftright(place, 6).alias(word), bit.alias(words)).groupBy(word).agg(F.bit_or(words).alias(words))
    placed = docs.withColumn(word, F.shiftright(place, 6)).join(F.broadcast(table), word, "left")
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(words).bitwiseAND(bit) != 0, F.lit(False)).alias(name))


def members(ids: DataFrame, docs: DataFrame, inside: bool = True) -> DataFrame:
    """Documents that may be among ``ids``, or else the others."""
    hit = fresh(docs, "_hit")
    told = marked(ids, docs, hit)
    return told.where(F.col(hit) if inside else ~F.col(hit)).select(*[F.col(f"`{c}`") for c in docs.columns])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def global_row_number(df: DataFrame, order: list[Column | str], name: str = "row_no") -> tuple[DataFrame, int]:
    """Number all rows from 0 in ``order`` without a single-task window; returns the frame and the row count.

    Rows are range-partitioned and sorted by the order columns, then each partition's size gives the offset of the
    next one.  The placement is checkpointed before sizes are read, so that a recomputed partition can't disagree
    with its offset.  The offsets table has one row for each shuffle partition, which bounds the broadcast.  Rows
    equal in all order columns are interchangeable, so ``order`` should end in a content hash.
    """
    return numbered(df.repartitionByRange(*order).sortWithinPartitions(*order), name)


def numbered(ordered: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Number the rows of a frame whose partitions follow each other in order; returns the frame and the row count."""
    placed = durable(ordered.withColumn("_pid", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK))))
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    out = placed.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_off") + F.col("_pos"))
    return out.drop("_pid", "_pos", "_off"), int(total)
