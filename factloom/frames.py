"""Frames in the folder that driver and executors share, joins with small frames, and ranks without one-task windows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most rows of a frame that is sent to every executor; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where that is unset, and only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="factloom-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "frame") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._factloom_path = path
    return out


def written(df: DataFrame, name: str, rows: int) -> DataFrame:
    """``df`` materialized with batches of at most ``rows`` rows between Spark and Python, without compression: cells of megabytes would else fill the
    memory beside the heap, as batches are bounded by rows first, and codecs hold whole pages there."""
    conf = df.sparkSession.conf
    held = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.parquet.compression.codec": "uncompressed"}
    before = {key: conf.get(key) for key in held}
    try:
        for key, value in held.items():
            conf.set(key, value)
        return materialize(df, name)
    finally:
        for key, value in before.items():
            conf.set(key, value)


def drop(df: DataFrame) -> None:
    """Delete the table behind a frame of :func:`materialize` that no later plan reads."""
    path = getattr(df, "_factloom_path", None)
    if path is None:
        raise ValueError("not a frame of materialize()")
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def attach(x: DataFrame, few: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``x`` joined with a frame that is worked out first and sent to all executors if it has ``BROADCAST_ROWS`` rows at most; else by a shuffle."""
    few = materialize(few, "few")
    small = few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return x.join(F.broadcast(few) if small else few, on, how)


def ranks(x: DataFrame, group: str | list[str], order: list[Column], name: str) -> DataFrame:
    """``x`` with the place of each row among those of its group, from 0 in ``order``. Rows that ``order`` does not tell apart
    come in any order. Groups must not be null.

    Rows are dealt by range of (group, order) and numbered where they lie; numbers of rows in earlier ranges are added. A group of any size is
    spread over tasks. ``x`` is read twice (the ranges are drawn from it), so it should be a table.
    """
    n = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = [group] if isinstance(group, str) else group
    dealt = x.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order).withColumn("_mid", F.monotonically_increasing_id())
    t = materialize(dealt, "ranks").withColumn("_pid", F.shiftright("_mid", 33))
    per = t.groupBy(*group, "_pid").agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    per = per.select(*group, "_pid", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return attach(t, per, [*group, "_pid"]).withColumn(name, (F.col("_mid") + F.col("_shift")).cast("int")).drop("_mid", "_pid", "_shift")
