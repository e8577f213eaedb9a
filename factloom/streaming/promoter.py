"""Promotion of a stream: micro-batches into a pending store, with the checkpoint as crash recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import promotion as PR


def pending_of(facts: DataFrame) -> DataFrame:
    """Pending rows of observed facts; ids are hashes, so a replayed batch brings the same rows."""
    key = F.sha2(F.concat_ws("\x1f", "session_id", F.col("ts").cast("string"), "extractor", "target", "content"), 256)
    return facts.select(key.alias("id"), F.xxhash64("session_id", "ts", "content").alias("row_seq"), "content", "type", "target", "session_id", "source", F.lit("provisional").alias("status"), F.col("ts").alias("updated_at"))


class PendingStore:
    """Snapshots of pending rows under a folder, a new one per batch; the newest is current, and a batch that is run again writes the same one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = [s.getPath() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done)

    def read(self, before: int | None = None) -> DataFrame | None:
        have = [v for v in self._versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/v{have[-1]}") if have else None

    def write(self, rows: DataFrame, version: int, keep: int = 2) -> None:
        """A new snapshot. Those before the last ``keep`` go: a batch that is run again reads the one before it at most."""
        rows.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for old in self._versions()[:-keep]:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old}")
            at.getFileSystem(conf).delete(at, True)


def promote_stream(facts: DataFrame, store: PendingStore, now: float, checkpoint: str, ttl: float = 600.0) -> StreamingQuery:
    """Add each micro-batch of observed facts to the store and run a promotion pass.

    A query started again with the same ``checkpoint`` goes on where the last one stopped; a batch that was cut off is run again over the
    snapshot before it and writes the same one.
    """

    def step(batch: DataFrame, number: int) -> None:
        new = pending_of(batch).dropDuplicates(["id"])
        old = store.read(before=number)
        rows = new if old is None else old.unionByName(new.join(old.select("id"), "id", "left_anti"))
        store.write(PR.promote(rows, now, ttl), number)

    return facts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quiet_sessions(events: DataFrame, gap: str = "600 seconds", delay: str = "1 hour") -> DataFrame:
    """Sessions by inactivity, with a watermark for late rows; works on streams and batches."""
    return events.withWatermark("at", delay).groupBy("session_id", F.session_window("at", gap)).agg(F.count("*").alias("n"), F.max("at").alias("last")).select("session_id", F.col("session_window.start").alias("start"), "last", "n")


def write_sessions(sessions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed sessions as files, each once; sessions meet in each task before the shuffle, so that a session of very many rows is few of them."""
    spark = sessions.sparkSession
    name = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        return sessions.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
