"""State on storage: a folder per snapshot, and a table that names the current one. Readers never see half a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import STATE


class State:
    """Snapshots of the state tables under a path of any file system Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_DONE")))

    def read(self, table: str) -> DataFrame:
        """The current snapshot of a table; an empty frame of its schema if there is none."""
        have = self._names()
        if not have:
            return self.spark.createDataFrame([], STATE[table])
        return self.spark.read.schema(STATE[table]).parquet(f"{self.path}/v{have[-1]}/{table}")

    def write(self, **tables: DataFrame) -> int:
        """A new snapshot of all tables, those not given as they are; it counts once its mark stands."""
        number = (self._names() or [-1])[-1] + 1
        for name, schema in STATE.items():
            df = tables.get(name)
            df = self.read(name) if df is None else df
            want = self.spark.createDataFrame([], schema).schema
            cols = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want]
            df.select(*cols).write.mode("overwrite").parquet(f"{self.path}/v{number}/{name}")
        jvm = self.spark.sparkContext._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{number}/_DONE")
        mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(mark).close()
        return number

    def reset(self) -> int:
        """Empty facts, scopes, links, accesses, learned values and interactions; pending rows and counters stay."""
        empty = {n: self.spark.createDataFrame([], STATE[n]) for n in ("facts", "scopes", "links", "access", "qvalues", "interactions")}
        return self.write(**empty)
