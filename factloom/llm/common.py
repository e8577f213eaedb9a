"""What the operators of this subpackage share: shipping, shared tables, Arrow access."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frames import drop as drop_table
from ..frames import materialize, new_path, shared_dir
from ..shipping import ship

__all__ = ["WORD_PATTERN", "as_bytes", "default_tokenizer_path", "documents", "drop_table", "env_single_thread", "global_rank", "materialize", "new_path", "shared_dir", "ship"]

#: A word is a run of characters other than these ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def default_tokenizer_path(name: str) -> str:
    """Path of a public vocabulary file; the files themselves never enter this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def documents(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def global_rank(df: DataFrame, *order, name: str = "rank0") -> DataFrame:
    """0-based rank over the whole frame without a one-task window.

    Range-partitions by ``order``, numbers rows inside each partition, and adds the number of rows
    of earlier partitions. Only one row per partition meets in one task.
    """
    cols = df.columns
    w = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    t = materialize(w, "rank")
    parts = t.groupBy(F.shiftright("_mid", 33).alias("_pid")).agg(F.count("*").alias("_n"))
    before = F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    parts = parts.select("_pid", before.alias("_before"))
    t = t.withColumn("_pid", F.shiftright("_mid", 33))
    low = F.col("_mid") - F.shiftleft("_pid", 33)
    return t.join(parts, "_pid").select(*cols, (low + F.col("_before")).alias(name))


def env_single_thread() -> None:
    """Native tokenisers must not start threads of their own inside a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
