"""Frames met in tiles: every row of one with every row of the other, without a join of rows.

Rows are packed into tiles of a bounded number. The left tiles are sent to each tile of the right side of their block, and a function turns a
pair of tiles into rows. A block of any size is cut evenly, so no key is hot; what travels is tiles, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..frames import written

LEFT, RIGHT = 512, 2048


def pack(x: DataFrame, block: str | None, key: str, tile: int) -> DataFrame:
    """(block, part, rows): at most about ``tile`` rows of ``x`` in each row, dealt by a hash of ``key``."""
    names = [F.col(f"`{c}`") for c in x.columns]
    y = x.select(F.lit(0).alias("_block") if block is None else F.col(block).alias("_block"), F.xxhash64(key).alias("_h"), F.struct(*names).alias("_row"))
    n = y.groupBy("_block").agg(F.ceil(F.count("*") / tile).cast("int").alias("_n"))
    y = y.join(n, "_block").withColumn("_part", F.pmod(F.col("_h"), F.col("_n")).cast("int"))
    return y.groupBy("_block", "_part", "_n").agg(F.collect_list("_row").alias("rows"))


def meet(left: DataFrame, right: DataFrame, run: Callable[[pa.StructArray, pa.StructArray], Iterator[pa.RecordBatch]], out: str, keys: tuple[str, str], block: str | None = None, sizes: tuple[int, int] = (LEFT, RIGHT)) -> DataFrame:
    """Rows ``out`` of ``run`` for every pair of a left and a right tile of the same block."""
    a, b = pack(left, block, keys[0], sizes[0]), pack(right, block, keys[1], sizes[1])
    counts = b.groupBy("_block").agg(F.max("_n").alias("_to"))
    sent = a.select("_block", F.col("rows").alias("rows_a")).join(counts, "_block").select("_block", "rows_a", F.explode(F.sequence(F.lit(0), F.col("_to") - 1)).alias("_part"))
    pairs = sent.join(b.select("_block", "_part", "rows"), ["_block", "_part"]).select("rows_a", "rows")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = []
                for col in batch.columns:
                    lo, hi = col.offsets[i].as_py(), col.offsets[i + 1].as_py()
                    sides.append(col.values.slice(lo, hi - lo))
                yield from run(*sides)

    return pairs.mapInArrow(tasks, out)


def packed(x: DataFrame, tile: int, name: str) -> DataFrame:
    """(no, n, rows): the rows of ``x`` where they lie, at most ``tile`` in each row, written. Nothing is shuffled; ``no`` tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, tile):
                own = batch.slice(lo, tile)
                rows = pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), pa.StructArray.from_arrays(own.columns, own.schema.names))
                yield pa.RecordBatch.from_arrays([pa.array([own.num_rows], pa.int64()), rows], names=["n", "rows"])

    out = StructType([StructField("n", LongType()), StructField("rows", ArrayType(x.schema))])
    return written(x.mapInArrow(run, out).select(F.monotonically_increasing_id().alias("no"), "n", "rows"), name, tile)


def meet_all(blocks: DataFrame, rest: DataFrame, start: Callable[[pa.StructArray], object], out: str, name: str) -> DataFrame:
    """Rows ``out``, written: each row of ``blocks`` meets every row of ``rest`` (both of :func:`packed`) in one task, one after another.

    ``start`` makes an object of a block; its ``add`` gets the tiles, and ``done`` then gives record batches. The tiles are read where they lie, once a
    task, so that neither they nor what a block makes of them pass a shuffle.
    """
    tasks = max(1, blocks.count())
    left = blocks.repartitionByRange(tasks, "no") if tasks > 1 else blocks.coalesce(1)
    both = left.select("no", F.col("rows").alias("block")).hint("shuffle_replicate_nl").join(rest.select("rows").coalesce(1))

    def rows_of(col: pa.ListArray, i: int) -> pa.StructArray:
        lo, hi = col.offsets[i].as_py(), col.offsets[i + 1].as_py()
        return col.values.slice(lo, hi - lo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                no = batch.column(0)[i].as_py()
                if no != last:
                    if own is not None:
                        yield from own.done()
                    last, own = no, start(rows_of(batch.column(1), i))
                own.add(rows_of(batch.column(2), i))
        if own is not None:
            yield from own.done()

    return written(both.mapInArrow(run, out), name, 1)


def field(rows: pa.StructArray, name: str) -> pa.Array:
    """A column of packed rows."""
    return rows.field(name) if rows.offset == 0 and len(rows.field(name)) == len(rows) else rows.flatten()[rows.type.get_field_index(name)]


def numbers(rows: pa.StructArray, name: str, null: float = np.nan) -> np.ndarray:
    return field(rows, name).cast(pa.float64()).fill_null(null).to_numpy(zero_copy_only=False)


def vectors(rows: pa.StructArray, name: str, unit: bool = True) -> np.ndarray:
    """A matrix of a list column in double precision, of unit length if wanted; null and missing places are zeros."""
    col = field(rows, name)
    lens = np.diff(col.offsets.to_numpy(zero_copy_only=False))
    flat = col.values.slice(col.offsets[0].as_py(), int(lens.sum())).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    if len(lens) and (lens == lens[0]).all() and not col.null_count:
        m = flat.reshape(len(lens), int(lens[0])).copy()
    else:
        m = np.zeros((len(lens), int(lens.max(initial=0))))
        at, valid = 0, col.is_valid().to_numpy(zero_copy_only=False)
        for i, n in enumerate(lens.tolist()):
            if valid[i]:
                m[i, :n] = flat[at : at + n]
            at += n
    if unit:
        length = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
    return m


def widen(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices with as many columns as the wider one."""
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def term_hits(asked: pa.Array, own: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, of, hits): the distinct lists of ``asked`` terms are numbered, ``of`` has the number of each row, and hits[kind, j] counts the
    terms of a list that a term of ``own`` j equals or, from four letters on, begins with or begins."""
    lists, kinds = asked.to_pylist(), {}
    of = np.array([kinds.setdefault(tuple(x or ()), len(kinds)) for x in lists], np.int64)
    coded = own.flatten().dictionary_encode()
    words, flat = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    group = np.repeat(np.arange(len(own)), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    hits = np.zeros((len(kinds), len(own)), np.int64)
    met: dict[str, np.ndarray] = {}
    for x, k in kinds.items():
        for a in x:
            if a not in met:
                like = np.array([a == b or (len(a) >= 4 and (b.startswith(a) or a.startswith(b))) for b in words], bool)
                met[a] = np.zeros(len(own), bool)
                met[a][group[like[flat]] if len(flat) else []] = True
            hits[k] += met[a]
    return np.array([len(x) for x in kinds], np.int64), of, hits
