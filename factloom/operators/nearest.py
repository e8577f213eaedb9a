"""Nearest vectors in blocks: tiles of vectors meet as matrices, and only the best of each tile leave a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from . import tiles as _tiles

TILE = 1024


def _sides(asked: pa.StructArray, own: pa.StructArray) -> tuple[np.ndarray, ...]:
    """Ids and unit vectors of both sides; shorter vectors count as padded with zeros."""
    ids = [_tiles.field(x, "id").to_numpy(zero_copy_only=False) for x in (asked, own)]
    return *ids, *_tiles.widen(_tiles.vectors(asked, "e"), _tiles.vectors(own, "e"))


def _met(vectors: DataFrame, queries: DataFrame, run, block: str | None, tile: int) -> DataFrame:
    ship(vectors.sparkSession)
    names = [F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("e"), *([F.col(block).alias("block")] if block else [])]
    return _tiles.meet(queries.select(*names), vectors.select(*names), run, "query_id long, id long, sim double", ("id", "id"), "block" if block else None, (tile, tile))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: str | None = None, threshold: float | None = None, itself: bool = True, tile: int = TILE) -> DataFrame:
    """(query_id, id, sim, rank): for each of ``queries`` (id, embedding) the k vectors of its block with the greatest cosine; ties go to smaller ids."""

    def run(asked: pa.StructArray, own: pa.StructArray) -> Iterator[pa.RecordBatch]:
        qi, vi, q, v = _sides(asked, own)
        order = np.argsort(vi, kind="stable")
        vi, sims = vi[order], q @ v[order].T
        if not itself:
            sims[qi[:, None] == vi[None, :]] = -np.inf
        if threshold is not None:
            sims[sims < threshold] = -np.inf
        top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        best = np.take_along_axis(sims, top, axis=1)
        keep = np.isfinite(best)
        cols = [np.repeat(qi, top.shape[1])[keep.ravel()], vi[top][keep], best[keep]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "id", "sim"])

    found = _met(vectors, queries, run, block, tile)
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similarities(vectors: DataFrame, queries: DataFrame, tile: int = TILE, block: str | None = None, threshold: float | None = None) -> DataFrame:
    """(query_id, id, sim) of every query with every vector, or those of its block and from ``threshold`` on, for what scores all candidates."""

    def run(asked: pa.StructArray, own: pa.StructArray) -> Iterator[pa.RecordBatch]:
        qi, vi, q, v = _sides(asked, own)
        for lo in range(0, len(qi), 64):
            some = qi[lo : lo + 64]
            cols = [np.repeat(some, len(vi)), np.tile(vi, len(some)), (q[lo : lo + 64] @ v.T).ravel()]
            if threshold is not None:
                keep = cols[2] >= threshold
                cols = [c[keep] for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "id", "sim"])

    return _met(vectors, queries, run, block, tile)
