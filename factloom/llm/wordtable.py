"""Distinct-word tables: split texts into units, value each distinct unit once, join the values back by position.

A *block* is a bounded run of documents of one task. Pass one writes, for each block, the
documents as positions into the block's own list of distinct units (most frequent first, stored as
byte planes, so that they compress well) and that list. Pass two deals every block's list out by
the hash of the unit; each bucket computes the value of each distinct unit once, however many blocks
hold it, and sends the values back to the blocks. Pass three brings a block's positions and values
together and emits a row per document.

Text crosses the network once, as compressed positions. A unit that a third of all words equal costs
one entry per block, so no key is hot. Blocks and buckets are bounded whatever the input's size.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, new_path, ship

#: Units in a block, and in a bucket on average; both bound a task's memory.
BLOCK_UNITS = 5_000_000
BUCKET_UNITS = 400_000

_BLOCKS = "block_id long, doc_ids binary, doc_units binary, doc_bytes binary, planes binary, units binary, n_units long"
_DEALT = "bucket int, block_id long, units binary, at binary"
_VALUES = "block_id long, at binary, vals binary"


def zip_bytes(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unzip_bytes(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def zip_ints(x: np.ndarray) -> bytes:
    """Integers as zstd-compressed byte planes, with their item size in front."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T if len(x) else np.zeros((x.itemsize, 0), np.uint8)
    return bytes([x.itemsize]) + zip_bytes(np.ascontiguousarray(planes).tobytes())


def unzip_ints(data: bytes, signed: bool = False) -> np.ndarray:
    n = data[0]
    raw = np.frombuffer(unzip_bytes(data[1:]), np.uint8).reshape(n, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(f"<{'i' if signed else 'u'}{n}")


def zip_units(units: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, units), np.uint32, len(units))
    head = zip_ints(lens)
    return len(head).to_bytes(4, "little") + head + zip_bytes(b"".join(units))


def unzip_units(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(unzip_ints(data[4 : 4 + n]).astype(np.int64)).tolist()
    body = unzip_bytes(data[4 + n :])
    return [body[a:b] for a, b in zip([0, *ends], ends)]


class _Block:
    def __init__(self) -> None:
        self.index: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.ids: list[int | None] = []
        self.parts: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.n = 0

    def add(self, doc_id: int | None, units: list[bytes], n_bytes: int) -> None:
        self.ids.append(doc_id)
        self.sizes.append(n_bytes)
        self.parts.append(np.fromiter(map(self.index.__getitem__, units), np.uint32, len(units)))
        self.n += len(units)

    def row(self, block_id: int) -> tuple:
        at = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(at, minlength=len(self.index)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        units = list(self.index)
        null = np.array([i is None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], np.int64).tobytes() + null.tobytes()
        lens = np.fromiter(map(len, self.parts), np.uint64, len(self.parts))
        sizes = np.array(self.sizes, np.uint64)
        return block_id, zip_bytes(ids), zip_ints(lens), zip_ints(sizes), zip_ints(rank[at]), zip_units([units[i] for i in order.tolist()]), len(units)


def pack_blocks(docs: DataFrame, id_col: str, text_col: str, split: Callable[[bytes], list[bytes]], block_units: int = BLOCK_UNITS) -> DataFrame:
    """One row per block of documents. ``split`` gives the units of a text; null counts as the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, block = TaskContext.get().partitionId(), itertools.count(), _Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                text = text or b""
                block.add(doc_id, split(text), len(text))
                if block.n >= block_units:
                    yield _batch(_BLOCKS, [block.row((part << 32) + next(number))])
                    block = _Block()
        if block.ids:
            yield _batch(_BLOCKS, [block.row((part << 32) + next(number))])

    picked = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return picked.mapInArrow(run, _BLOCKS)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (x.strip().split(" ") for x in ddl.split(","))])


def _batch(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    schema = arrow_schema(ddl)
    cols = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)


def value_units(
    docs: DataFrame,
    split: Callable[[bytes], list[bytes]],
    value: Callable[[list[bytes]], list[bytes]],
    emit: Callable[["Assembled"], pa.RecordBatch],
    out_ddl: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_units: int = BLOCK_UNITS,
    bucket_units: int = BUCKET_UNITS,
) -> DataFrame:
    """Rows of ``emit`` for every document. ``value`` maps a list of distinct units to their values (bytes of equal meaning for all blocks)."""
    spark = docs.sparkSession
    ship(spark)
    blocks = _bucketed(pack_blocks(docs, id_col, text_col, split, block_units))
    total = blocks.agg(F.sum("n_units")).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_units))

    def deal(batches):
        for batch in batches:
            for block_id, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                units = unzip_units(packed)
                if not units:
                    continue
                to = np.fromiter(map(zlib.crc32, units), np.uint32, len(units)) % n_buckets
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.diff(to[order])) + 1
                rows = []
                for at in np.split(order, cuts):
                    rows.append((int(to[at[0]]), block_id, zip_units([units[i] for i in at.tolist()]), zip_ints(at.astype(np.uint32))))
                    if len(rows) == 64:
                        yield _batch(_DEALT, rows)
                        rows = []
                yield _batch(_DEALT, rows)

    def look_up(table: pa.Table) -> pa.Table:
        lists = [unzip_units(x) for x in table.column("units").to_pylist()]
        index: dict[bytes, int] = defaultdict(itertools.count().__next__)
        ats = [np.fromiter(map(index.__getitem__, units), np.int64, len(units)) for units in lists]
        values = value(list(index))
        rows = [(b, at, zip_units([values[i] for i in own.tolist()])) for b, at, own in zip(table.column("block_id").to_pylist(), table.column("at").to_pylist(), ats)]
        return pa.Table.from_batches([_batch(_VALUES, rows)])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            values: list[bytes] = [b""] * row["n_units"]
            for at, vals in zip(right.column("at").to_pylist(), right.column("vals").to_pylist()):
                for i, v in zip(unzip_ints(at).tolist(), unzip_units(vals)):
                    values[i] = v
            out.append(emit(Assembled(row, values)))
        schema = arrow_schema(out_ddl)
        return pa.Table.from_batches([b.cast(schema) for b in out], schema=schema)

    dealt = blocks.select("block_id", "units").mapInArrow(deal, _DEALT)
    values = dealt.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(look_up, _VALUES)
    held = blocks.select("block_id", "doc_ids", "doc_units", "doc_bytes", "planes", "n_units")
    return held.groupBy("block_id").cogroup(values.groupBy("block_id")).applyInArrow(assemble, out_ddl)


def _bucketed(blocks: DataFrame) -> DataFrame:
    """Write blocks once, already dealt by identifier, so that bringing values to them moves only the values."""
    spark = blocks.sparkSession
    path = new_path(spark, "blocks")
    name = "factloom_blocks_" + path.rsplit("-", 1)[1]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.format("parquet").bucketBy(n, "block_id").option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # out of the catalog; the files of a table with a path of its own stay, and the frame reads them
    return table


class Assembled:
    """A block again: ids and byte sizes of its documents, positions, and a value for each distinct unit."""

    def __init__(self, row: dict, values: list[bytes]) -> None:
        raw = unzip_bytes(row["doc_ids"])
        lens = unzip_ints(row["doc_units"]).astype(np.int64)
        n = len(lens)
        ids = np.frombuffer(raw[: 8 * n], np.int64).tolist()
        null = raw[8 * n :]
        self.doc_ids = [None if null[i] else ids[i] for i in range(n)]
        self.n_bytes = unzip_ints(row["doc_bytes"]).astype(np.int64).tolist()
        self.at = unzip_ints(row["planes"])
        self.ends = np.cumsum(lens)
        self.starts = self.ends - lens
        self.values = values
