"""Operator 10: SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, in tiles, with numpy exclusive-or and bit counts. Distinct fingerprints are put in
cells by the population counts of their four 16-bit quarters and cells are cut into tiles. Two fingerprints at distance r
differ in these counts by r in sum at most, so tile pairs whose counts differ by more than the radius are skipped and
nothing is lost: that leaves about a twentieth of all pairs. A tile travels to the neighbouring cells, not its members'
pairs; a tile pair gives a spanning forest of its links, never all pairs of a group.

Copies collapse into one fingerprint before any comparison. The work that remains grows with the square of the number of
*distinct* fingerprints over about twenty; that is the price of an exact comparison.

Defined results: null and word-less texts have fingerprint zero and link like any other; a null id has its row, but names a
component only where no other id does (null then); repeated rows stay; an empty table gives an empty result; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, materialize, ship
from .graph import components

TILE = 2048


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the ``width``-word shingles of a text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = len(words)
    if n < width:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    else:
        flat = b" ".join(words)
        lens = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lens + 1) - 1
        starts = (ends - lens).tolist()
        digest = xxhash.xxh64_intdigest
        pairs = zip(starts, ends[width - 1 :].tolist())
        hashes = np.fromiter((digest(flat[a:b], seed) for a, b in pairs), np.uint64, n - width + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        some = hashes[i : i + 8192].astype("<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, width) for t in as_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewer edges with the same components, for edges a-b on 0..n-1: each touched node and its smallest one."""
    if len(a) <= 64:
        return a, b
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            same = batch.column(0).to_pylist()
            left, right = batch.column(1), batch.column(2)
            sides = [(c.values.to_numpy().view(np.uint64), c.offsets.to_numpy()) for c in (left, right)]
            (lv, lo), (rv, ro) = sides
            for i, own in enumerate(same):
                x, y = lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]]
                near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
                if own:
                    near = np.triu(near, 1)
                if not near.any():
                    continue
                p, q = np.nonzero(near)
                nodes = np.concatenate([x, y])
                p, q = forest(p, q + len(x), len(nodes))
                out_a.append(nodes[p])
                out_b.append(nodes[q])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).view(np.int64)) for o in (out_a, out_b)], names=["src", "dst"])

    return run


def links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Edges (src, dst) whose components are those of all pairs of distinct ``fp`` at ``radius`` bits or fewer."""
    ship(fps.sparkSession)
    cell = ["c0", "c1", "c2", "c3"]
    counted = fps.select("fp", *[F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long"))).cast("int").alias(c) for i, c in enumerate(cell)])
    sizes = F.broadcast(counted.groupBy(*cell).agg(F.ceil(F.count("*") / tile).cast("int").alias("n")))  # 17 ** 4 rows at most
    salted = counted.join(sizes, cell).withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    tiles = materialize(salted.groupBy(*cell, "salt").agg(F.collect_list("fp").alias("fps")), "tiles")
    steps = [o for o in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, o)) <= radius and o >= (0, 0, 0, 0)]
    step = F.explode(F.array(*[F.array(*map(F.lit, o)) for o in steps])).alias("o")
    sent = tiles.select(*cell, F.col("salt").alias("salt_a"), F.col("fps").alias("fps_a"), step)
    sent = sent.select(*[(F.col(c) + F.col("o")[i]).alias(c) for i, c in enumerate(cell)], "salt_a", "fps_a", F.forall("o", lambda x: x == 0).alias("home"))
    pairs = sent.join(tiles, cell).where("not home or salt_a <= salt")
    return pairs.select((F.col("home") & (F.col("salt_a") == F.col("salt"))).alias("own"), "fps_a", "fps").mapInArrow(_compare(radius), "src long, dst long")


def _components(keyed: DataFrame, radius: int, tile: int) -> DataFrame:
    """(fp, component, first_id) of each distinct fingerprint of (doc_id, fp) rows."""
    firsts = materialize(keyed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = components(links(firsts.select("fp"), radius, tile))
    return firsts.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest id reachable by links) of each document."""
    keyed = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    labelled = _components(keyed, radius, tile)
    roots = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(roots, "component").select("fp", "component_id")
    return keyed.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """One row of each component: the smallest id, ids before nulls; of several rows with that id, the smallest text hash, then the smallest hash of the other columns."""
    mark = [F.col("doc_id").isNull().alias("_null"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("_id"), F.xxhash64("text").alias("_hash")]
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), mark[2])
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t) for t in as_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "_hash", "fp"])

    keyed = materialize(hashed.mapInArrow(run, "doc_id long, _hash long, fp long"), "fingerprints")
    labelled = _components(keyed.select("doc_id", "fp"), radius, tile)
    first = keyed.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0)).alias("_id"), "_hash")).alias("k"))
    kept = labelled.join(first, "fp").groupBy("component").agg(F.min("k").alias("k")).select("k.*")
    key = ["_null", "_id", "_hash"]
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]))) if names else F.lit(0)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *mark, rest.alias("_rest"))  # so that no name clashes
    one = packed.join(kept, key, "left_semi").withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy("_rest")))
    return one.where("_rn = 1").select("_row.*")
