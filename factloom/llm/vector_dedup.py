"""Operator 5: near-duplicate vectors by a random-projection tree forest.

Every tree splits the vectors of a label at the median of a random projection, again and again, until a node is small or a
split no longer separates it. Vectors near a split go to both sides (spill), so that close vectors seldom part in one tree
and hardly ever in all. Medians come from mergeable quantile summaries over all vectors of a node; no sample is
fitted. Inside leaves, cosines are computed in double precision, in tiles; links below the threshold don't count.

A pair may meet in several leaves; it counts in the first of the leaves that both vectors are in, so link counts
are exact for the links found. Equal vectors collapse first and count by their number. A tile pair gives link counts
and a spanning forest, never the pairs themselves. A leaf that cannot be split, such as thousands of near copies, is compared
whole, tile by tile.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows without a label, link with nothing and are
their own component; vectors of different lengths don't link; repeated ids stay, a row each; a null id
names a component only where no other id does, and is not kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import attach
from .common import drop_table, materialize, ship
from .graph import components
from .simhash import forest

TREES, LEAF, LEVELS, TILE = 4, 1024, 24, 1024
#: Half the width of the spill zone, in standard deviations of the projected difference of two vectors at the threshold. At 1.0 a
#: node's children hold about a quarter more than the node, and such a pair parts in about 0.2 % of the splits of one tree; at 0.5
#: they hold about 8 % more, and it parts in about 1 %.
SPILL = 1.0


def _directions(seed: int, level: int, trees: int, width: int) -> np.ndarray:
    """A random unit direction for each tree at a level."""
    r = np.random.default_rng([seed, level, width]).standard_normal((trees, width))
    return r / np.linalg.norm(r, axis=1, keepdims=True)


def _project(trees: int, level: int, seed: int):
    """The projection of each unit vector on the direction of its tree at this level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            col, tree = batch.column("v"), batch.column("tree").to_numpy()
            lens = np.diff(col.offsets.to_numpy())
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(lens) - lens
            x = np.zeros(len(lens))
            for d in np.unique(lens).tolist():
                if d not in made:
                    made[d] = _directions(seed, level, trees, d)
                own = np.flatnonzero(lens == d)
                m = flat[starts[own][:, None] + np.arange(d)]
                x[own] = np.einsum("ij,ij->i", m, made[d][tree[own]]) / np.linalg.norm(m, axis=1)
            kept = [batch.column(c) for c in ("rid", "label", "tree", "node")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(x.astype(np.float32)), pa.array(lens.astype(np.int32))], names=["rid", "label", "tree", "node", "x", "d"])

    return run


def leaves(vectors: DataFrame, threshold: float, trees: int = TREES, leaf: int = LEAF, levels: int = LEVELS, seed: int = 17) -> DataFrame:
    """(rid, label, tree, node) of every leaf each of the (rid, label, v) vectors is in.

    Between levels only the places of vectors are kept; a vector's projection on the next direction is worked out when it is needed. Tables of past
    levels are dropped.
    """
    whole = vectors.select("rid", "label", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).cast("long").alias("node"))
    sizes = _sizes(whole)
    done = [materialize(whole.join(sizes.where(F.col("n") <= leaf), ["label", "tree", "node"], "left_semi").select("rid", "label", "tree", "node"), "leaves")]
    active = materialize(whole.join(sizes.where(F.col("n") > leaf), ["label", "tree", "node"], "left_semi").select("rid", "label", "tree", "node"), "nodes")
    for level in range(levels):
        if active.isEmpty():
            break
        placed = active.join(vectors.select("rid", "v"), "rid").select("rid", "label", "tree", "node", "v").mapInArrow(_project(trees, level, seed), "rid long, label int, tree int, node long, x float, d int")
        spill = F.sqrt(2 * (1 - threshold) / F.col("d") * SPILL**2)
        at = materialize(placed.withColumn("s", spill.cast("float")).drop("d"), "projected")
        stats = at.groupBy("label", "tree", "node").agg(F.count("*").alias("n"), F.percentile_approx("x", 0.5, 1000).alias("cut"), F.max("s").alias("w"))
        both = attach(at.drop("s"), stats, ["label", "tree", "node"])
        left, right = F.col("x") <= F.col("cut") + F.col("w"), F.col("x") >= F.col("cut") - F.col("w")
        # a split into two sides that both hold nearly all of the node separates nothing
        held = both.groupBy("label", "tree", "node").agg(F.sum(left.cast("long")).alias("n0"), F.sum(right.cast("long")).alias("n1"), F.first("n").alias("n"))
        held = materialize(held.withColumn("stuck", (F.greatest("n0", "n1") > 0.9 * F.col("n")) | F.lit(level == levels - 1)), "sides")
        marked = attach(both.drop("n"), held, ["label", "tree", "node"])
        sides = F.array_compact(F.array(F.when(left, F.struct(F.lit(0).alias("side"), F.col("n0").alias("m"))), F.when(right, F.struct(F.lit(1).alias("side"), F.col("n1").alias("m")))))
        done.append(materialize(marked.where("stuck").select("rid", "label", "tree", "node"), "leaves"))
        grown = marked.where("not stuck").select("rid", "label", "tree", F.explode(sides).alias("o"), "node").select("rid", "label", "tree", (F.col("node") * 2 + F.col("o.side")).alias("node"), F.col("o.m").alias("m"))
        grown = materialize(grown, "grown")
        done.append(grown.where(F.col("m") <= leaf).select("rid", "label", "tree", "node"))
        new = grown.where(F.col("m") > leaf).select("rid", "label", "tree", "node")
        drop_table(at)
        if level == 0:
            drop_table(active)
        active = new
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def _sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("label", "tree", "node").agg(F.count("*").alias("n"))


_TILE = "struct<rid:long,mult:long,v:array<float>,codes:array<long>>"


def _compare(threshold: float):
    def unpack(rows: list[dict]):
        lens = {len(r["v"]) for r in rows}
        for d in sorted(lens):
            own = [r for r in rows if len(r["v"]) == d]
            v = np.array([r["v"] for r in own], np.float64)
            yield d, (np.array([r["rid"] for r in own]), np.array([r["mult"] for r in own]), v / np.linalg.norm(v, axis=1, keepdims=True), [r["codes"] for r in own])

    def bits(codes: list[list[int]], index: dict[int, int]) -> np.ndarray:
        out = np.zeros((len(codes), len(index) // 64 + 1), np.uint64)
        for i, own in enumerate(codes):
            for c in own:
                if (k := index.get(c)) is not None:
                    out[i, k >> 6] |= np.uint64(1 << (k & 63))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, code, left, right in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                rows: list[list] = [[], [], [], []]
                there = dict(unpack(right))
                for d, (ra, ma, va, ca) in unpack(left):
                    if d not in there:
                        continue
                    rb, mb, vb, cb = there[d]
                    near = va @ vb.T >= threshold
                    if own:
                        near = np.triu(near, 1)
                    i, j = np.nonzero(near)
                    if not len(i):
                        continue
                    earlier = {c: k for k, c in enumerate(sorted({c for x in ca for c in x if c < code}))}
                    ba, bb = bits(ca, earlier), bits(cb, earlier)
                    new = np.ones(len(i), bool)
                    for w in range(ba.shape[1]):
                        new &= (ba[i, w] & bb[j, w]) == 0
                    i, j = i[new], j[new]
                    if not len(i):
                        continue
                    na, nb = len(ra), len(rb)
                    counts = np.concatenate([np.bincount(i, mb[j], na), np.bincount(j, ma[i], nb)]).astype(np.int64)
                    rids = np.concatenate([ra, rb])
                    p, q = forest(i, j + na, na + nb)
                    if own:
                        p, q = forest(i, j, na)
                    some = np.flatnonzero(counts)
                    rows[0] += rids[some].tolist() + rids[p].tolist()
                    rows[1] += counts[some].tolist() + [0] * len(p)
                    rows[2] += [None] * len(some) + rids[q].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64())], names=["rid", "n", "other"])

    return run


def found_links(vectors: DataFrame, threshold: float, tile: int = TILE, **options) -> DataFrame:
    """Rows (rid, n, other): with ``other`` null a count of links of ``rid``, else an edge of a spanning forest."""
    member = materialize(leaves(vectors, threshold, **options), "leaves")
    code = F.shiftleft(F.col("label").cast("long").bitwiseAND(F.lit(0x7FFFFFFF).cast("long")), 31) + F.shiftleft(F.col("tree").cast("long"), 28) + F.col("node")
    coded = member.withColumn("code", code)
    own = coded.groupBy("rid").agg(F.sort_array(F.collect_list("code")).alias("codes"))  # at most trees * 2 ** levels, in truth a few
    sizes = coded.groupBy("label", "code").agg(F.ceil(F.count("*") / tile).cast("int").alias("n_tiles"))
    full = vectors.join(own, "rid")
    placed = coded.select("rid", "label", "code").join(sizes, ["label", "code"]).withColumn("tile", F.pmod(F.xxhash64("rid"), "n_tiles").cast("int"))
    rows = placed.join(full.drop("label"), "rid")
    tiles = materialize(rows.groupBy("label", "code", "tile", "n_tiles").agg(F.collect_list(F.struct("rid", "mult", "v", "codes")).alias("rows")), "tiles")
    sent = tiles.select("label", "code", F.col("tile").alias("a"), F.col("rows").alias("rows_a"), F.explode(F.sequence("tile", F.col("n_tiles") - 1)).alias("tile"))
    pairs = sent.join(tiles, ["label", "code", "tile"]).select((F.col("a") == F.col("tile")).alias("own"), "code", "rows_a", "rows")
    return pairs.mapInArrow(_compare(threshold), "rid long, n long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """vec_id, n_links, component_id and kept for each vector."""
    ship(vectors.sparkSession)
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.col("label").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("v"), F.col(label_col).cast("int").alias("label")).withColumn("ok", F.coalesce(ok, F.lit(False)))
    reps = rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("mult"))
    reps = materialize(reps.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    found = materialize(found_links(reps, threshold, **options), "links")
    counts = found.where("other is null").groupBy("rid").agg(F.sum("n").alias("n"))
    comps = components(found.where("other is not null").select(F.col("rid").alias("src"), F.col("other").alias("dst")))
    labelled = reps.select("rid", "label", "v", "first_id", "mult").join(comps, F.col("rid") == F.col("node"), "left").withColumn("root", F.coalesce("component", "rid"))
    roots = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(roots, "root").join(counts, "rid", "left").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    good = rows.where("ok").join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    bad = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
