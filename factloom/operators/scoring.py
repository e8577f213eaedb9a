"""Scores of every query of a stated set against every fact, in tiles.

What depends on a fact or a query alone is worked out once, before they meet; a task then handles matrices of a tile of queries and a tile of
facts. Link spreading is linear in the similarities: the sum over a fact's links of strength times the similarity of the far end with the query
is the query's similarity with one vector of the fact, the strength-weighted sum of the far ends' vectors. So links never meet queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import materialize
from ..functions import patterns as P
from ..functions import text as T
from ..shipping import ship
from . import tiles
from .ranking import COMPONENTS, SCOPE_MULTIPLIER, W_IMPORTANCE, W_SEMANTIC

_SHAPE_WEIGHTS = [w for *_, w in P.ANSWER_SHAPES]
#: Links of a block, and vectors of a tile that it meets.
LINKS, VECTORS = 65_536, 8192


class _Spread:
    """The sums of a block of links, which a tile of vectors after the other adds to."""

    def __init__(self, links: pa.StructArray) -> None:
        source, target, strength = _ids(links, "source_id"), _ids(links, "target_id"), tiles.numbers(links, "strength", 0.0)
        self.ids, at = np.unique(source, return_inverse=True)
        by = np.argsort(target, kind="stable")
        self.target, self.at, self.strength = target[by], at[by], strength[by]
        self.sums, self.met = np.zeros((len(self.ids), 0)), np.zeros(len(self.ids), bool)

    def add(self, own: pa.StructArray) -> None:
        ids, v = _ids(own, "id"), tiles.vectors(own, "embedding")
        lo, hi = np.searchsorted(self.target, ids), np.searchsorted(self.target, ids, "right")
        n = hi - lo
        if not n.any():
            return
        link = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        far, at = np.repeat(np.arange(len(ids)), n), self.at[link]
        by = np.argsort(at, kind="stable")
        link, far, at = link[by], far[by], at[by]
        heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        self.sums, v = tiles.widen(self.sums, v)
        self.sums[at[heads]] += np.add.reduceat(self.strength[link][:, None] * v[far], heads, axis=0)
        self.met[at] = True

    def done(self) -> Iterator[pa.RecordBatch]:
        keep = np.flatnonzero(self.met)
        for lo in range(0, len(keep), 1024):
            own = keep[lo : lo + 1024]
            rows = self.sums[own]
            ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * rows.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[own]), pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], names=["id", "part"])


def spread(links: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, spread): for each source of a link, the sum of strength times the unit vector of its targets. ``vectors`` has (id, embedding).

    Links are dealt by ranges of both ends, so a hub is no hot key, and blocks of them meet the vectors where they lie: no vector is sent along a link.
    """
    ship(vectors.sparkSession)
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = links.select("source_id", "target_id", "strength").repartitionByRange(n, "source_id", "target_id").sortWithinPartitions("source_id")
    sums = tiles.meet_all(tiles.packed(dealt, LINKS, "links"), tiles.packed(vectors.select("id", "embedding"), VECTORS, "vectors"), _Spread, "id long, part array<double>", "spread")
    if width <= 0:
        return sums.select("id", F.array().cast("array<double>").alias("spread")).distinct()
    own = sums.groupBy("id").agg(*[F.sum(F.coalesce(F.get("part", F.lit(i)), F.lit(0.0))).alias(f"_{i}") for i in range(width)])
    return own.select("id", F.array(*[f"_{i}" for i in range(width)]).alias("spread"))


def fact_features(facts: DataFrame) -> DataFrame:
    """What scoring needs of a fact's text: adversarial score, terms of the target, terms of target and content, answer-shape flags, and
    whether it counts as settled. Needs content, target and type."""
    target = T.terms(F.col("target"))
    own = F.array_union(T.terms(F.col("content")), F.when(F.col("target") != "general", target).otherwise(F.array().cast("array<string>")))
    settled = T.category(F.col("content")).isin("decision", "correction", "procedural", "causal") | F.col("type").isin("C", "D")
    return facts.withColumns({"adv": T.adversarial(F.col("content")), "target_terms": target, "own_terms": own, "text_flags": T.shape_text_flags(F.col("content")), "settled": settled})


def features_once(facts: DataFrame) -> DataFrame:
    """:func:`fact_features` worked out once for each content, target and type, on all cores however few files the facts come from."""
    spark, names = facts.sparkSession, ["content", "target", "type"]
    kinds = facts.select(*names).distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *names)
    kinds = materialize(fact_features(kinds), "features")
    kinds = kinds.select(*[F.col(c).alias(f"_{c}") for c in names], *[c for c in kinds.columns if c not in names])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    return facts.join(kinds, same[0] & same[1] & same[2]).drop(*[f"_{c}" for c in names])


def query_features(queries: DataFrame) -> DataFrame:
    """Terms, answer-shape flags and the wanted fact type of each question."""
    want = T.lookup(T.intent(F.col("query")), {"value": "V", "constraint": "C", "decision": "D"})
    return queries.withColumns({"query_terms": T.terms(F.col("query")), "query_flags": T.shape_query_flags(F.col("query")), "want": want})


def _flags(rows: pa.StructArray, name: str) -> np.ndarray:
    col = tiles.field(rows, name)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).astype(bool)


def _shapes(asked: pa.StructArray, facts: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """(of, shape): shape[of[i], j] is the answer-shape score of query i and fact j; equal flags of queries count once."""
    kinds, of = np.unique(_flags(asked, "query_flags"), axis=0, return_inverse=True)
    own = _flags(facts, "text_flags")
    out = np.zeros((len(kinds), len(own)))
    for i, w in enumerate(_SHAPE_WEIGHTS):
        out += np.where(kinds[:, i, None] & own[None, :, i], w, 0.0)
    return of.reshape(-1), out


def _ids(rows: pa.StructArray, name: str) -> np.ndarray:
    return tiles.field(rows, name).cast(pa.int64()).to_numpy(zero_copy_only=False)


def _kept(x: DataFrame, names: tuple[str, ...]) -> list[str]:
    kinds = dict(x.dtypes)
    return [f"`{n}` {kinds[n]}" for n in names]


def text_scores(facts: DataFrame, queries: DataFrame, keep: tuple[str, ...] = (), ask: tuple[str, ...] = (), terms: str = "own_terms") -> DataFrame:
    """(query_id, id, shape, boost, met, and the columns ``keep`` of facts and ``ask`` of queries) for every query and fact.

    ``shape`` is the answer-shape score, ``boost`` 0.18 for each query term that meets one of the fact's ``terms`` (at most 0.45), ``met`` whether any does.
    """
    ship(facts.sparkSession)
    f = facts.select("id", "text_flags", F.col(terms).alias("_terms"), *keep)
    q = queries.select("query_id", "query_flags", "query_terms", *ask)
    out = ", ".join(["query_id long", "id long", "shape double", "boost double", "met boolean", *_kept(facts, keep), *_kept(queries, ask)])

    def run(asked: pa.StructArray, own: pa.StructArray) -> Iterator[pa.RecordBatch]:
        qi, fi = _ids(asked, "query_id"), _ids(own, "id")
        _, term_of, hits = tiles.term_hits(tiles.field(asked, "query_terms"), tiles.field(own, "_terms"))
        boost, met = np.minimum(0.45, 0.18 * hits), hits > 0
        shape_of, shape = _shapes(asked, own)
        for lo in range(0, len(qi), 64):
            n = len(qi[lo : lo + 64])
            at, to = np.repeat(np.arange(lo, lo + n), len(fi)), np.tile(np.arange(len(fi)), n)
            cols = [pa.array(qi[at]), pa.array(fi[to]), pa.array(shape[shape_of[lo : lo + n]].ravel()), pa.array(boost[term_of[lo : lo + n]].ravel()), pa.array(met[term_of[lo : lo + n]].ravel())]
            cols += [tiles.field(own, c).take(pa.array(to)) for c in keep] + [tiles.field(asked, c).take(pa.array(at)) for c in ask]
            yield pa.RecordBatch.from_arrays(cols, names=["query_id", "id", "shape", "boost", "met", *keep, *ask])

    return tiles.meet(q, f, run, out, ("query_id", "id"))


FACT_COLUMNS = ["id", "row_seq", "embedding", "spread", "base", "spike", "importance", "access_count", "scope", "adv", "target_terms", "own_terms", "text_flags"]
QUERY_COLUMNS = ["query_id", "embedding", "query_scope", "query_terms", "query_flags"]


def cells(asked: pa.StructArray, own: pa.StructArray, terms: bool = True) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(lo, sim, components, score, met) of all facts of a tile and the queries from ``lo`` on, in the order of :data:`COMPONENTS`, as matrices.
    Without ``terms``, met is that of the target alone."""
    qi, fi = _ids(asked, "query_id"), _ids(own, "id")
    qv, fv = tiles.widen(tiles.vectors(asked, "embedding"), tiles.vectors(own, "embedding"))
    qu, fu = tiles.widen(tiles.vectors(asked, "embedding"), tiles.vectors(own, "spread", unit=False))
    base, spike = tiles.numbers(own, "base"), tiles.numbers(own, "spike", 0.0)
    imp, n, adv = tiles.numbers(own, "importance"), tiles.numbers(own, "access_count"), tiles.numbers(own, "adv")
    eff = np.where(n > 5, imp * (1.0 - 0.5 * np.exp(-n / 20.0)), imp)
    weight = 2.0 + np.maximum(np.abs(base), 1.0)
    penalty = np.where(adv > 0.2, -10.0 * adv, 0.0)
    scopes = ["" if s is None or s == "global" else s for s in tiles.field(own, "scope").to_pylist()]
    wanted = tiles.field(asked, "query_scope").to_pylist()
    inside = {s: np.array([bool(x) and x.startswith(s) for x in scopes], bool) for s in set(wanted) if s is not None}
    _, term_of, target_hits = tiles.term_hits(tiles.field(asked, "query_terms"), tiles.field(own, "target_terms"))
    boost = np.minimum(0.45, 0.18 * target_hits)
    met = (tiles.term_hits(tiles.field(asked, "query_terms"), tiles.field(own, "own_terms"))[2] if terms else target_hits) > 0
    shape_of, shape = _shapes(asked, own)
    none = np.zeros(len(fi), bool)
    for lo in range(0, len(qi), 64):
        hi = min(lo + 64, len(qi))
        sim = qv[lo:hi] @ fv.T
        heb = np.minimum(qu[lo:hi] @ fu.T, 1.0)
        here = np.array([inside.get(s, none) for s in wanted[lo:hi]])
        parts = [
            np.broadcast_to(base, sim.shape),
            np.broadcast_to(spike, sim.shape),
            W_SEMANTIC * sim + heb,
            W_IMPORTANCE * eff * 1.5 + W_IMPORTANCE * eff * sim * weight,
            np.where(here, SCOPE_MULTIPLIER * (0.5 + 0.5 * sim), 0.0),
            np.broadcast_to(penalty, sim.shape),
            boost[term_of[lo:hi]],
            shape[shape_of[lo:hi]],
        ]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        yield lo, sim, parts, total, met[term_of[lo:hi]]


def score(facts: DataFrame, queries: DataFrame, keep: tuple[str, ...] = (), ask: tuple[str, ...] = (), best: int | None = None) -> DataFrame:
    """(query_id, id, sim, the eight components, score, met, and the columns ``keep`` of facts and ``ask`` of queries) for every query and fact.

    ``facts`` has id, row_seq, embedding, spread, base, spike, importance, access_count, scope and the columns of :func:`fact_features`;
    ``queries`` has query_id, embedding, query_scope and those of :func:`query_features`. Null spread and spike add nothing. With ``best``
    only the rows that can be among a query's best so many leave a task (those of its tile; ties go to the smaller row_seq).
    """
    ship(facts.sparkSession)
    f = facts.select(*FACT_COLUMNS, *[F.col(c).alias(f"keep_{c}") for c in keep])
    q = queries.select(*QUERY_COLUMNS, *[F.col(c).alias(f"ask_{c}") for c in ask])
    names = ["query_id", "id", "sim", *COMPONENTS, "score", "met", *keep, *ask]
    out = ", ".join(["query_id long", "id long", "sim double", *[f"{c} double" for c in COMPONENTS], "score double", "met boolean", *_kept(facts, keep), *_kept(queries, ask)])

    def run(asked: pa.StructArray, own: pa.StructArray) -> Iterator[pa.RecordBatch]:
        qi, fi, seq = _ids(asked, "query_id"), _ids(own, "id"), _ids(own, "row_seq")
        for lo, sim, parts, total, met in cells(asked, own):
            if best is not None and best < len(fi):
                order = np.lexsort((np.broadcast_to(seq, total.shape), -total), axis=1)[:, :best]
            else:
                order = np.broadcast_to(np.arange(len(fi)), total.shape)
            at, to = np.repeat(np.arange(lo, lo + len(total)), order.shape[1]), order.ravel()
            pick = (at - lo, to)
            cols = [pa.array(qi[at]), pa.array(fi[to]), pa.array(sim[pick]), *[pa.array(p[pick]) for p in parts], pa.array(total[pick]), pa.array(met[pick])]
            cols += [tiles.field(own, f"keep_{c}").take(pa.array(to)) for c in keep] + [tiles.field(asked, f"ask_{c}").take(pa.array(at)) for c in ask]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return tiles.meet(q, f, run, out, ("query_id", "id"))
