"""Operator 9: mixing sources to target weights by capped water-filling.

Sources share all words by weight; a source that would get more than ``max_epochs`` times its own words stops there and the rest is
shared out again by weight until none is above. That is the level L with ``sum(min(cap, L * weight)) = total``; rounds
over the table of sources find it, and only sums leave the cluster. A source is then repeated ``target / size``
times: whole repetitions of every document, and for the fraction a seeded sample. From the largest size down, as many documents of a size are taken
once more as bring the words taken nearest to those wanted so far; which ones, a hash of the identifier decides. So words taken follow words wanted
to within a small document, and the sample is the same however the documents are dealt.

Defined results: null and word-less texts have size 0 and are never taken; a null source is a source of its own and comes
last; null ids and repeated rows are rows like others; an empty table, or one without words, gives
targets of 0; other columns pass through :func:`sample` whatever their names.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import attach, ranks
from .common import global_rank, materialize, ship

_KEY = "coalesce(concat('s', {0}), 'n')"


def size_of(text: Column) -> Column:
    """Number of words: positions where a word starts."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(plain, " "), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0) -> DataFrame:
    """(source_key, source_size, n_docs, target) of (source_key, source, size) rows."""
    per = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = global_rank(per, F.col("source").asc_nulls_last())
    cycle = F.get(F.array(*map(F.lit, weights)), (F.col("rank0") % len(weights)).cast("int"))
    t = materialize(ranked.select("source_key", "source_size", "n_docs", cycle.alias("weight"), (F.col("source_size") * float(max_epochs)).alias("cap")), "sources")
    total, weight = t.agg(F.sum("source_size"), F.sum("weight")).first()
    level = total / weight if weight else 0.0
    while total:
        over = F.col("cap") < level * F.col("weight")
        full, open_ = t.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        new = (total - full) / open_ if open_ else level
        if new <= level * (1 + 1e-15):
            break
        level = new
    return t.select("source_key", "source_size", "n_docs", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def _draw(seed: int, *cols: Column) -> Column:
    """A seeded number in [0, 1) from the leading 32 bits of an MD5 sum."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32


_CLASSES = "source_key string, size long, whole long, more long, source_size long, target double"


def _fold(group: pa.Table) -> pa.Table:
    """How many documents of each size are taken once more, of one source: from the largest size down, as many as bring the words taken nearest
    to those wanted so far."""
    g = group.sort_by([("size", "descending")])
    part, taken, wanted, more = g.column("part").to_pylist(), 0, 0, []
    for p, s, n in zip(part, g.column("size").to_pylist(), g.column("n").to_pylist()):
        wanted += s * n
        k = max(0, min(n, math.floor((p * wanted - taken) / s + 0.5)))
        taken += k * s
        more.append(k)
    return g.select(["source_key", "size", "whole"]).append_column("more", pa.array(more, pa.int64())).append_column("source_size", g.column("source_size")).append_column("target", g.column("target"))


def plan(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0, seed: int = 7, text_hash: bool = False) -> DataFrame:
    """Of every document: size, source_size, target, times (how often the mix takes it) and taken (words)."""
    ship(docs.sparkSession)
    key = [F.xxhash64("text").alias("text_hash")] if text_hash else []
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(_KEY.format("source")).alias("source_key"), "source", size_of(F.col("text")).alias("size"), *key)
    base = materialize(base, "sizes")
    t = materialize(targets(base, weights, max_epochs), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    classes = base.groupBy("source_key", "size").agg(F.count("*").alias("n")).join(t.drop("n_docs"), "source_key").withColumn("whole", F.floor(rate + 1e-12))
    classes = classes.withColumn("part", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    # a row for each size in a source: with w words in all there are at most the square root of 2 w of them
    folded = classes.where("size > 0").groupBy("source_key").applyInArrow(_fold, _CLASSES)
    none = classes.where("size = 0").select("source_key", "size", F.lit(0).cast("long").alias("whole"), F.lit(0).cast("long").alias("more"), "source_size", "target")
    drawn = base.drop("source").withColumn("draw", _draw(seed, F.col("doc_id")))
    ranked = ranks(drawn, ["source_key", "size"], [F.col("draw"), F.col("doc_id").asc_nulls_first(), *([F.col("text_hash")] if text_hash else [])], "place")
    got = attach(ranked, folded.union(none), ["source_key", "size"])
    times = (F.col("whole") + (F.col("place") < F.col("more")).cast("long")).alias("times")
    names = ["doc_id", "source_key", "size", *(["text_hash"] if text_hash else []), "source_size", "target"]
    return got.select(*names, times).withColumn("taken", F.col("times") * F.col("size"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as the mix takes it, with the columns of ``docs``. Rows equal in id, source and text share their repetitions."""
    got = plan(docs, text_hash=True, **options)
    key = {"_k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_k2": F.col("doc_id").isNull()}
    total = got.select(*[v.alias(k) for k, v in key.items()], F.col("source_key").alias("_k3"), F.col("text_hash").alias("_k4"), "times")
    total = total.groupBy("_k1", "_k2", "_k3", "_k4").agg(F.sum("times").alias("_t"), F.count("*").alias("_m")).where("_t > 0")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*cols).alias("_row"), *[v.alias(k) for k, v in key.items()], F.expr(_KEY.format("source")).alias("_k3"), F.xxhash64("text").alias("_k4"))
    both = keyed.join(total, ["_k1", "_k2", "_k3", "_k4"])
    even = both.where("_t % _m = 0").select("_row", (F.col("_t") / F.col("_m")).cast("long").alias("_times"))
    odd = materialize(both.where("_t % _m <> 0").withColumn("_at", F.monotonically_increasing_id()), "copies")
    share = F.col("_t") / F.col("_m")
    odd = ranks(odd, ["_k1", "_k2", "_k3", "_k4"], [F.col("_at")], "_rn").select("_row", (F.floor((F.col("_rn") + 1) * share + 0.5) - F.floor(F.col("_rn") * share + 0.5)).alias("_times"))
    return even.union(odd).where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).select("_row.*")
