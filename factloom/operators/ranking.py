"""Ranking: activation, components, fusion, reranking, dampening, bias correction, diversity.

Every stage takes and returns a frame with a row per (query_id, id), so that many queries rank in one job. Scores of candidates come from
:mod:`.scoring`. The clock is a parameter everywhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..frames import attach, materialize, ranks
from ..functions import text as T

DECAY, W_SEMANTIC, W_IMPORTANCE, SCOPE_MULTIPLIER = Config.decay, Config.w_semantic, Config.w_importance, Config.scope_multiplier
COMPONENTS = ["base_level", "revival_spike", "spreading", "importance_boost", "scope_boost", "adversarial_penalty", "target_match_boost", "answer_shape_boost"]
RRF_K, W_ACTIVATION, W_KEYWORD = Config.rrf_k, Config.w_activation, Config.w_keyword


def base_level(access: DataFrame, now: float, rate: Column | None = None, key: str = "fact_id", at: str = "seen_at") -> DataFrame:
    """(key, base): logarithm of the summed power-law recency of all accesses."""
    power = -DECAY * (F.lit(1.0) if rate is None else rate)
    elapsed = F.lit(now) - F.col(at)
    passed = F.when(elapsed > 0, elapsed).otherwise(0.001)
    return access.groupBy(key).agg(F.ln(F.sum(F.pow(passed, power))).alias("base"))


def revival(links: DataFrame, now: float) -> DataFrame:
    """(id, spike): 0.2 * exp(-0.2 * days) for facts whose newest link at either end is 14 days old at most."""
    ends = links.select(F.col("source_id").alias("id"), "last_updated").union(links.select("target_id", "last_updated"))
    days = (F.lit(now) - F.col("newest")) / 86400.0
    newest = ends.groupBy("id").agg(F.max("last_updated").alias("newest"))
    return newest.where(days <= 14).select("id", (0.2 * F.exp(-0.2 * days)).alias("spike"))


def effective_importance(importance: Column, n: Column) -> Column:
    return F.when(n > 5, importance * (1.0 - 0.5 * F.exp(-n / 20.0))).otherwise(importance)


def importance_boost(importance: Column, n: Column, base: Column, sim: Column) -> Column:
    eff = effective_importance(importance, n)
    return W_IMPORTANCE * eff * 1.5 + W_IMPORTANCE * eff * sim * (2.0 + F.greatest(F.abs(base), F.lit(1.0)))


def hebbian(links: DataFrame, sims: DataFrame) -> DataFrame:
    """(query_id, id, heb): strengths of out-links times the similarity of their ends, at most 1. ``sims`` has (query_id, id, sim)."""
    far = sims.select("query_id", F.col("id").alias("target_id"), "sim")
    spread = links.join(far, "target_id").groupBy("query_id", F.col("source_id").alias("id"))
    return spread.agg(F.least(F.sum(F.col("strength") * F.col("sim")), F.lit(1.0)).alias("heb"))


def bm25(facts: DataFrame, queries: DataFrame, limit: int = 50) -> DataFrame:
    """(query_id, id, bm25): the best facts of each query; terms match as beginnings of tokens.

    ``facts`` has (id, text, allowed): all rows shape the statistics, allowed ones are returned. Prefixes are joined to the vocabulary alone, and only
    tokens that a prefix meets are counted. Queries with the same terms are
    answered once, and their answers, ``limit`` rows each, are dealt out at the end.
    """
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)
    split = facts.select("id", "allowed", tokens.alias("tokens"))
    sizes = split.select("id", "allowed", F.size("tokens").alias("len"))
    stats = sizes.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    keyed = materialize(queries.select("query_id", T.terms(F.col("query")).alias("terms")), "asked")
    asked = keyed.select("terms").distinct().withColumn("ask", F.xxhash64("terms"))
    asked = materialize(asked.select("ask", F.explode("terms").alias("term")), "terms")
    vocabulary = split.select(F.explode("tokens").alias("token")).distinct()
    lengths = F.expr("sequence(2, greatest(2, length(token)))")
    prefixes = vocabulary.withColumn("term", F.explode(F.transform(lengths, lambda n: F.substring("token", F.lit(1), n))))
    met = materialize(asked.join(prefixes, "term").select("ask", "term", "token"), "met")
    hits = attach(split.select("id", F.explode("tokens").alias("token")), met, "token").groupBy("ask", "term", "id").agg(F.count("*").alias("f"))
    hits = materialize(hits, "hits")
    df = hits.groupBy("ask", "term").agg(F.count("*").alias("n"))
    raw = F.ln((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(raw <= 0, 1e-6).otherwise(raw)
    norm = F.col("f") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avg_len"))
    x = attach(hits, df.crossJoin(F.broadcast(stats)), ["ask", "term"]).join(sizes, "id")  # one row of statistics
    scored = x.where("allowed").groupBy("ask", "id").agg(F.sum(idf * F.col("f") * 2.2 / norm).alias("bm25"))
    top = Window.partitionBy("ask").orderBy(F.desc(F.round("bm25", 9)), "id")
    best = scored.withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= limit).select("ask", "id", "bm25")
    return attach(keyed.select("query_id", F.xxhash64("terms").alias("ask")), best, "ask").select("query_id", "id", "bm25")


def fuse(x: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, id, row_seq, score, bm25): rank-only from the last negative score backwards, else weighted by score.

    A query's candidates are ranked where they lie (see :func:`frames.ranks`), so a query with any number of them is spread over tasks.
    """
    x = ranks(materialize(x, "candidates"), "query_id", [F.desc("score"), F.col("row_seq")], "r_act")
    x = ranks(x, "query_id", [F.desc("bm25"), F.col("row_seq")], "r_kw")
    last = x.where("score < 0").groupBy("query_id").agg(F.max("row_seq").alias("_last_negative"))
    x = attach(x, last, "query_id", "left").withColumn("negative", F.coalesce(F.col("row_seq") <= F.col("_last_negative"), F.lit(False))).drop("_last_negative")
    rank_only = W_ACTIVATION / (RRF_K + F.col("r_act") + 1) + W_KEYWORD / (RRF_K + F.col("r_kw") + 1)
    weighted = W_ACTIVATION * F.col("score") / (RRF_K + F.col("r_act") + 1) + W_KEYWORD * F.col("bm25") / (RRF_K + F.col("r_kw") + 1)
    return x.withColumn("rrf", F.when(F.col("negative"), rank_only).otherwise(weighted))


def fusion_wanted(x: DataFrame, has_typed: Column) -> DataFrame:
    """Whether each query fuses: a clear keyword match, or typed facts and a small gap between the first two scores in scan order."""
    place = F.struct(F.col("row_seq"), F.col("score"))
    first = x.groupBy("query_id").agg(F.max("bm25").alias("top"), F.max(has_typed).alias("typed"), F.min(place).alias("_p0"))
    first = materialize(first, "firsts")
    rest = attach(x, first.select("query_id", "_p0"), "query_id").where(F.col("row_seq") > F.col("_p0.row_seq"))
    g = first.join(rest.groupBy("query_id").agg(F.min(place).alias("_p1")), "query_id", "left")
    g = g.withColumns({"s0": F.col("_p0.score"), "s1": F.col("_p1.score")})
    gap = F.when(F.col("s0") != 0, F.abs(F.col("s0") - F.col("s1"))).otherwise(0.0)
    return g.select("query_id", ((F.col("top") > 0.15) | ((F.col("top") > 0) & F.col("typed") & F.col("s1").isNotNull() & (gap < 0.5))).alias("fuse"))


def _per_query(x: DataFrame, *aggs: Column) -> DataFrame:
    """Rows with aggregates over their query: combined before the shuffle, so that a query's candidates never meet in one task."""
    return attach(x, x.groupBy("query_id").agg(*aggs), "query_id")


def strong_match(x: DataFrame, score: str = "rrf") -> DataFrame:
    """Lift a dominant keyword match (over 0.3 and five times the next) above the best score."""
    place = F.struct(F.col("bm25"), (-F.col("row_seq")).alias("o"), F.col("id").alias("i"))
    tops = materialize(x.groupBy("query_id").agg(F.max(place).alias("_first"), F.max(score).alias("_top")), "tops")
    rest = attach(x, tops.select("query_id", "_first"), "query_id").where(F.col("id") != F.col("_first.i")).groupBy("query_id").agg(F.max("bm25").alias("_second"))
    x = attach(x, tops.join(rest, "query_id", "left"), "query_id")
    first, second = F.col("_first.bm25"), F.coalesce("_second", F.lit(0.0))
    dominant = (F.col("id") == F.col("_first.i")) & (first > 0.3) & ((second == 0) | (first / F.greatest(second, F.lit(0.001)) >= 5))
    lifted = F.col("_top") + F.abs("_top") * 0.5 + 0.1
    return x.withColumn("final", F.when(dominant, lifted).otherwise(F.col(score))).drop("_first", "_top", "_second")


def decayed_q(q: Column, updated: Column, now: float) -> Column:
    days = F.greatest((F.lit(now) - updated) / 86400.0, F.lit(0.0))
    m = F.when(q >= 0.7, 0.7).when(q <= 0.3, 1.3).otherwise(1.0)
    return q * F.exp(-0.007 * m * days)


def rerank(x: DataFrame, total_updates: int | Column) -> DataFrame:
    """Blend (query_id, id, score, q, n_retrieved) with learned utility and an exploration bonus."""
    t = F.lit(total_updates) if isinstance(total_updates, int) else total_updates
    lam = 0.05 + 0.30 * F.least(t / 200.0, F.lit(1.0))
    q = F.coalesce("q", F.lit(0.5))
    x = _per_query(x.withColumn("q", q), *[f(c).alias(f"_{n}_{c}") for c in ("score", "q") for n, f in (("avg", F.avg), ("std", F.stddev_pop))])

    def z(c: str) -> Column:
        return (F.col(c) - F.col(f"_avg_{c}")) / F.greatest(F.col(f"_std_{c}"), F.lit(0.001))

    n = F.coalesce("n_retrieved", F.lit(0))
    many = F.greatest(t, F.lit(1))
    bonus = F.when(n == 0, 0.5).otherwise(0.2 * F.sqrt(F.ln(many + 1) / F.when(n == 0, 1).otherwise(n) * 0.25))
    x = x.withColumn("blended", (1 - lam) * z("score") + lam * z("q") + bonus)
    cap = F.col("score") * 3.0
    capped = F.when((F.col("score") > 0) & (F.col("blended") > cap), cap + (F.col("blended") - cap) * 0.3).otherwise(F.col("blended"))
    return x.withColumn("reranked", F.when(t > 0, capped).otherwise(F.col("score")))


def percentile_90(degrees: DataFrame) -> DataFrame:
    """(p90, max_degree): the value at place int(0.9 * n) of the degrees in order, from their histogram."""
    hist = degrees.groupBy("degree").agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.orderBy("degree"))  # a row per distinct degree
    total = F.sum("n").over(Window.partitionBy())
    at = F.floor(F.col("total") * 0.9) + 1
    return hist.withColumns({"run": run, "total": total}).agg(F.min(F.when(F.col("run") >= at, F.col("degree"))).alias("p90"), F.max("degree").alias("max_degree"))


def dampen(x: DataFrame, tops: DataFrame | None = None) -> DataFrame:
    """Gravity, hub, resolution and intent factors. Needs score, bm25, spreading, degree, p90, max_degree, type, and what
    :mod:`.scoring` gives: met, n_terms (query terms), want (the query's fact type) and settled. ``tops`` (query_id, _top) has the best score of each query if it is known."""
    x = _per_query(x, F.max("score").alias("_top")) if tops is None else attach(x, tops, "query_id")
    top = F.col("_top")
    x = x.withColumn("g", F.when((top > 0) & (F.col("score") > 0.3 * top) & (F.col("n_terms") > 0) & ~F.col("met"), Config.gravity).otherwise(1.0))
    spread = F.greatest(F.col("max_degree") - F.col("p90"), F.lit(1)).cast("double")
    hub = F.when((F.col("degree") > F.col("p90")) & ~((F.col("bm25") > 1.0) | (F.col("spreading") > 0.15)), F.greatest(F.lit(0.2), 1.0 - Config.hub_penalty * (F.col("degree") - F.col("p90")) / spread)).otherwise(1.0)
    x = x.withColumns({"h": hub, "r": F.when(F.col("settled"), Config.resolution).otherwise(1.0), "i": F.when(F.coalesce(F.col("type") == F.col("want"), F.lit(False)), 1.15).otherwise(1.0)})
    return x.withColumn("dampened", F.col("score") * F.col("g") * F.col("h") * F.col("r") * F.col("i")).drop("_top")


def correct_bias(x: DataFrame) -> DataFrame:
    """Inverse-propensity step on (query_id, id, score, access_count), where five facts or more have been accessed."""
    n = F.coalesce("access_count", F.lit(0))
    x = _per_query(x, F.max(n).alias("_most"), F.sum((n > 0).cast("int")).alias("_used"))
    p = n / F.greatest(F.col("_most"), F.lit(1))
    enough = F.col("_used") >= 5
    step = F.when(p > 0.8, -0.02).otherwise(0.05 / F.greatest(p, F.lit(0.1)))
    return x.withColumn("corrected", F.when(enough, F.col("score") + step).otherwise(F.col("score")))


def pool(x: DataFrame, k: int = 8) -> DataFrame:
    """The best max(k, 12) rows of each query. Each task passes on no more than that of a query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_seq")
    return x.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= max(k, 12)).drop("_rn")


def diversify(x: DataFrame, k: int = 8, penalty: float = 0.35) -> DataFrame:
    """Greedy diversity over the :func:`pool` of each query; needs embedding and tokens. The pool is bounded, so a query is one small group."""
    top = pool(x, k).select("query_id", "id", "row_seq", "score", "embedding", "tokens")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["score", "row_seq"], ascending=[False, True]).reset_index(drop=True)
        v = np.array([np.asarray(e, np.float64) for e in g.embedding])
        length = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, length, out=np.zeros_like(v), where=length > 0)
        words = [set(t) for t in g.tokens]
        left, taken = list(range(len(g))), []
        while left and len(taken) < k:
            def worth(i: int) -> float:
                likes = [max(float(v[i] @ v[j]), len(words[i] & words[j]) / len(words[i] | words[j]) if words[i] | words[j] else 0.0) for j in taken]
                return g.score[i] - penalty * max(likes, default=0.0)

            best = max(left, key=lambda i: (worth(i), -i))
            taken.append(best)
            left.remove(best)
        out = g.loc[sorted(taken), ["query_id", "id", "score"]].reset_index(drop=True)
        out["rank"] = np.arange(1, len(out) + 1)
        return out

    kind = dict(x.dtypes)
    return top.groupBy("query_id").applyInPandas(pick, f"query_id {kind['query_id']}, id {kind['id']}, score double, rank long")


def reward_ema(signals: DataFrame, chunk: int = 10_000) -> DataFrame:
    """(id, q, n): learned utility after all (id, seq, signal, n_retrieved), in order of seq, from 0.5 and held in [0, 1].

    A step is q -> clamp(0.9 q + 0.1 s). Such clamped lines compose to one clamped line, so the signals of an id fold in chunks of ``chunk``
    numbers of seq first, and the chunks after; an id with very many signals never meets in one task.
    """
    s = F.col("signal") / F.sqrt(F.greatest(F.coalesce("n_retrieved", F.lit(1)).cast("double"), F.lit(1.0)))
    x = signals.select("id", "seq", F.floor(F.col("seq") / chunk).alias("part"), s.alias("s"))
    steps = x.groupBy("id", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "s"))).alias("steps"))
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def clamp(v: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))

    def then(acc: Column, r: Column) -> Column:
        move = lambda v: 0.9 * v + 0.1 * r["s"]
        return F.struct((0.9 * acc["a"]).alias("a"), move(acc["b"]).alias("b"), clamp(move(acc["lo"])).alias("lo"), clamp(move(acc["hi"])).alias("hi"))

    lines = steps.select("id", "part", F.aggregate("steps", start, then).alias("f"), F.size("steps").cast("long").alias("n"))
    per = lines.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "f"))).alias("parts"), F.sum("n").alias("n"))
    q = F.aggregate("parts", F.lit(0.5), lambda acc, r: F.greatest(r["f"]["lo"], F.least(r["f"]["hi"], r["f"]["a"] * acc + r["f"]["b"])))
    return per.select("id", q.alias("q"), "n")


def session_rewards(events: DataFrame, window: float = 300.0) -> DataFrame:
    """Rewards of (session, seen_at, row_seq, kind, ids): +0.4 for an id recalled before, +0.5 for ids of the last recall at each store within the window."""
    w = Window.partitionBy("session").orderBy("seen_at", "row_seq")
    x = events.withColumn("last_at", F.last(F.when(F.col("kind") == "recall", F.col("seen_at")), ignorenulls=True).over(w))
    x = x.withColumn("last_ids", F.last(F.when(F.col("kind") == "recall", F.col("ids")), ignorenulls=True).over(w))
    seen = x.where("kind = 'recall'").select("session", "seen_at", "row_seq", F.explode("ids").alias("id"))
    again = seen.withColumn("n", F.row_number().over(Window.partitionBy("session", "id").orderBy("seen_at", "row_seq"))).where("n > 1").select("id", F.lit(0.4).alias("reward"))
    stored = x.where((F.col("kind") == "store") & (F.col("seen_at") - F.col("last_at") <= window)).select(F.explode("last_ids").alias("id"), F.lit(0.5).alias("reward"))
    return again.union(stored).groupBy("id").agg(F.sum("reward").alias("reward"), F.count("*").alias("n"))
