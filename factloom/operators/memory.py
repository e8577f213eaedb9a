"""Writing and recalling as compositions. Both take frames and give frames; the caller decides what becomes the next snapshot."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..frames import materialize
from ..functions import text as T
from . import graph as G
from . import lifecycle as L
from . import ranking as R
from . import recalled as Q
from . import scoring as C
from .nearest import nearest, similarities


def encode(raw: DataFrame, now: float) -> DataFrame:
    """Facts of (row_seq, raw, scope_id): notation, category, importance, hash; new facts are active and unpinned."""
    n = T.notation(F.col("raw"))
    x = raw.select("row_seq", F.col("scope_id").cast("string").alias("scope_id"), n["type"].alias("type"), n["target"].alias("target"), n["content"].alias("content"), n["rate"].alias("metabolic_rate"))
    cat = T.category(F.col("content"))
    x = x.withColumn("category", cat).withColumn("importance", T.importance(F.col("content"), F.col("category"))).withColumn("source_hash", T.content_hash(F.col("content")))
    key = F.concat_ws("\x1f", F.col("row_seq").cast("string"), "content")
    return x.withColumns({"id": F.sha2(key, 256), "status": F.lit("active"), "access_count": F.lit(0), "layer": F.lit("working"), "pinned": F.lit(False), "created_at": F.lit(float(now)), "last_accessed": F.lit(float(now))})


def _kinds(x: DataFrame) -> DataFrame:
    """Facts of one text, vector and scope as one: the first of them in scan order. Copies are judged alike, so that pairs of copies are never made."""
    key = [c for c in ("content", "embedding", "scope_id") if c in x.columns]
    first = F.min(F.struct(*[c for c in ("row_seq", "id_long") if c in x.columns]))
    return materialize(x.groupBy(*key).agg(first.alias("f")).select(*key, "f.*"), "kinds")


def contradicted(new: DataFrame, old: DataFrame, threshold: float = Config.contradiction) -> DataFrame:
    """(id): for each new fact the first older active fact that it takes back. Both have (id_long, row_seq, content, embedding); where both
    have scope_id as well, a new fact with a scope meets its scope only. Every pair that can score, by its vectors, is scored."""
    floor = 0.55 - 1e-9 if threshold > 0 else None  # nothing below scores more than 0
    scoped = "scope_id" in new.columns and "scope_id" in old.columns
    new, old = _kinds(new), _kinds(old)
    names = [F.col("id_long").alias("id"), "embedding", *(["scope_id"] if scoped else [])]
    n, o = new.select(*names), old.select(*names)
    if scoped:
        bound = F.coalesce(F.col("scope_id").cast("string"), F.lit("")) != ""
        near = similarities(o, n.where(bound), block="scope_id", threshold=floor).union(similarities(o, n.where(~bound), threshold=floor))
    else:
        near = similarities(o, n, threshold=floor)
    # parts of a text are worked out once, not once for each pair
    a = materialize(new.select(F.col("id_long").alias("query_id"), T.contradiction_parts(F.col("content")).alias("new_parts")), "parts")
    b = materialize(old.select(F.col("id_long").alias("id"), T.contradiction_parts(F.col("content")).alias("parts"), "row_seq"), "parts")
    x = near.join(a, "query_id").join(b, "id").withColumn("score", T.contradiction_score(F.col("new_parts"), F.col("parts"), F.col("sim"))).where(F.col("score") >= threshold)
    first = x.groupBy("query_id").agg(F.min(F.struct("row_seq", "id")).alias("f"))
    return first.select(F.col("f.id").alias("id")).distinct()


def store(raw: DataFrame, facts: DataFrame, now: float, config: Config = Config()) -> DataFrame:
    """The facts after a batch is written, row by row in order of row_seq: encoded, exact copies of active facts dropped, older facts of a key superseded.

    Signs of done and obsolete facts are read, but such facts are written as values, as the store has no notation for them. Near duplicates, contradictions
    and links need vectors and are steps of their own: :func:`near_copies`, :func:`contradicted`, and the link operators; :func:`first_access` has the
    accesses that writing makes.
    """
    fresh = encode(raw, now)
    odd = F.col("type").isin("done", "obs")
    fresh = fresh.withColumns({"metabolic_rate": F.when(odd, 1.0).otherwise(F.col("metabolic_rate")), "type": F.when(odd, "V").otherwise(F.col("type"))})
    fresh = fresh.select(*[c for c in facts.columns if c in fresh.columns])
    live = F.col("status") == "active"
    hashed = facts.withColumn("source_hash", T.content_hash(F.col("content")))
    out = L.write(fresh, hashed.where(live)).where("inserted")
    out = out.withColumn("status", F.when(F.col("replaced"), "superseded").otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("replaced"), float(now)).otherwise(F.col("updated_at")))
    return facts.where(~live | F.col("status").isNull()).unionByName(out.select(*facts.columns))


def first_access(before: DataFrame, after: DataFrame, now: float) -> DataFrame:
    """(fact_id, seen_at): writing a fact is its first access."""
    return after.join(before.select("id"), "id", "left_anti").select(F.col("id").alias("fact_id"), F.lit(float(now)).alias("seen_at"))


def near_copies(new: DataFrame, old: DataFrame, config: Config = Config()) -> DataFrame:
    """(id) of new facts that say what an old one says: vectors and words both overlap. Both have (id_long, content, embedding)."""
    all_new = new.select("id_long", "content", "embedding")
    new, old = _kinds(all_new), _kinds(old.select("id_long", "content", "embedding"))
    near = similarities(old.select(F.col("id_long").alias("id"), "embedding"), new.select(F.col("id_long").alias("id"), "embedding"), threshold=config.duplicate_similarity)
    a = new.select(F.col("id_long").alias("query_id"), F.array_distinct(T.words(F.lower("content"))).alias("wa"))
    b = old.select(F.col("id_long").alias("id"), F.array_distinct(T.words(F.lower("content"))).alias("wb"))
    x = near.join(a, "query_id").join(b, "id").where(T.overlap(F.col("wa"), F.col("wb")) >= config.duplicate_overlap)
    said = new.join(x.select(F.col("query_id").alias("id_long")).distinct(), "id_long").select(F.col("content").alias("c"), F.col("embedding").alias("e"))
    return all_new.join(said, F.col("content").eqNullSafe(F.col("c")) & F.col("embedding").eqNullSafe(F.col("e")), "left_semi").select(F.col("id_long").alias("id")).distinct()


def recall(queries: DataFrame, facts: DataFrame, access: DataFrame, links: DataFrame, now: float, config: Config = Config(), learned: DataFrame | None = None, degree: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, uses, pairs): the best facts of each query and what a recall would write.

    Scoring, keyword fusion where it is wanted, reranking by learned utility, dampening, bias correction, diversity. ``queries`` has (query_id,
    query, query_scope, embedding), ``facts`` the columns of a snapshot with long ids and vectors, ``learned`` (id, q, n_retrieved, updated_at);
    without learned values, reranking changes nothing. ``links`` may be those of the facts alone, in both directions, if ``degree`` has (id, degree) of all
    nodes; a hub is one among all of them. Uses are access rows of the results, pairs the recalled-together facts for
    :func:`graph.hebbian`. Nothing is written here.
    """
    live = facts.where("status in ('active', 'cold')")
    base = R.base_level(access.join(facts.select(F.col("id").alias("fact_id"), "metabolic_rate"), "fact_id"), now, F.col("metabolic_rate")).select(F.col("fact_id").alias("id"), "base")
    degree = materialize(links.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("degree")) if degree is None else degree, "degree")
    own = C.fact_features(live).join(base, "id", "left").join(R.revival(links, now), "id", "left").join(C.spread(links, live.select("id", "embedding")), "id", "left").join(degree, "id", "left")
    never = F.ln(F.pow(F.greatest(F.lit(now) - F.col("created_at"), F.lit(0.001)), -config.decay * F.col("metabolic_rate")))
    own = own.withColumns({"base": F.coalesce("base", never), "scope": F.col("scope_id"), "degree": F.coalesce("degree", F.lit(0))})
    if learned is None:
        updates = 0
        own = own.withColumns({"q": F.lit(None).cast("double"), "n_retrieved": F.lit(None).cast("long")})
    else:
        updates = learned.agg(F.coalesce(F.sum("n_retrieved"), F.lit(0))).first()[0]
        own = own.join(learned.select("id", R.decayed_q(F.col("q"), F.col("updated_at"), now).alias("q"), F.col("n_retrieved").cast("long").alias("n_retrieved")), "id", "left")
    asked = C.query_features(queries).withColumn("n_terms", F.size("query_terms"))
    kw = R.bm25(facts.select("id", F.concat_ws(" ", "content", "target").alias("text"), F.col("status").isin("active", "cold").alias("allowed")), queries.select("query_id", "query"), config.keyword_limit)
    hubs = R.percentile_90(degree.select("degree")).first()
    p90, most, updates, k = int(hubs["p90"] or 0), int(hubs["max_degree"] or 0), int(updates), max(config.top_k, 12)

    def stages(cell: dict, fact: dict, query: dict) -> tuple[np.ndarray, np.ndarray]:
        seq, score, bm25 = fact["row_seq"], cell["score"], cell["bm25"]
        if Q.fusion_wanted(score, bm25, seq, bool(fact["typed"].any())):
            score = Q.strong_match(Q.fuse(score, bm25, seq), bm25, seq, fact["id"])
        score = Q.rerank(score, fact["q"], fact["n_retrieved"], updates)
        score = Q.correct_bias(Q.dampen(score, cell, fact, query, p90, most), fact["access_count"])
        best = Q.best_first(score)[:k]
        return best, score[best]

    own = own.withColumns({"q": F.coalesce("q", F.lit(0.5)), "typed": F.coalesce(F.col("type") != "V", F.lit(False)), "settled": F.coalesce("settled", F.lit(False))})
    x = Q.recalled(own, asked, kw, stages, ("access_count", "type", "typed", "settled", "degree", "q", "n_retrieved"), ("n_terms", "want"), dampened=True)
    results = materialize(R.diversify(x.join(live.select("id", "embedding", T.terms(F.col("content")).alias("tokens")), "id"), config.top_k, config.diversity_penalty), "results")
    uses = results.groupBy("id").agg(F.count("*").alias("n")).withColumn("seen_at", F.lit(float(now)))
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    pairs = results.withColumn("place", F.row_number().over(top)).select("query_id", "id", "place", F.col("score").alias("activation"))
    return results, uses, pairs


def consolidate(facts: DataFrame, access: DataFrame, links: DataFrame, scopes: DataFrame, now: float, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(facts, links) after a cycle: facts that hold the graph together pinned, layers moved, stale facts dropped, links decayed and their mutual information
    worked out anew, pressure relieved. ``links`` has co, the times its ends were recalled together; ids are whole numbers."""
    kept = L.consolidate(facts, access, now, G.articulation_points(links))
    left = G.decay(links, config.link_decay)
    used = access.groupBy(F.col("fact_id").alias("id")).agg(F.count("*").alias("n"))
    shared = G.link_npmi(left.select("source_id", "target_id", "co"), used)
    left = left.drop("npmi").join(shared, ["source_id", "target_id"], "left").withColumn("npmi", F.coalesce("npmi", F.lit(0.0)))
    return L.gauge(kept, scopes, now, config.gauge_chars), left


def access_by_text(facts: DataFrame, asked: DataFrame, floor: float = 0.5) -> DataFrame:
    """(ask, id): the fact that each text of (ask, needle, embedding) brings to mind: the first active one that holds it, whatever its case; where none does,
    the active one whose vector is nearest, if its cosine exceeds the ``floor``."""
    live = facts.where("status = 'active'")
    held = live.select("id", "row_seq", F.lower("content").alias("_c")).join(asked.select("ask", F.lower("needle").alias("_n")), F.contains("_c", F.col("_n")))
    first = materialize(held.groupBy("ask").agg(F.min(F.struct("row_seq", "id")).alias("f")).select("ask", F.col("f.id").alias("id")), "held")
    rest = asked.join(first, "ask", "left_anti")
    near = nearest(live.where("embedding is not null").select("id", "embedding"), rest.select(F.col("ask").alias("id"), "embedding"), 1)
    return first.union(near.where(F.col("sim") > floor).select(F.col("query_id").alias("ask"), "id"))


def explore(results: DataFrame, links: DataFrame, facts: DataFrame, top_k: int = 20, config: Config = Config()) -> DataFrame:
    """(query_id, id, score, discovered): recalled facts and those that links lead to from them, the best ``top_k`` of each query.

    ``results`` has (query_id, id, score). A recalled fact gains ``exploration_boost`` times its share of the walk; of the others those with a share over 0.01 come in,
    best first, until there are ``top_k``, with the boost times their share as score, if they are active or cold. A query with fewer than two recalled
    facts, or a graph of fewer than three nodes, gives the recalled facts alone. Each query is a walk of its own,
    one after another: this is for a handful of queries.
    """
    boost = config.exploration_boost
    nodes = links.select("source_id").union(links.select("target_id")).distinct().limit(3).count()
    seen = materialize(results.select("query_id", "id", "score"), "recalled")
    plain = seen.withColumn("discovered", F.lit(False))
    walks = [r["query_id"] for r in seen.groupBy("query_id").count().where("count >= 2").select("query_id").collect()] if nodes >= 3 else []
    live = facts.where("status in ('active', 'cold')").select("id")
    out = plain.where(~F.col("query_id").isin(walks)) if walks else plain
    for q in walks:
        own = seen.where(F.col("query_id") == q)
        s = G.explore(links, own.select("id", F.col("score").alias("seed")), config.exploration_rounds, config.exploration_alpha, "row_seq" if "row_seq" in links.columns else None)
        lifted = own.join(s, "id", "left").select("query_id", "id", (F.col("score") + boost * F.coalesce("s", F.lit(0.0))).alias("score"), F.lit(False).alias("discovered"))
        room = max(0, top_k - own.count())
        far = s.join(own.select("id"), "id", "left_anti").where("s > 0.01").orderBy(F.desc("s"), "id").limit(room)
        far = far.join(live, "id", "left_semi").select(F.lit(q).alias("query_id"), "id", (boost * F.col("s")).alias("score"), F.lit(True).alias("discovered"))
        out = out.unionByName(lifted.unionByName(far))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= top_k).drop("_rn")
