"""Queries over the link operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Config
from ..functions import patterns as P
from ..functions import text as T
from ..operators import graph as G
from . import sql as S
from .ranking_queries import _LINKS, _links
from .views import duck_view, spark_view, table


def _tokens(spark, d):
    return spark_view(spark, d, "rule_facts").select("id", F.col("id").alias("row_seq"), T.link_tokens(F.col("content")).alias("tokens"))


def keyword_links(spark, d):
    return G.keyword_links(_tokens(spark, d)).select("source_id", "target_id", F.round("strength", 6).alias("strength"))


def bibliographic(spark, d):
    """Coupling of the benchmark's passages by words of four letters or more."""
    x = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("item_id").alias("row_seq"), F.filter(T.link_tokens(F.col("text")), lambda t: F.length(t) > 3).alias("tokens"))
    return G.coupling_links(x).select("source_id", "target_id", F.round("strength", 6).alias("strength"))


def bibliographic_facts(spark, d):
    """Coupling of all facts by words of four letters or more."""
    x = _tokens(spark, d).withColumn("tokens", F.filter("tokens", lambda t: F.length(t) > 3))
    return G.coupling_links(x).select("source_id", "target_id", F.round("strength", 6).alias("strength"))


def temporal_links(spark, d):
    x = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("row_seq"), F.col("event_type").alias("scope_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("created_at"))
    return G.temporal_links(x).select("source_id", "target_id", F.round("strength", 6).alias("strength"))


def semantic_links(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return G.semantic_links(v, "label", 0.2).select("source_id", "target_id", F.round("strength", 5).alias("strength"))


def near_dup(spark, d):
    """Turns whose words overlap by 0.8 or more."""
    x = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), T.words(F.lower("text")).alias("tokens"))
    return G.similar_sets(x, 0.8).select("a", "b", F.round("sim", 6).alias("jaccard"))


def near_dup_documents(spark, d):
    """Documents whose words overlap by 0.4 or more. They have no vectors, so there is no gate of vectors before."""
    x = table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.words(F.lower("text")).alias("tokens"))
    return G.similar_sets(x, Config().duplicate_overlap).select("a", "b", F.round("sim", 6).alias("jaccard"))


def npmi(spark, d):
    counts = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("id")).distinct().groupBy("id").agg(F.count("*").alias("n"))
    return G.link_npmi(_links(spark, d), counts).select("source_id", "target_id", F.round("npmi", 5).alias("npmi"))


def hebbian_update(spark, d):
    """Parts of one order are recalled together, best five by line number; parts met twice or more were linked before."""
    x = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("line"))
    results = x.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), F.col("line").alias("place"), (1.0 / (1 + F.col("line"))).alias("activation"))
    old = _links(spark, d).where("co >= 2").select("source_id", "target_id", "strength", "co")
    return G.hebbian(results, old).groupBy("source_id", "target_id").agg(F.round(F.max("strength") + 1e-9, 6).alias("strength"), F.max("co").alias("co"))


def homeostasis(spark, d):
    x = _links(spark, d).select("source_id", "target_id", (F.lit(0.4) + (F.col("source_id") % 7) * 0.1).alias("strength"))
    return G.homeostasis(x).select("source_id", "target_id", F.round(F.col("strength") + 1e-9, 6).alias("strength"))


def link_upsert(spark, d):
    x = _links(spark, d)
    names = ["source_id", "target_id", "strength", "last_updated"]
    old, new = x.where("co >= 2").select(*names), x.select(*names).withColumn("strength", F.col("strength") + 0.1)
    return G.upsert(old, new).select("source_id", "target_id", F.round("strength", 6).alias("strength"), "last_updated")


def link_decay(spark, d):
    x = _links(spark, d).select("source_id", "target_id", (F.col("strength") / 20).alias("strength"))
    return G.decay(x).select("source_id", "target_id", F.round("strength", 6).alias("strength"))


def unlinked(spark, d):
    x = _links(spark, d)
    return G.without_linked(x.select("source_id", "target_id"), x.where("co >= 2").select("source_id", "target_id"))


def ppr_explore(spark, d):
    links = _links(spark, d).select("source_id", "target_id", "strength")
    seeds = spark.range(5).select((F.col("id") * 7).alias("id"), (F.lit(2.0) - F.col("id") * 0.3).alias("seed"))
    return G.explore(links, seeds).select("id", F.round("s", 6).alias("s"))


def articulation_points(spark, d):
    """Over all links."""
    return G.articulation_points(_links(spark, d).select("source_id", "target_id"))


def hub_nodes(spark, d):
    """Facts with more out-links than the 90th percentile."""
    degree = _links(spark, d).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("degree"))
    from ..operators.ranking import percentile_90

    p = F.broadcast(percentile_90(degree.select("degree")))  # one row
    return degree.crossJoin(p).where("degree > p90").select("id", "degree")


QUERIES = {f.__name__: f for f in (keyword_links, bibliographic, bibliographic_facts, temporal_links, semantic_links, near_dup, near_dup_documents, npmi, hebbian_update, homeostasis, link_upsert, link_decay, unlinked, ppr_explore, articulation_points, hub_nodes)}

_TOKENS = f"SELECT id, list_distinct(list_filter({S.words('lower(content)')}, lambda w: length(w) > 1 AND w NOT IN {S.strs(P.LINK_STOP_WORDS)})) AS toks FROM {duck_view('rule_facts')}"


def _overlap(rel: str, extra: str = "true") -> str:
    return f"(WITH t AS ({rel}), l AS (SELECT id, len(toks) AS n, unnest(toks) AS token FROM t) SELECT a.id AS a, b.id AS b, count(*) AS shared, min(a.n) AS n_a, min(b.n) AS n_b FROM l a JOIN l b ON a.token = b.token AND b.id < a.id AND {extra} GROUP BY a.id, b.id)"


_PASSAGES = f"SELECT item_id AS id, list_distinct(list_filter({S.words('lower(text)')}, lambda w: length(w) > 3 AND w NOT IN {S.strs(P.LINK_STOP_WORDS)})) AS toks FROM benchmark"
_FACT_WORDS = f"SELECT id, list_filter(toks, lambda w: length(w) > 3) AS toks FROM ({_TOKENS})"
_DOCUMENTS = f"SELECT doc_id AS id, list_distinct({S.words('lower(text)')}) AS toks FROM documents"
_J = "shared / (n_a + n_b - shared)"
_EVENTS = "SELECT event_id AS id, event_type AS scope_id, epoch_us(ts) / 1e6 AS created_at FROM events"
_BACK = "(SELECT source_id, target_id, strength, last_updated FROM {0} UNION ALL SELECT target_id, source_id, strength, last_updated FROM {0})"


def _ppr(rounds: int = 20) -> str:
    head = f"""l AS (SELECT source_id, target_id, strength FROM {_LINKS}),
        w0 AS (SELECT source_id, target_id, max(strength) AS w FROM (SELECT * FROM l UNION ALL SELECT target_id, source_id, strength FROM l) GROUP BY ALL),
        w AS MATERIALIZED (SELECT source_id AS v, target_id AS u, w / sum(w) OVER (PARTITION BY source_id) AS w FROM w0), seeds AS (SELECT r * 7 AS id, greatest(2.0 - r * 0.3, 0.01)::DOUBLE AS m FROM range(5) x(r)),
        p AS MATERIALIZED (SELECT id, coalesce(m, 0.01) / (SELECT sum(m) FROM seeds) AS p FROM (SELECT DISTINCT v AS id FROM w UNION SELECT id FROM seeds) LEFT JOIN seeds USING (id)), s0 AS (SELECT id, 0.0::DOUBLE AS s FROM p)"""
    steps = ", ".join(f"s{i} AS MATERIALIZED (SELECT p.id, 0.45 * p + 0.55 * coalesce(x.y, 0) AS s FROM p LEFT JOIN (SELECT v, sum(w * s) AS y FROM w JOIN s{i - 1} ON s{i - 1}.id = u GROUP BY v) x ON x.v = p.id)" for i in range(1, rounds + 1))
    return f"WITH {head}, {steps} SELECT id, round(s, 6) AS s FROM s{rounds}"


ORACLES = {
    "keyword_links": f"SELECT a AS source_id, b AS target_id, round(0.3 * {_J}, 6) AS strength FROM {_overlap(_TOKENS, 'a.id - b.id <= 50')} WHERE shared >= 3 AND {_J} >= 0.15",
    "bibliographic": f"SELECT a AS source_id, b AS target_id, round(0.5 * shared / sqrt(n_a::DOUBLE * n_b), 6) AS strength FROM {_overlap(_PASSAGES)} WHERE shared / sqrt(n_a::DOUBLE * n_b) > 0.3",
    "bibliographic_facts": f"SELECT a AS source_id, b AS target_id, round(0.5 * shared / sqrt(n_a::DOUBLE * n_b), 6) AS strength FROM {_overlap(_FACT_WORDS)} WHERE shared / sqrt(n_a::DOUBLE * n_b) > 0.3",
    "temporal_links": " UNION ALL ".join(f"SELECT id AS source_id, target_id, round(x, 6) AS strength FROM (SELECT id, lag(id, {i + 1}) OVER w AS target_id, 0.28 * pow(0.85, {i}) * exp(-(created_at - lag(created_at, {i + 1}) OVER w) / 120.0) AS x FROM ({_EVENTS}) WINDOW w AS (PARTITION BY scope_id ORDER BY created_at, id)) WHERE target_id IS NOT NULL AND x > 0.02" for i in range(4)),
    "semantic_links": f"SELECT source_id, target_id, round(0.5 * sim, 5) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY sim DESC, target_id) AS rn FROM (SELECT a.vec_id AS source_id, b.vec_id AS target_id, {S.cosine('a.embedding', 'b.embedding')} AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE sim >= 0.2) WHERE rn <= 5",
    "near_dup": f"""WITH t AS MATERIALIZED (SELECT conv_id * 1000 + turn AS id, list_distinct({S.words('lower(text)')}) AS s FROM conversations), x AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) AS c, len(a.s) AS m, len(b.s) AS n FROM t a JOIN t b ON a.id > b.id WHERE len(a.s) > 0 AND len(b.s) > 0)
        SELECT a, b, round(c / (m + n - c), 6) AS jaccard FROM x WHERE c / (m + n - c) >= 0.8""",
    "near_dup_documents": f"SELECT a, b, round({_J}, 6) AS jaccard FROM {_overlap(_DOCUMENTS)} WHERE {_J} >= 0.4",
    "npmi": f"""WITH c AS (SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1), x AS (SELECT source_id, target_id, co / t AS ab, a.n / t AS pa, b.n / t AS pb FROM {_LINKS} l JOIN c a ON a.id = source_id JOIN c b ON b.id = target_id CROSS JOIN (SELECT sum(n)::DOUBLE AS t FROM c))
        SELECT source_id, target_id, round(CASE WHEN ab < 1 THEN greatest(-1.0, least(1.0, ln(ab / (pa * pb)) / -ln(ab))) ELSE 0.0 END, 5) AS npmi FROM x""",
    "hebbian_update": f"""WITH r AS (SELECT l_orderkey AS qid, l_partkey AS id, min(l_linenumber) AS place FROM lineitem GROUP BY ALL), p AS (SELECT a.id AS source_id, b.id AS target_id, sum((1.0::DOUBLE / (1 + a.place)) * (1.0::DOUBLE / (1 + b.place))) AS ab, count(*) AS times FROM r a JOIN r b ON a.qid = b.qid AND a.place < b.place WHERE a.place <= 5 AND b.place <= 5 GROUP BY ALL),
        o AS (SELECT source_id, target_id, strength, co FROM {_LINKS} WHERE co >= 2),
        u AS (SELECT o.source_id, o.target_id, CASE WHEN ab IS NULL THEN strength ELSE least(1.0, strength + 0.12 * ab * (pow(least(co + times, 100), 0.75) / pow(100.0, 0.75)) * (1 + 0.2 * ln(1.0 + co + times))) END AS strength, co + coalesce(times, 0) AS co FROM o LEFT JOIN p USING (source_id, target_id)),
        f AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE (o.source_id = p.source_id AND o.target_id = p.target_id) OR (o.source_id = p.target_id AND o.target_id = p.source_id))),
        a AS (SELECT * FROM u UNION ALL SELECT source_id, target_id, least(0.12 * ab, 0.3), times FROM f UNION ALL SELECT target_id, source_id, least(0.12 * ab, 0.3), times FROM f)
        SELECT source_id, target_id, round(max(strength) + 1e-9, 6) AS strength, CAST(max(co) AS BIGINT) AS co FROM a GROUP BY ALL""",
    "homeostasis": f"""WITH l AS (SELECT source_id, target_id, 0.4::DOUBLE + (source_id % 7) * 0.1::DOUBLE AS strength FROM {_LINKS}), m AS (SELECT id, 0.7 / avg(strength) AS f FROM (SELECT source_id AS id, strength FROM l UNION ALL SELECT target_id, strength FROM l) GROUP BY id HAVING avg(strength) > 0.7)
        SELECT source_id, target_id, round(strength * coalesce(a.f, 1) * coalesce(b.f, 1) + 1e-9, 6) AS strength FROM l LEFT JOIN m a ON a.id = source_id LEFT JOIN m b ON b.id = target_id""",
    "link_upsert": f"""WITH x AS (SELECT * FROM {_LINKS}), n AS (SELECT source_id, target_id, strength + 0.1::DOUBLE AS strength, last_updated FROM x)
        SELECT source_id, target_id, round(max(strength), 6) AS strength, max(last_updated) AS last_updated FROM (SELECT source_id, target_id, strength, last_updated FROM x WHERE co >= 2 UNION ALL SELECT * FROM {_BACK.format('n')}) GROUP BY ALL""",
    "link_decay": f"SELECT source_id, target_id, round(strength / 20 * 0.95, 6) AS strength FROM {_LINKS} WHERE strength / 20 * 0.95 >= 0.01",
    "unlinked": f"SELECT source_id, target_id FROM {_LINKS} WHERE co < 2",
    "ppr_explore": _ppr(),
    "hub_nodes": f"WITH g AS (SELECT source_id AS id, count(*) AS degree FROM {_LINKS} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY degree) AS rn, count(*) OVER () AS n FROM g) SELECT id, degree FROM r WHERE degree > (SELECT degree FROM r WHERE rn = CAST(floor(n * 0.9) AS BIGINT) + 1)",
}
