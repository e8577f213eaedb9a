"""Queries over the life of facts, promotion, import and export, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..frames import materialize
from ..functions import text as T
from ..operators import bandit as B
from ..operators import embedding as E
from ..operators import export as X
from ..operators import lifecycle as L
from ..operators import memory
from ..operators import promotion as PR
from . import sql as S
from .text_queries import _CATEGORY, _IMPORTANCE, _named
from .views import NOW, duck_view, spark_view, table
from ..functions import patterns as P
from ..schemas import STATE


def _facts(spark, d):
    return spark_view(spark, d, "facts")


def exact_dedup(spark, d):
    x = _facts(spark, d)
    return L.new_facts(x, x.where("layer = 'core' and type = 'D'")).select("id", "source_hash")


def store_path(spark, d):
    """All typed texts written as one batch into an empty store."""
    raw = spark_view(spark, d, "typed_facts").select(F.col("id").alias("row_seq"), "raw", F.col("scope").alias("scope_id"))
    out = memory.store(raw, spark.createDataFrame([], STATE["facts"]), NOW)
    return out.select("row_seq", "type", "target", "content", "status", "category", F.round("importance", 6).alias("importance"), "source_hash")


def store_vectors(spark, d):
    """The later half of all facts written over the earlier one: near copies are not stored, the others take back older facts of their brand.

    Vectors are the weights of words, dealt to 128 places by a hash.
    """
    x = spark_view(spark, d, "rule_facts").select("id", "content", F.col("target").alias("scope_id"))
    at = F.pmod(F.xxhash64("token"), F.lit(128)).cast("int")
    w = E.tfidf(x.select("id", F.col("content").alias("text"))).groupBy("id", at.alias("at")).agg(F.round(F.sum("weight"), 6).alias("w"))
    m = w.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("m"))
    v = m.select("id", F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float")).alias("embedding"))
    facts = materialize(x.join(v, "id").withColumns({"id_long": F.col("id"), "row_seq": F.col("id")}), "facts")
    middle = F.broadcast(x.agg((F.max("id") / 2).alias("middle")))  # one row
    facts = facts.crossJoin(middle)
    old, new = facts.where("id <= middle").drop("middle"), facts.where("id > middle").drop("middle")
    copies = materialize(memory.near_copies(new, old), "copies")
    taken = memory.contradicted(new.join(copies, "id", "left_anti"), old)
    return copies.withColumn("what", F.lit("copy")).union(taken.withColumn("what", F.lit("superseded")))


def supersession(spark, d):
    return L.supersede(_facts(spark, d)).select("id", "status")


def gauge_cascade(spark, d):
    return L.gauge(_facts(spark, d), spark_view(spark, d, "scopes"), NOW).select("id", "status")


def consolidate(spark, d):
    access = spark_view(spark, d, "access").select(F.col("fact_id"), "seen_at")
    bridges = _facts(spark, d).where("scope_id = 7").select("id")
    return L.consolidate(_facts(spark, d), access, NOW + 3e6, bridges).select("id", "layer", "pinned")


def _duplicates(spark, d):
    """Facts with the text, type and target of an earlier one, and that one."""
    w = Window.partitionBy("content", "type", "target")
    return _facts(spark, d).select(F.col("id").alias("dup"), F.min("id").over(w).alias("into")).where("dup <> into")


def merge_dups(spark, d):
    x = spark_view(spark, d, "pairs").select("source_id", "target_id", (F.col("co") * 0.1).alias("strength"))
    mapping = _duplicates(spark, d)
    return L.merge_links(x, mapping).select("source_id", "target_id", F.round("strength", 6).alias("strength"))


def merged_facts(spark, d):
    mapping = _duplicates(spark, d)
    return L.merge_facts(_facts(spark, d), mapping).select("id", "status", "superseded_by")


def merged_access(spark, d):
    """Accesses after duplicates are merged: those of a duplicate count for the fact it is merged into."""
    access = spark_view(spark, d, "access").select("fact_id", "seen_at")
    return L.merge_access(access, _duplicates(spark, d)).groupBy("fact_id").agg(F.count("*").alias("n"), F.round(F.max("seen_at"), 3).alias("latest"))


def access_cap(spark, d):
    return L.cap_access(spark_view(spark, d, "access").select("fact_id", "seen_at"), 40).groupBy("fact_id").agg(F.count("*").alias("n"), F.min("seen_at").alias("oldest"))


def access_update(spark, d):
    used = spark_view(spark, d, "access").select(F.col("fact_id").alias("id"), F.lit(1).cast("long").alias("n"), "seen_at")
    return L.touch(_facts(spark, d), used).select("id", "access_count", F.round("last_accessed", 3).alias("last_accessed"))


def system_prompt(spark, d):
    return L.system_prompt(_facts(spark, d), 500)


def stats(spark, d):
    return L.stats(_facts(spark, d))


def hot_facts(spark, d):
    x = _facts(spark, d).where("status = 'active'")
    open_ = spark_view(spark, d, "scopes").where("status = 'active'").select(F.col("id").alias("scope_id"), "label")
    return x.join(open_, "scope_id").select("id", "label")


def scope_scan(spark, d):
    x = _facts(spark, d).where("status in ('active', 'cold')")
    return x.where(L.visible(F.col("scope_id"), 7)).select("id", "scope_id")


def substring_access(spark, d):
    return L.simulate_access(_facts(spark, d), "RED").select("id")


def retag(spark, d):
    x = spark_view(spark, d, "rule_facts").withColumn("target", F.when(F.col("id") % 2 == 0, "general").otherwise(F.col("target")))
    return L.retag(x).select("id", "target")


def scope_create(spark, d):
    labels = table(spark, d, "nation").select("n_name").union(table(spark, d, "region").select("r_name")).toDF("label")
    return L.get_or_create_scopes(spark_view(spark, d, "scopes"), labels)


def _pending(spark, d):
    return spark_view(spark, d, "pending")


def promote_pass(spark, d):
    return PR.promote(_pending(spark, d), NOW, 86400.0 * 2).select("id", "status")


def promotion_metrics(spark, d):
    x = _pending(spark, d)
    return PR.metrics(x, PR.promote(x, NOW, 86400.0 * 2))


def promoted_facts(spark, d):
    return PR.promoted_facts(PR.promote(_pending(spark, d), NOW)).select("id", "content", "type", "target", "metabolic_rate", "importance")


def pending_summary(spark, d):
    return PR.summary(_pending(spark, d))


def pending_list(spark, d):
    return PR.listing(_pending(spark, d), source="observed", status="provisional", limit=30).select("id", "session_id", "content")


def session_expiry(spark, d):
    x = _pending(spark, d).where("status = 'provisional' and source = 'agent_inference'")
    return x.groupBy("session_id").agg(F.max("updated_at").alias("last")).where(F.col("last") < NOW - 86400.0 * 2).select("session_id")


def _interactions(spark, d):
    x = table(spark, d, "conversations")
    ids = F.array((F.col("conv_id") + F.col("turn")) % 40, (F.col("conv_id") * 3) % 40)
    return x.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ix"), F.col("text").alias("query"), F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("s"), (F.col("conv_id") % 3).cast("string"))).alias("scope"), ids.alias("recalled_ids"), (F.col("turn") % 4 == 0).alias("followed_by_store"))


def training_pairs(spark, d):
    facts = _facts(spark, d).withColumn("q_value", (F.col("id") % 10) / 10.0)
    out = X.training_pairs(facts, _interactions(spark, d), 0.3, 1, None)
    return out.select("fact_seq", "ix", "pair_type", "input", "output")


def chat_export(spark, d):
    pairs = table(spark, d, "conversations").where("role = 'user'").select(F.col("text").alias("input"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("output"))
    return X.chat_records(pairs).select(F.to_json("messages").alias("line"))


def import_dedup(spark, d):
    x = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_seq"), F.concat(F.lit("  "), F.col("text"), F.lit("\n")).alias("content"), F.col("role").alias("peer_id"), F.concat(F.lit("conv/"), (F.col("conv_id") % 7).cast("string")).alias("session_id"))
    return X.import_messages(x, "user", True, None)


def tfidf_vectors(spark, d):
    x = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return E.tfidf(x).select("id", "token", F.round("weight", 5).alias("weight"))


def _bandit_rows(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return x.select(F.col("lang").alias("arm"), F.lit(1.0).alias("f0"), (F.least(F.col("n_chars"), F.lit(5000)) / 5000.0).alias("f1"), (F.col("doc_id") % 7 / 7.0).alias("f2"), F.col("quality").cast("double").alias("reward"))


def linucb_stats(spark, d):
    return B.statistics(_bandit_rows(spark, d), ["f0", "f1", "f2"]).select("arm", "i", "j", F.round("a", 5).alias("a"))


def linucb_solve(spark, d):
    return B.solve(B.statistics(_bandit_rows(spark, d), ["f0", "f1", "f2"]), 3)


QUERIES = {f.__name__: f for f in (exact_dedup, store_path, store_vectors, supersession, gauge_cascade, consolidate, merge_dups, merged_facts, merged_access, access_cap, access_update, system_prompt, stats, hot_facts, scope_scan, substring_access, retag, scope_create, promote_pass, promotion_metrics, promoted_facts, pending_summary, pending_list, session_expiry, training_pairs, chat_export, import_dedup, tfidf_vectors, linucb_stats, linucb_solve)}

_F, _P, _A, _RULES = duck_view("facts"), duck_view("pending"), duck_view("access"), duck_view("rule_facts")
_USED = f"(SELECT CAST(coalesce(sum(length(type) + length(target) + length(content) + 4), 0) AS BIGINT) AS used FROM {_F} WHERE status = 'active')"
_PASS = f"""a AS (SELECT *, row_number() OVER (PARTITION BY type, target, session_id, status = 'provisional' ORDER BY updated_at DESC, id DESC) AS rn FROM {_P}),
    b AS (SELECT *, CASE WHEN status = 'provisional' AND rn > 1 THEN 'retracted' ELSE status END AS s1 FROM a),
    c AS (SELECT *, max(CASE WHEN s1 = 'provisional' AND source = 'agent_inference' THEN updated_at END) OVER (PARTITION BY session_id) AS last FROM b),
    d AS (SELECT *, CASE WHEN s1 = 'provisional' AND (source IN ('observed', 'user_stated') OR last < {NOW} - {{ttl}}) THEN 'promoted' ELSE s1 END AS s2 FROM c)"""
_MAP = f"(SELECT * FROM (SELECT id AS dup, min(id) OVER (PARTITION BY content, type, target) AS into_ FROM {_F}) WHERE dup <> into_)"
_IX = "(SELECT conv_id * 1000 + turn AS ix, text AS query, CASE WHEN conv_id % 4 <> 0 THEN 's' || (conv_id % 3) END AS scope, unnest([(conv_id + turn) % 40, (conv_id * 3) % 40]) AS fid, unnest([0, 1]) AS pos, turn % 4 = 0 AS fbs FROM conversations WHERE role = 'user')"
_TOK = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN {S.strs(P.VECTOR_STOP_WORDS)})"
_BR = "(SELECT lang AS arm, [1.0::DOUBLE, least(n_chars, 5000) / 5000.0::DOUBLE, doc_id % 7 / 7.0::DOUBLE] AS f, quality::DOUBLE AS reward FROM documents JOIN labels USING (doc_id))"

_NOTED = S.hit("s", P.NOTATION)
ORACLES = {
    "store_path": f"""WITH RECURSIVE x AS (SELECT id, scope, {S.strip('raw')} AS s FROM {duck_view('typed_facts')}),
        p AS (SELECT id AS row_seq, scope, CASE WHEN {_NOTED} THEN CASE regexp_extract(s, {S.q(P.NOTATION)}, 1) WHEN '✓' THEN 'V' WHEN '~' THEN 'V' ELSE regexp_extract(s, {S.q(P.NOTATION)}, 1) END ELSE 'V' END AS type, CASE WHEN {_NOTED} THEN {S.strip(f"regexp_extract(s, {S.q(P.NOTATION)}, 2)")} ELSE 'general' END AS target, CASE WHEN {_NOTED} THEN {S.strip(f"regexp_extract(s, {S.q(P.NOTATION)}, 3)")} ELSE s END AS content FROM x),
        o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY row_seq) AS rn, target <> 'general' AS keyed, concat_ws(chr(31), type, target, coalesce(scope, '')) AS k FROM p),
        w(rn, held, loose, ins) AS (SELECT CAST(0 AS BIGINT), CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)), CAST([] AS VARCHAR[]), false UNION ALL
            SELECT o.rn, CASE WHEN f.ins AND o.keyed THEN map_concat(w.held, MAP {{o.k: o.content}}) ELSE w.held END, CASE WHEN f.ins AND NOT o.keyed THEN list_append(w.loose, o.content) ELSE w.loose END, f.ins
            FROM w JOIN o ON o.rn = w.rn + 1, LATERAL (SELECT NOT list_contains(map_values(w.held), o.content) AND NOT list_contains(w.loose, o.content) AS ins) f),
        u AS (SELECT o.* FROM o JOIN w USING (rn) WHERE w.ins), c AS (SELECT *, {_CATEGORY} AS category, len({S.words('content')}) AS n_words FROM u)
        SELECT row_seq, type, target, content, CASE WHEN keyed AND row_seq < max(row_seq) OVER (PARTITION BY keyed, k) THEN 'superseded' ELSE 'active' END AS status, category, round(least(greatest(CAST({_IMPORTANCE} AS DOUBLE), 0.1), 1.0), 6) AS importance, left(sha256(content), 16) AS source_hash FROM c""",
    "exact_dedup": f"SELECT id, left(sha256(content), 16) AS source_hash FROM {_F} WHERE content NOT IN (SELECT content FROM {_F} WHERE layer = 'core' AND type = 'D' AND status = 'active') QUALIFY row_number() OVER (PARTITION BY content ORDER BY id) = 1",
    "supersession": f"SELECT id, CASE WHEN status = 'active' AND target <> 'general' AND row_number() OVER (PARTITION BY type, target, scope_id, status ORDER BY created_at DESC, id DESC) > 1 THEN 'superseded' ELSE status END AS status FROM {_F}",
    "gauge_cascade": f"""WITH x AS (SELECT f.*, used / 100.0 AS pct FROM {_F} f CROSS JOIN {_USED}),
        a AS (SELECT *, CASE WHEN status = 'active' AND pct >= 70 AND EXISTS (SELECT 1 FROM x y WHERE y.status = 'active' AND y.type = x.type AND y.target = x.target AND y.scope_id IS NOT DISTINCT FROM x.scope_id AND y.created_at > x.created_at) THEN 'superseded' ELSE status END AS s1 FROM x),
        b AS (SELECT *, CASE WHEN s1 = 'active' AND pct >= 85 AND scope_id IN (SELECT id FROM {duck_view('scopes')} WHERE status IN ('cold', 'closed')) AND {NOW} - last_accessed > 86400 THEN 'archived' ELSE s1 END AS s2 FROM a)
        SELECT id, CASE WHEN pct >= 95 AND id IN (SELECT id FROM b WHERE s2 = 'active' AND NOT pinned ORDER BY last_accessed, id LIMIT 10) THEN 'cold' ELSE s2 END AS status FROM b""",
    "consolidate": f"""WITH t AS (SELECT {NOW} + 3e6 AS now), base AS (SELECT fact_id AS id, ln(greatest(sum(pow(now - seen_at, -0.3)), 1e-10)) AS base FROM {_A}, t WHERE now > seen_at GROUP BY 1),
        x AS (SELECT f.id, status, access_count, last_accessed, pinned OR coalesce(scope_id = 7, false) AS pinned, CASE WHEN layer = 'working' AND access_count >= 3 THEN 'core' ELSE layer END AS l1, base FROM {_F} f LEFT JOIN base USING (id)),
        y AS (SELECT *, CASE WHEN l1 = 'core' AND status = 'active' AND base < -5 THEN 'archive' ELSE l1 END AS layer FROM x) SELECT id, layer, pinned FROM y, t WHERE NOT (layer = 'archive' AND status = 'active' AND access_count < 2 AND now - last_accessed > 86400 * 30)""",
    "merge_dups": f"SELECT coalesce(a.into_, source_id) AS source_id, coalesce(b.into_, target_id) AS target_id, round(max(co * 0.1::DOUBLE), 6) AS strength FROM {duck_view('pairs')} LEFT JOIN {_MAP} a ON a.dup = source_id LEFT JOIN {_MAP} b ON b.dup = target_id WHERE coalesce(a.into_, source_id) <> coalesce(b.into_, target_id) GROUP BY 1, 2",
    "merged_facts": f"SELECT id, CASE WHEN into_ IS NOT NULL THEN 'superseded' ELSE status END AS status, into_ AS superseded_by FROM {_F} LEFT JOIN {_MAP} ON dup = id",
    "merged_access": f"SELECT coalesce(into_, fact_id) AS fact_id, count(*) AS n, round(max(seen_at), 3) AS latest FROM {_A} LEFT JOIN {_MAP} ON dup = fact_id GROUP BY 1",
    "access_cap": f"WITH x AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY seen_at DESC) AS rn FROM {_A}), c AS (SELECT fact_id, max(seen_at) AS cut FROM x WHERE rn > 40 GROUP BY 1) SELECT fact_id, count(*) AS n, min(seen_at) AS oldest FROM x LEFT JOIN c USING (fact_id) WHERE cut IS NULL OR seen_at > cut GROUP BY 1",
    "access_update": f"WITH u AS (SELECT fact_id AS id, count(*) AS n, max(seen_at) AS t FROM {_A} GROUP BY 1) SELECT id, access_count + coalesce(n, 0) AS access_count, round(greatest(last_accessed, coalesce(t, 0)), 3) AS last_accessed FROM {_F} LEFT JOIN u USING (id)",
    "system_prompt": f"""WITH x AS (SELECT * FROM {_F} WHERE status = 'active'), u AS (SELECT id, CASE type WHEN 'C' THEN 0 ELSE 1 END AS part FROM x WHERE type IN ('C', 'D')
        UNION ALL SELECT id, 2 FROM x WHERE type = 'V' AND (importance IS NULL OR importance >= 0.8) UNION ALL SELECT id, 3 FROM x WHERE target IN ('identity', 'self') OR target LIKE 'identity.%' OR target LIKE 'self.%') SELECT id, part, id AS row_seq FROM u ORDER BY part, id LIMIT 500""",
    "stats": f"SELECT *, round(used / 100.0, 1)::DOUBLE AS pct FROM (SELECT CAST(sum(CASE WHEN status = 'active' THEN 1 ELSE 0 END) AS BIGINT) AS n_active, CAST(sum(CASE WHEN status = 'cold' THEN 1 ELSE 0 END) AS BIGINT) AS n_cold, CAST(sum(CASE WHEN status = 'superseded' THEN 1 ELSE 0 END) AS BIGINT) AS n_superseded, count(*) AS n_facts FROM {_F}) CROSS JOIN {_USED}",
    "hot_facts": f"SELECT f.id, label FROM {_F} f JOIN {duck_view('scopes')} s ON s.id = f.scope_id WHERE f.status = 'active' AND s.status = 'active'",
    "scope_scan": f"SELECT id, scope_id FROM {_F} WHERE status IN ('active', 'cold') AND (scope_id = 7 OR scope_id IS NULL)",
    "substring_access": f"SELECT id FROM {_F} WHERE status = 'active' AND content ILIKE '%RED%'",
    "retag": f"SELECT id, CASE WHEN id % 2 = 1 THEN target WHEN {S.hit('content', P.TARGET_USES)} THEN {_named('content', P.TARGET_USES)} WHEN {S.hit('content', P.TARGET_COLON)} THEN {_named('content', P.TARGET_COLON)} ELSE 'general' END AS target FROM {_RULES}",
    "scope_create": f"WITH s AS {duck_view('scopes')} SELECT CAST(id AS VARCHAR) AS id, label, status FROM s UNION ALL SELECT 's-' || left(sha256(label), 12), label, 'active' FROM (SELECT n_name AS label FROM nation UNION SELECT r_name FROM region) WHERE label NOT IN (SELECT label FROM s WHERE status = 'active')",
    "promote_pass": f"WITH {_PASS.format(ttl=172800)} SELECT id, s2 AS status FROM d",
    "promotion_metrics": f"WITH {_PASS.format(ttl=172800)} SELECT session_id, source, CAST(sum(CASE WHEN s2 = 'promoted' THEN 1 ELSE 0 END) AS BIGINT) AS promoted, CAST(sum(CASE WHEN s2 = 'retracted' THEN 1 ELSE 0 END) AS BIGINT) AS retracted FROM d WHERE s2 <> status GROUP BY ALL",
    "promoted_facts": f"WITH {_PASS.format(ttl=600)} SELECT sha256(CAST(id AS VARCHAR)) AS id, content, type, target, 1.0::DOUBLE AS metabolic_rate, 0.5::DOUBLE AS importance FROM d WHERE s2 = 'promoted'",
    "pending_summary": f"SELECT status, source, count(*) AS n FROM {_P} GROUP BY ALL",
    "pending_list": f"SELECT id, session_id, content FROM {_P} WHERE source = 'observed' AND status = 'provisional' ORDER BY session_id, updated_at DESC, id LIMIT 30",
    "session_expiry": f"SELECT session_id FROM {_P} WHERE status = 'provisional' AND source = 'agent_inference' GROUP BY 1 HAVING max(updated_at) < {NOW} - 172800",
    "training_pairs": f"""WITH x AS (SELECT i.*, f.id AS fact_seq, f.content FROM {_IX} i JOIN {_F} f ON f.id = i.fid WHERE (f.id % 10) / 10.0 >= 0.3 AND access_count >= 1)
        SELECT fact_seq, CAST(-1 AS BIGINT) AS ix, 'cross_context' AS pair_type, string_agg(CASE WHEN scope IS NOT NULL THEN '[' || scope || '] ' || query || ' → ' || content END, ' | ' ORDER BY ix, pos) AS input, any_value(content) AS output FROM x GROUP BY fact_seq HAVING count(DISTINCT scope) >= 2
        UNION ALL SELECT fact_seq, ix, 'fact_recall', query, content FROM x UNION ALL SELECT fact_seq, ix, 'task_completion', query, content FROM x WHERE fbs""",
    "chat_export": "SELECT CAST(to_json([{'role': 'system', 'content': 'You are a helpful assistant with long-term memory.'}, {'role': 'user', 'content': text}, {'role': 'assistant', 'content': 'turn ' || turn}]) AS VARCHAR) AS line FROM conversations WHERE role = 'user'",
    "import_dedup": "WITH x AS (SELECT conv_id * 1000 + turn AS row_seq, trim(text, E' \\n\\t\\r') AS c, role, 'conv/' || (conv_id % 7) AS s FROM conversations), y AS (SELECT * FROM x WHERE c <> '' QUALIFY row_number() OVER (PARTITION BY role, c, s ORDER BY row_seq) = 1) SELECT row_seq, CASE WHEN role = 'user' THEN c ELSE 'Assistant memory from imported session: ' || c END AS content, 'import:' || replace(s, '/', '-') AS scope, 'factual' AS category, 0.45::DOUBLE AS importance FROM y",
    "tfidf_vectors": f"""WITH d AS (SELECT conv_id * 1000 + turn AS id, {_TOK} AS toks FROM conversations), c AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(toks) AS token FROM d) GROUP BY ALL),
        r AS (SELECT c.id, c.token, (1 + ln(tf)) * ln(1 + (SELECT count(*) FROM d) / df) AS w FROM c JOIN (SELECT token, count(*) AS df FROM c GROUP BY 1) USING (token)) SELECT id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 5) AS weight FROM r""",
    "linucb_stats": f"SELECT arm, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(sum(f[i + 1] * CASE WHEN j < 0 THEN reward ELSE f[j + 1] END), 5) AS a FROM {_BR} CROSS JOIN range(3) x(i) CROSS JOIN range(-1, 3) y(j) GROUP BY ALL",
}
