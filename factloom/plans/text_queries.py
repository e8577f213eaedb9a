"""Queries over the text rules and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import scoring as C
from . import sql as S
from .views import duck_view, spark_view, table


def notation_parse(spark, d):
    parts = T.notation(F.col("raw"))
    return spark_view(spark, d, "typed_facts").select("id", *[c.alias(n) for n, c in parts.items()])


def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("source_hash"))


def scope_sanitise(spark, d):
    return table(spark, d, "part").select("p_partkey", T.safe_scope(F.concat("p_name", F.lit("/"), "p_brand")).alias("scope"))


def slug(spark, d):
    return spark_view(spark, d, "rule_facts").select("id", T.slug(F.col("content")).alias("slug"))


def category_importance(spark, d):
    c = T.category(F.col("content"))
    return spark_view(spark, d, "rule_facts").withColumn("category", c).select("id", "category", F.round(T.importance(F.col("content"), F.col("category")), 6).alias("importance"))


def intent(spark, d):
    x = spark_view(spark, d, "queries").withColumn("intent", T.intent(F.col("query")))
    return x.select("query_id", "intent", T.intent_confidence(F.col("intent")).alias("confidence"), T.lookup(F.col("intent"), P.INTENT_TYPE).alias("type_boost"), T.lookup(F.col("intent"), P.INTENT_Q_SHIFT, 0.0).alias("q_shift"))


def adversarial(spark, d):
    return spark_view(spark, d, "rule_facts").select("id", F.round(T.adversarial(F.col("content")), 6).alias("score"))


def answer_shape(spark, d):
    """All facts under the questions of the query set."""
    facts = spark_view(spark, d, "rule_facts").select("id", T.shape_text_flags(F.col("content")).alias("text_flags"), T.terms(F.col("content")).alias("terms"))
    both = C.text_scores(facts, C.query_features(spark_view(spark, d, "asked")), terms="terms")
    return both.select("id", "query_id", F.round("shape", 6).alias("shape"), F.round("boost", 6).alias("boost"))


def update_signal(spark, d):
    return spark_view(spark, d, "rule_facts").select("id", T.has_update_signal(F.col("content")).alias("updates"))


def key_terms(spark, d):
    c = F.col("content")
    return spark_view(spark, d, "rule_facts").select("id", F.array_join(T.key_terms(c), "|").alias("terms"), F.array_join(T.domain_words(c), "|").alias("domain_words"))


def contradiction_score(spark, d):
    x = spark_view(spark, d, "rule_facts")
    parts = T.contradiction_parts(F.col("content"))
    a, b = x.select("id", parts.alias("new")), x.select((F.col("id") + 32).alias("id"), parts.alias("old"))
    sim = F.lit(0.5) + (F.col("id") % 5) * 0.1
    # the file's bytes say little about the parts made of it, so neither side may be sent whole through the driver
    return a.hint("merge").join(b, "id").select("id", F.round(T.contradiction_score(F.col("new"), F.col("old"), sim), 6).alias("score"))


def fact_scores(spark, d):
    c = F.col("content")
    x = spark_view(spark, d, "rule_facts").withColumn("type", T.fact_type(c))
    return x.select("id", "type", T.target(c).alias("target"), F.round(T.factuality(c), 6).alias("factuality"), F.round(T.memorability(c, F.col("type"), F.lit(0.5)), 6).alias("memorability"))


def sentence_facts(spark, d):
    """Facts of every turn: sentences of 15 to 400 characters that score 0.3 or more."""
    x = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    x = x.where(F.length("sentence").between(15, 400)).withColumn("score", F.round(T.factuality(F.col("sentence")), 6)).where("score >= 0.3")
    return x.select("conv_id", "turn", "pos", "sentence", "score", T.fact_type(F.col("sentence")).alias("type"))


def term_normalise(spark, d):
    c = F.col("content")
    return spark_view(spark, d, "rule_facts").select("id", F.array_join(T.terms(c), " ").alias("terms"), F.array_join(F.array_sort(T.link_tokens(c)), " ").alias("link_tokens"), F.array_join(T.vector_tokens(c), " ").alias("vector_tokens"))


def query_features(spark, d):
    """The eight features of a query; the entropy is that of a vector of the same number."""
    q = spark_view(spark, d, "queries")
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    x = q.join(vec, "query_id", "left")
    w = T.words(F.col("query"))
    mass = F.transform("embedding", lambda v: F.abs(v.cast("double")))
    total = F.aggregate(mass, F.lit(0.0), lambda a, v: a + v)
    entropy = F.aggregate(F.transform(F.filter(mass, lambda v: v > 0), lambda v: -(v / total) * F.log2(v / total)), F.lit(0.0), lambda a, v: a + v)
    caps = F.size(F.filter(F.slice(w, 2, 1000), lambda t: t.rlike("^[A-Z]")))
    kind = T.intent(F.col("query"))
    return x.select(
        "query_id",
        F.least(F.length("query") / 100.0, F.lit(1.0)).alias("f_length"),
        F.least(F.size(F.array_distinct(T.words(F.lower("query")))) / 20.0, F.lit(1.0)).alias("f_unique"),
        F.contains("query", F.lit("?")).cast("double").alias("f_question"),
        F.lower("query").rlike(P.TEMPORAL_QUERY).cast("double").alias("f_temporal"),
        F.least(caps / 5.0, F.lit(1.0)).alias("f_entities"),
        F.round(F.coalesce(F.when(total > 0, F.least(entropy / 10.0, F.lit(1.0))), F.lit(0.5)), 6).alias("f_entropy"),
        F.round(F.log1p(F.lit(1000.0)) / 10.0, 6).alias("f_store"),
        T.lookup(kind, P.INTENT_DEPTH, 0.5).alias("f_depth"),
    )


QUERIES = {f.__name__: f for f in (notation_parse, content_hash, scope_sanitise, slug, category_importance, intent, adversarial, answer_shape, update_signal, key_terms, contradiction_score, fact_scores, sentence_facts, term_normalise, query_features)}

_RULES = duck_view("rule_facts")
_CATEGORY = S.ladder([(S.any_of("content", p), n) for n, p in P.CATEGORIES], "factual")
_IMPORTANCE = "greatest(0.45, " + ", ".join(f"CASE WHEN {S.any_of('content', p)} THEN {s} ELSE 0 END" for s, p in P.IMPORTANCE) + f") + {S.lookup('category', P.CATEGORY_BONUS, 0)} + CASE WHEN n_words > 30 THEN 0.05 WHEN n_words < 5 THEN -0.05 ELSE 0 END"


def _intent(x: str) -> str:
    return S.ladder([(S.any_of(S.strip(f"lower({x})"), p), n) for n, _, p in P.INTENTS], "general")


def _terms(x: str) -> str:
    parts = f"list_filter(flatten(list_transform(regexp_extract_all(lower({x}), '[a-z0-9_./-]+'), lambda t: regexp_split_to_array(t, '[._/-]+'))), lambda p: length(p) > 1 AND p NOT IN {S.strs(P.QUERY_STOP_WORDS)})"
    syn = "MAP {" + ", ".join(f"{S.q(k)}: {S.arr(v)}" for k, v in P.SYNONYMS.items()) + "}"
    more = f"flatten(list_transform(list_filter({parts}, lambda p: p IN {S.strs(list(P.SYNONYMS))}), lambda p: {syn}[p]))"
    return f"list_sort(list_distinct(list_concat({parts}, {more})))"


def _shape() -> str:
    hits = []
    for on_query, on_text, on_low, weight in P.ANSWER_SHAPES:
        tests = [S.hit(x, p) for x, p in ((S.strip("lower(query)"), on_query), ("content", on_text), (S.strip("lower(content)"), on_low)) if p]
        hits.append(("(" + " AND ".join(tests) + ")", weight))
    return S.weigh(hits)


def _bounded(pattern: str) -> str:
    """Word boundaries of all letters spelled out; DuckDB's own know ASCII only."""
    edge = r"[^\p{L}\p{N}_]"
    pattern = f"(?:^|{edge})" + pattern[2:] if pattern.startswith(r"\b") else pattern
    return pattern[:-2] + f"(?:$|{edge})" if pattern.endswith(r"\b") else pattern


def _factuality(x: str) -> str:
    hits = [(S.hit(f"lower({x})" if low else x, _bounded(p)), w) for p, low, w in P.FACTUALITY]
    n = f"len({S.words(x)})"
    return f"greatest(0.0, least(1.0, 0.5 + {S.weigh(hits)} + CASE WHEN {n} < 4 THEN -0.2 WHEN {n} > 30 THEN -0.1 ELSE 0 END))"


def _fact_type(x: str) -> str:
    return S.ladder([(S.hit(f"lower({x})", _bounded(p)), n) for n, p in P.FACT_TYPES], "V")


def _named(x: str, p: str) -> str:
    return f"left(replace(lower(regexp_extract({x}, {S.q(p)}, 1)), ' ', '.'), 30)"


def _key_terms(x: str) -> str:
    pv, low = S.q(P.PRODUCT_VERSION), f"lower({x})"
    prod = f"regexp_extract_all({x}, {pv}, 1)"
    return f"""list_sort(list_distinct(list_concat(list_concat(list_concat(list_concat(
        list_transform(list_zip({prod}, regexp_extract_all({x}, {pv}, 2)), lambda z: lower(z[1]) || ' ' || z[2]),
        list_transform({prod}, lambda z: lower(z))), regexp_extract_all({low}, {S.q(P.REGION_ID)}, 1)),
        list_filter(list_transform(regexp_extract_all({x}, {S.q(P.ACRONYM)}, 1), lambda z: lower(z)), lambda z: z NOT IN {S.strs(P.ACRONYM_STOP)})),
        list_filter({S.arr(P.PRODUCTS)}, lambda z: contains({low}, z)))))"""


def _domain(x: str) -> str:
    stem = "regexp_replace(w, '(?:ing|ed|es|s)$', '')"
    return f"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower({x}), '\\b([a-z]{{4,}})\\b', 1), lambda w: w NOT IN {S.strs(P.DOMAIN_STOP)}), lambda w: CASE WHEN length({stem}) >= 3 THEN {stem} ELSE w END)))"


def _jaccard(a: str, b: str) -> str:
    n = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {n} > 0 THEN len(list_intersect({a}, {b})) / {n} ELSE 0.0 END"


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', E'\\\\1\\n', 'g'), '\\n+', E'\\n', 'g'), E'\\n'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
_SIGN = f"regexp_extract(s, {S.q(P.NOTATION)}, 1)"
_TYPE = f"CASE WHEN regexp_matches(s, {S.q(P.NOTATION)}) THEN CASE {_SIGN} WHEN '✓' THEN 'done' WHEN '~' THEN 'obs' ELSE {_SIGN} END ELSE 'V' END"

ORACLES = {
    "notation_parse": f"""WITH x AS (SELECT id, {S.strip('raw')} AS s FROM {duck_view('typed_facts')})
        SELECT id, {_TYPE} AS type, CASE WHEN {S.hit('s', P.NOTATION)} THEN {S.strip(f"regexp_extract(s, {S.q(P.NOTATION)}, 2)")} ELSE 'general' END AS target,
        CASE WHEN {S.hit('s', P.NOTATION)} THEN {S.strip(f"regexp_extract(s, {S.q(P.NOTATION)}, 3)")} ELSE s END AS content, {S.lookup(_TYPE, P.METABOLIC_RATES, 1.0)} AS rate FROM x""",
    "content_hash": "SELECT doc_id, left(sha256(coalesce(text, '')), 16) AS source_hash FROM documents",
    "scope_sanitise": r"SELECT p_partkey, 'import:' || regexp_replace(p_name || '/' || p_brand, '[^\p{L}\p{N}\-_:.]', '-', 'g') AS scope FROM part",
    "slug": f"SELECT id, CASE WHEN len(w) > 0 THEN array_to_string(w[1:3], '-') ELSE 'general' END AS slug FROM (SELECT id, list_filter(regexp_extract_all(lower(content), '[\\w.]+'), lambda t: t NOT IN {S.strs(P.SLUG_STOP_WORDS)}) AS w FROM {_RULES})",
    "category_importance": f"WITH x AS (SELECT *, {_CATEGORY} AS category, len({S.words('content')}) AS n_words FROM {_RULES}) SELECT id, category, round(least(greatest(CAST({_IMPORTANCE} AS DOUBLE), 0.1), 1.0), 6) AS importance FROM x",
    "intent": f"WITH x AS (SELECT query_id, {_intent('query')} AS intent FROM {duck_view('queries')}) SELECT query_id, intent, {S.lookup('intent', {n: c for n, c, _ in P.INTENTS}, 0)} AS confidence, CASE intent WHEN 'value' THEN 'V' WHEN 'constraint' THEN 'C' WHEN 'decision' THEN 'D' END AS type_boost, {S.lookup('intent', P.INTENT_Q_SHIFT, 0)} AS q_shift FROM x",
    "adversarial": f"SELECT id, round(least({S.weigh([(S.hit('lower(content)', p), 0.6) for p in P.ADVERSARIAL_STRONG] + [(S.hit('lower(content)', p), 0.25) for p in P.ADVERSARIAL_MEDIUM])}, 1.0), 6) AS score FROM {_RULES}",
    "answer_shape": f"""WITH x AS (SELECT id, query_id, query, content, {_terms('query')} AS qt, {_terms('content')} AS tt FROM {_RULES} CROSS JOIN {duck_view('asked')})
        SELECT id, query_id, round({_shape()}, 6) AS shape, round(least(0.45, 0.18 * len(list_filter(qt, lambda a: len(list_filter(tt, lambda b: a = b OR (length(a) >= 4 AND (starts_with(b, a) OR starts_with(a, b))))) > 0))), 6)::DOUBLE AS boost FROM x""",
    "update_signal": f"SELECT id, {S.any_of('lower(content)', P.UPDATE_SIGNALS)} AS updates FROM {_RULES}",
    "key_terms": f"SELECT id, array_to_string({_key_terms('content')}, '|') AS terms, array_to_string({_domain('content')}, '|') AS domain_words FROM {_RULES}",
    "contradiction_score": f"""WITH r AS (SELECT id, content, {_key_terms('content')} AS t, {_domain('content')} AS w, list_distinct({S.words('lower(content)')}) AS u, {S.any_of('lower(content)', P.UPDATE_SIGNALS)} AS up FROM {_RULES}),
        x AS (SELECT a.id, a.up, 0.5 + (a.id % 5) * 0.1::DOUBLE AS sim, {_jaccard('a.t', 'b.t')} AS jt, {_jaccard('a.w', 'b.w')} AS jw, {_jaccard('a.u', 'b.u')} AS ju, len(list_intersect(a.t, b.t)) AS shared FROM r a JOIN r b ON a.id = b.id + 32)
        SELECT id, round(CASE WHEN NOT up THEN CASE WHEN sim >= 0.85 AND ju >= 0.75 THEN sim ELSE 0.0 END WHEN sim < 0.55 THEN 0.0 ELSE (0.5 * jt + 0.5 * jw) * 0.6 + sim * 0.4 + CASE WHEN shared > 0 THEN 0.1 ELSE 0.0 END END, 6) AS score FROM x""",
    "fact_scores": f"""WITH x AS (SELECT id, content, {_fact_type('content')} AS type, {_factuality('content')} AS f FROM {_RULES})
        SELECT id, type, CASE WHEN {S.hit('content', P.TARGET_USES)} THEN {_named('content', P.TARGET_USES)} WHEN {S.hit('content', P.TARGET_COLON)} THEN {_named('content', P.TARGET_COLON)} ELSE 'general' END AS target,
        round(CAST(f AS DOUBLE), 6) AS factuality, round(greatest(0.0, least(1.0, 0.6 * (f + {S.lookup('type', P.TYPE_WEIGHTS, 0)}) + 0.2)), 6) AS memorability FROM x""",
    "sentence_facts": f"""WITH x AS (SELECT conv_id, turn, {_SENTENCES} AS ss FROM conversations), y AS (SELECT conv_id, turn, unnest(range(len(ss))) AS pos, unnest(ss) AS sentence FROM x),
        z AS (SELECT *, round(CAST({_factuality('sentence')} AS DOUBLE), 6) AS score FROM y WHERE length(sentence) BETWEEN 15 AND 400)
        SELECT conv_id, turn, CAST(pos AS INT) AS pos, sentence, score, {_fact_type('sentence')} AS type FROM z WHERE score >= 0.3""",
    "term_normalise": f"""SELECT id, array_to_string({_terms('content')}, ' ') AS terms,
        array_to_string(list_sort(list_distinct(list_filter({S.words('lower(content)')}, lambda w: length(w) > 1 AND w NOT IN {S.strs(P.LINK_STOP_WORDS)}))), ' ') AS link_tokens,
        array_to_string(list_filter(regexp_extract_all(lower(content), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN {S.strs(P.VECTOR_STOP_WORDS)}), ' ') AS vector_tokens FROM {_RULES}""",
    "query_features": f"""WITH x AS (SELECT q.query_id, query, list_transform(embedding, lambda v: abs(v::DOUBLE)) AS m FROM {duck_view('queries')} q LEFT JOIN embeddings e ON e.vec_id = q.query_id),
        y AS (SELECT *, list_sum(m) AS t, {S.words('query')} AS w, {_intent('query')} AS kind FROM x)
        SELECT query_id, least(length(query) / 100.0, 1.0)::DOUBLE AS f_length, least(len(list_distinct({S.words('lower(query)')})) / 20.0, 1.0)::DOUBLE AS f_unique, CASE WHEN contains(query, '?') THEN 1.0 ELSE 0.0 END::DOUBLE AS f_question,
        CASE WHEN {S.hit('lower(query)', P.TEMPORAL_QUERY)} THEN 1.0 ELSE 0.0 END::DOUBLE AS f_temporal, least(len(list_filter(w[2:], lambda z: regexp_matches(z, '^[A-Z]'))) / 5.0, 1.0)::DOUBLE AS f_entities,
        round(coalesce(CASE WHEN t > 0 THEN least(list_sum(list_transform(list_filter(m, lambda v: v > 0), lambda v: -(v / t) * log2(v / t))) / 10.0, 1.0) END, 0.5), 6)::DOUBLE AS f_entropy,
        round(ln(1001.0) / 10.0, 6)::DOUBLE AS f_store, {S.lookup('kind', P.INTENT_DEPTH, 0.5)} AS f_depth FROM y""",
}
