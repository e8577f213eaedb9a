"""SQL counterparts (DuckDB) of the queries that SQL can express. They share no code with the operators but the fixed parameters."""

from __future__ import annotations

from . import licenses, quality

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT vec_id, label, e, len(e) AS d FROM v WHERE e IS NOT NULL AND len(e) > 0 AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.d = b.d AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""


def quality_sql() -> str:
    """Counts by splitting and windows; deciles from the same log-linear cells, found by ordering the documents themselves."""
    ppm = {"symbol_ppm": "n_symbols * 1000000 // word_chars", "dup_line_ppm": "n_dup_lines * 1000000 // n_lines", "repeat_ppm": "n_repeat_words * 1000000 // n_words", "word_milli": "word_chars * 1000 // n_words"}
    units = ["word_chars", "n_lines", "n_words"]
    low = "CASE WHEN {0} < 64 THEN {0} ELSE ({0} >> CAST(length(bin({0})) - 6 AS BIGINT)) << CAST(length(bin({0})) - 6 AS BIGINT) END"
    long = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, CAST({low.format(k)} AS DOUBLE) AS v FROM r WHERE n_words > 0" for k in [*ppm, *units])

    def deciles(name: str, key: str) -> str:
        qs = ", ".join(f"min(v) FILTER (rn * 10 >= total * {p}) AS q{p}" for p in (1, 5, 9))
        return f"{name} AS (SELECT {key}, measure, max(total) AS n, {qs} FROM (SELECT *, row_number() OVER (PARTITION BY {key}, measure ORDER BY v) AS rn, count(*) OVER (PARTITION BY {key}, measure) AS total FROM v) GROUP BY {key}, measure)"

    drawn = ", ".join(f"(o.n * o.q{p} + {quality.SHRINK} * w.q{p}) / (o.n + {quality.SHRINK}) AS q{p}" for p in (1, 5, 9))
    of = "max({1}) FILTER (measure = '{0}')".format
    limits = [f"{of(k, f'q9 + {quality.FENCE} * (q9 - q5)')} + {s} * sqrt({of(u, 'w5')} / {of(u, 'q5')}) AS {k}_max" for k, (s, u) in quality.SLACK.items()]
    limits.append(f"{of('word_milli', f'q1 - {quality.FENCE} * (q5 - q1)')} - {quality.SLACK['word_milli'][0]} * sqrt({of('n_words', 'w5')} / {of('n_words', 'q5')}) AS word_milli_min")
    broken = " OR ".join([f"{k} > {k}_max" for k in ppm] + ["word_milli < word_milli_min"])
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    win AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
    twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, s) > 1), rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY rid),
    m AS (SELECT w.rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - list_unique(ls) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines FROM w LEFT JOIN rep USING (rid)),
    r AS MATERIALIZED (SELECT *, {', '.join(f'CASE WHEN n_words > 0 THEN {v} ELSE 0 END AS {k}' for k, v in ppm.items())} FROM m), v AS MATERIALIZED ({long}),
    {deciles("o", "lang, source")}, {deciles("l", "lang")},
    x AS (SELECT o.lang, o.source, o.measure, {drawn}, w.q5 AS w5 FROM o JOIN l w ON w.lang IS NOT DISTINCT FROM o.lang AND w.measure = o.measure), q AS (SELECT lang, source, {", ".join(limits)} FROM x GROUP BY lang, source),
    k AS (SELECT r.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce({broken}, false) AS broken FROM r LEFT JOIN q ON q.lang IS NOT DISTINCT FROM r.lang AND q.source IS NOT DISTINCT FROM r.source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT broken AS kept FROM k"""


MIXING = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
    CAST(CAST('0x' || left(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM d GROUP BY source),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total, row_number() OVER (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST) AS k FROM s),
l AS (SELECT *, (total - sum(cap) OVER (ORDER BY k) + cap) / (sum(w) OVER () - sum(w) OVER (ORDER BY k) + w) AS level FROM c),
b AS (SELECT min(level) FILTER (level <= cap / w) AS level FROM l), e AS (SELECT (any_value(total) - coalesce(sum(cap) FILTER (cap < b.level * w), 0)) / sum(w) FILTER (cap >= b.level * w) AS level FROM c, b),
t AS (SELECT source, source_size, least(cap, e.level * w) AS target FROM c, e),
x AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
y AS (SELECT *, CAST(floor(rate + 1e-12::DOUBLE) AS BIGINT) AS whole, greatest(rate - floor(rate + 1e-12::DOUBLE), 0.0::DOUBLE) AS part, row_number() OVER (PARTITION BY source, size ORDER BY draw, doc_id NULLS FIRST) - 1 AS place FROM x),
k AS (SELECT source, size, any_value(part) AS part, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY size DESC) AS rn, CAST(sum(size * count(*)) OVER (PARTITION BY source ORDER BY size DESC) AS BIGINT) AS cum FROM y WHERE size > 0 GROUP BY source, size),
g(source, rn, size, taken, more) AS (SELECT source, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM t UNION ALL
    SELECT k.source, k.rn, k.size, g.taken + f.m * k.size, f.m FROM g JOIN k ON k.rn = g.rn + 1 AND k.source IS NOT DISTINCT FROM g.source,
    LATERAL (SELECT CAST(greatest(0, least(k.n, floor((k.part * k.cum - g.taken) / k.size + 0.5::DOUBLE))) AS BIGINT) AS m) f)
SELECT y.doc_id, y.size, y.source_size, y.target, CAST(CASE WHEN y.size > 0 THEN (y.whole + CASE WHEN y.place < g.more THEN 1 ELSE 0 END) * y.size ELSE 0 END AS BIGINT) AS taken
FROM y LEFT JOIN g ON g.size = y.size AND g.rn > 0 AND g.source IS NOT DISTINCT FROM y.source"""


def oracle_sql() -> dict[str, str]:
    return {"op4_licenses": licenses.scan_sql(), "op5_vector_near_dedup": VECTORS, "op6_quality": quality_sql(), "op9_mixing": MIXING}
