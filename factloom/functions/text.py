"""Text rules as column functions: notation, classifiers, scores, tokens, slugs.

All of them are built-in expressions; a chain of them is one projection without a shuffle. Null texts count as empty.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text_or_empty(c), r"^\s+|\s+$", "")


def words(c: Column) -> Column:
    """White-space separated words, none of them empty."""
    return F.filter(F.split(text_or_empty(c), r"\s+"), lambda w: w != "")


def any_of(c: Column, patterns: list[str]) -> Column:
    return reduce(or_, [c.rlike(p) for p in patterns])


def lookup(key: Column, table: dict[str, float | str], default=None) -> Column:
    out = F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()], F.lit(default))
    return out


def weigh(hits: list[tuple[Column, float]]) -> Column:
    return reduce(add, [F.when(hit, F.lit(w)).otherwise(F.lit(0.0)) for hit, w in hits])


def notation(raw: Column) -> dict[str, Column]:
    """type, target and content of ``T[target]: content``; other text is a V fact about general."""
    s = strip(raw)
    is_typed = s.rlike(P.NOTATION)
    part = [F.regexp_extract(s, P.NOTATION, i) for i in (1, 2, 3)]
    fact_type = F.when(is_typed, lookup(part[0], P.SIGN_TYPES)).otherwise("V")
    return {"type": fact_type, "target": F.when(is_typed, strip(part[1])).otherwise("general"), "content": F.when(is_typed, strip(part[2])).otherwise(s), "rate": lookup(fact_type, P.METABOLIC_RATES, 1.0)}


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(text_or_empty(c), 256), 1, 16)


def category(c: Column) -> Column:
    out = F.lit("factual")
    for name, patterns in reversed(P.CATEGORIES):
        out = F.when(any_of(text_or_empty(c), patterns), F.lit(name)).otherwise(out)
    return out


def importance(c: Column, cat: Column | None = None) -> Column:
    c = text_or_empty(c)
    tier = F.greatest(F.lit(0.45), *[F.when(any_of(c, p), F.lit(s)).otherwise(F.lit(0.0)) for s, p in P.IMPORTANCE])
    bonus = F.lit(0.0) if cat is None else lookup(cat, P.CATEGORY_BONUS, 0.0)
    n = F.size(words(c))
    length = F.when(n > 30, 0.05).when(n < 5, -0.05).otherwise(0.0)
    return F.least(F.greatest(tier + bonus + length, F.lit(0.1)), F.lit(1.0))


def intent(query: Column) -> Column:
    q = F.lower(strip(query))
    out = F.lit("general")
    for name, _, patterns in reversed(P.INTENTS):
        out = F.when(any_of(q, patterns), F.lit(name)).otherwise(out)
    return out


def intent_confidence(name: Column) -> Column:
    return lookup(name, {n: c for n, c, _ in P.INTENTS}, 0.0)


def adversarial(c: Column) -> Column:
    t = F.lower(text_or_empty(c))
    hits = [(t.rlike(p), 0.6) for p in P.ADVERSARIAL_STRONG] + [(t.rlike(p), 0.25) for p in P.ADVERSARIAL_MEDIUM]
    return F.least(weigh(hits), F.lit(1.0))


def shape_query_flags(query: Column) -> Column:
    """Which answer shapes a query asks for; those that fit any query are always set."""
    q = F.lower(strip(query))
    return F.array(*[q.rlike(on_query) if on_query else F.lit(True) for on_query, _, _, _ in P.ANSWER_SHAPES])


def shape_text_flags(content: Column) -> Column:
    """Which answer shapes a text has."""
    c, low = text_or_empty(content), F.lower(strip(content))
    tests = [[x.rlike(p) for x, p in ((c, on_text), (low, on_low)) if p] for _, on_text, on_low, _ in P.ANSWER_SHAPES]
    return F.array(*[reduce(lambda a, b: a & b, t) for t in tests])


def shape_score(query_flags: Column, text_flags: Column) -> Column:
    return weigh([(query_flags[i] & text_flags[i], w) for i, (*_, w) in enumerate(P.ANSWER_SHAPES)])


def answer_shape(query: Column, content: Column) -> Column:
    return shape_score(shape_query_flags(query), shape_text_flags(content))


def terms(c: Column) -> Column:
    """Query terms: small-letter parts of identifiers without stop words, with synonyms; sorted, each once."""
    raw = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"([a-z0-9_./-]+)"), 1)
    parts = F.filter(F.flatten(F.transform(raw, lambda t: F.split(t, r"[._/-]+"))), lambda p: (F.length(p) > 1) & ~p.isin(*P.QUERY_STOP_WORDS))
    table = F.create_map(*[x for k, v in P.SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = F.flatten(F.transform(F.filter(parts, lambda p: p.isin(*P.SYNONYMS)), lambda p: F.element_at(table, p)))
    return F.array_sort(F.array_distinct(F.concat(parts, more)))


def target_boost(query_terms: Column, target_terms: Column) -> Column:
    """0.18 for each query term that a target term equals or, from four letters on, begins with or begins; at most 0.45."""
    hit = F.filter(query_terms, lambda q: F.exists(target_terms, lambda t: (q == t) | ((F.length(q) >= 4) & (t.startswith(q) | q.startswith(t)))))
    return F.least(F.lit(0.45), 0.18 * F.size(hit))


def link_tokens(c: Column) -> Column:
    low = F.filter(words(F.lower(text_or_empty(c))), lambda w: (F.length(w) > 1) & ~w.isin(*P.LINK_STOP_WORDS))
    return F.array_distinct(low)


def vector_tokens(c: Column) -> Column:
    """Tokens with repeats, in order."""
    raw = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("([a-z0-9]+)"), 1)
    return F.filter(raw, lambda w: (F.length(w) > 1) & ~w.isin(*P.VECTOR_STOP_WORDS))


def has_update_signal(c: Column) -> Column:
    return any_of(F.lower(text_or_empty(c)), P.UPDATE_SIGNALS)


def key_terms(c: Column) -> Column:
    c = text_or_empty(c)
    low = F.lower(c)
    products = F.regexp_extract_all(c, F.lit(P.PRODUCT_VERSION), 1)
    numbers = F.regexp_extract_all(c, F.lit(P.PRODUCT_VERSION), 2)
    named = F.zip_with(products, numbers, lambda p, n: F.concat(F.lower(p), F.lit(" "), n))
    regions = F.regexp_extract_all(low, F.lit(P.REGION_ID), 1)
    acronyms = F.filter(F.transform(F.regexp_extract_all(c, F.lit(P.ACRONYM), 1), F.lower), lambda a: ~a.isin(*P.ACRONYM_STOP))
    known = F.filter(F.array(*map(F.lit, P.PRODUCTS)), lambda p: F.contains(low, p))
    return F.array_sort(F.array_distinct(F.concat(named, F.transform(products, F.lower), regions, acronyms, known)))


def domain_words(c: Column) -> Column:
    raw = F.filter(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"\b([a-z]{4,})\b"), 1), lambda w: ~w.isin(*P.DOMAIN_STOP))
    stem = F.transform(raw, lambda w: F.when(F.length(F.regexp_replace(w, "(?:ing|ed|es|s)$", "")) >= 3, F.regexp_replace(w, "(?:ing|ed|es|s)$", "")).otherwise(w))
    return F.array_sort(F.array_distinct(stem))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; 0 if both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def contradiction_parts(c: Column) -> Column:
    """What :func:`contradiction_score` needs of one text."""
    return F.struct(key_terms(c).alias("terms"), domain_words(c).alias("domain"), F.array_distinct(words(F.lower(c))).alias("words"), has_update_signal(c).alias("updates"))


def contradiction_score(new: Column, old: Column, sim: Column) -> Column:
    """How much a new text takes back an old one, of the parts of both."""
    entity = 0.5 * overlap(new["terms"], old["terms"]) + 0.5 * overlap(new["domain"], old["domain"])
    combined = entity * 0.6 + sim * 0.4 + F.when(F.arrays_overlap(new["terms"], old["terms"]), 0.1).otherwise(0.0)
    quiet = F.when((sim >= 0.85) & (overlap(new["words"], old["words"]) >= 0.75), sim).otherwise(0.0)
    return F.when(~new["updates"], quiet).when(sim < 0.55, 0.0).otherwise(combined)


def contradiction(new: Column, old: Column, sim: Column) -> Column:
    """How much the new text takes back the old one."""
    return contradiction_score(contradiction_parts(new), contradiction_parts(old), sim)


def sentences(c: Column) -> Column:
    parts = F.split(text_or_empty(c), r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def factuality(s: Column) -> Column:
    s = text_or_empty(s)
    low = F.lower(s)
    n = F.size(words(s))
    score = 0.5 + weigh([((low if on_low else s).rlike(p), w) for p, on_low, w in P.FACTUALITY]) + F.when(n < 4, -0.2).when(n > 30, -0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def fact_type(s: Column) -> Column:
    out = F.lit("V")
    for name, pattern in reversed(P.FACT_TYPES):
        out = F.when(F.lower(text_or_empty(s)).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def target(s: Column) -> Column:
    def named(pattern: str) -> Column:
        return F.substring(F.replace(F.lower(F.regexp_extract(s, pattern, 1)), F.lit(" "), F.lit(".")), 1, 30)

    return F.when(s.rlike(P.TARGET_USES), named(P.TARGET_USES)).when(s.rlike(P.TARGET_COLON), named(P.TARGET_COLON)).otherwise("general")


def memorability(s: Column, kind: Column, context: Column) -> Column:
    score = 0.6 * (factuality(s) + lookup(kind, P.TYPE_WEIGHTS, 0.0)) + 0.4 * context
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def slug(c: Column, n: int = 3) -> Column:
    raw = F.filter(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"([\w.]+)"), 1), lambda w: ~w.isin(*P.SLUG_STOP_WORDS))
    return F.when(F.size(raw) > 0, F.array_join(F.slice(raw, 1, n), "-")).otherwise("general")


def safe_scope(session: Column, prefix: str = "import") -> Column:
    """A scope label: letters, digits and -_:. stay, other characters become dashes."""
    s = text_or_empty(session)
    return F.when(s == "", F.lit(f"{prefix}-import")).otherwise(F.concat(F.lit(f"{prefix}:"), F.regexp_replace(s, r"[^\p{L}\p{N}\-_:.]", "-")))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def patch_json(json: Column, **values: Column) -> Column:
    """A JSON object of strings with values set."""
    old = F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))
    new = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    kept = F.map_filter(old, lambda k, _: ~k.isin(*values))
    return F.to_json(F.map_concat(kept, new))


def is_identity(target: Column) -> Column:
    return target.isin("identity", "self") | target.startswith("identity.") | target.startswith("self.")


def show_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")
