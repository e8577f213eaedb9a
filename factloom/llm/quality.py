"""Operator 6: quality rules with thresholds from mergeable quantile sketches per language and source.

Every document gets counts of words, symbols, repeated lines and repeated five-word windows. The thresholds are not fixed:
each (language, source) keeps, for each measure, a log-linear histogram (32 cells for each power of two, a relative
error of 1/32). Such sketches add up cell by cell in any order, so they are combined before the shuffle, are the same on
every run and see all documents. A document fails where a measure lies beyond ``q90 + FENCE * (q90 - q50) + slack`` of its own group (mean word
length: below the mirrored limit, too). Quantiles of a group of n documents are drawn towards those of its language as if that held ``SHRINK`` more
documents of it, so that a small group has no wild limits. The slack is what a rate of a typical document of the language may vary by; it grows with the
root of how many fewer words, lines or characters the group's documents have. Where nine documents in ten have none of what is measured, quantiles are zero
and the slack alone is the limit.

Measures, as whole numbers: symbols, repeated lines and repeated words in parts per million of word characters, lines and words; word
length in thousandths.

Defined results: null and word-less texts have no words and fail the base rule; a null language or source is a group of its
own; null ids and repeated rows are rows like others; an empty table gives an empty result; other columns are ignored by
:func:`rate` and pass through :func:`keep_good` whatever their names.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, materialize, ship

WINDOW, FENCE, SHRINK = 5, 3, 50
#: Measure: slack beyond the tail, and what the measure is a rate of.
SLACK = {"symbol_ppm": (20_000, "word_chars"), "dup_line_ppm": (300_000, "n_lines"), "repeat_ppm": (100_000, "n_words"), "word_milli": (1_000, "n_words")}
_UNITS = ["word_chars", "n_lines", "n_words"]
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in _SYMBOLS)
_CONTINUES = bytes(range(0x80, 0xC0))
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """How many words stand in a window of ``width`` words that the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = defaultdict(itertools.count().__next__)
    at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    key, kinds, base = at[:n].copy(), len(index), len(index)
    for k in range(1, width):
        if kinds > (1 << 62) // base:  # number the windows so far, so that keys stay exact
            _, key = np.unique(key, return_inverse=True)
            kinds = n
        key = key * base + at[k : n + k]
        kinds *= base
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def measure(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines with a word."""
    text = text or b""
    words = text.split()
    chars = len(b"".join(words).translate(None, _CONTINUES))
    symbols = len(text.translate(None, _NOT_SYMBOL))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = np.array([measure(t) for t in as_bytes(batch.column("_text"))], np.int64).reshape(-1, 6)
        names = [x.split()[0] for x in BASE.split(", ")]
        kept = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *[pa.array(got[:, i]) for i in range(6)]], names=[*kept, *names])


def measures(docs: DataFrame, text_hash: bool = False) -> DataFrame:
    """doc_id, lang, source and all counts of each document."""
    ship(docs.sparkSession)
    extra = [F.xxhash64("text").alias("text_hash")] if text_hash else []
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), *extra, F.col("text").cast("string").alias("_text"))
    head = "doc_id long, lang string, source string, " + ("text_hash long, " if text_hash else "")
    return picked.mapInArrow(_measures, head + BASE)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def with_rates(m: DataFrame) -> DataFrame:
    def ppm(a: str, b: str) -> Column:
        return F.expr(f"CASE WHEN {b} > 0 THEN {a} * 1000000 div {b} ELSE 0 END")

    return m.withColumns({"symbol_ppm": ppm("n_symbols", "word_chars"), "dup_line_ppm": ppm("n_dup_lines", "n_lines"), "repeat_ppm": ppm("n_repeat_words", "n_words"), "word_milli": F.expr("CASE WHEN n_words > 0 THEN word_chars * 1000 div n_words ELSE 0 END")})


def cell(x: str) -> str:
    """SQL of the log-linear cell of a whole number: itself below 64, else 32 cells for each power of two."""
    e = f"(length(bin({x})) - 6)"
    return f"CASE WHEN {x} < 64 THEN {x} ELSE {e} * 32 + shiftright({x}, cast({e} as int)) END"


def low_end(c: str) -> str:
    """SQL of the smallest number in a cell."""
    e = f"({c} div 32 - 1)"
    return f"CASE WHEN {c} < 64 THEN {c} ELSE shiftleft({c} - {e} * 32, cast({e} as int)) END"


def sketches(rated: DataFrame) -> DataFrame:
    """(lang, source, measure, cell, n): the sketch of each measure of each group; sketches of parts add up."""
    names = [*SLACK, *_UNITS]
    cols = ", ".join(f"'{k}', cast({cell(k)} as long)" for k in names)
    long = rated.where("n_words > 0").select("lang", "source", F.expr(f"stack({len(names)}, {cols}) as (measure, cell)"))
    return long.groupBy("lang", "source", "measure", "cell").agg(F.count("*").alias("n"))


def _quantiles(cells: DataFrame, *key: str) -> DataFrame:
    """(key, measure, n, q1, q5, q9): deciles of sketches."""
    group = Window.partitionBy(*key, "measure")  # cells, not documents: a few hundred at most
    at = cells.withColumns({"run": F.sum("n").over(group.orderBy("cell")), "total": F.sum("n").over(group)})
    q = [F.min(F.when(F.col("run") * 10 >= F.col("total") * p, F.col("cell"))).alias(f"c{p}") for p in (1, 5, 9)]
    deciles = at.groupBy(*key, "measure").agg(*q, F.max("total").alias("n"))
    return deciles.select(*key, "measure", "n", *[F.expr(low_end(f"c{p}")).cast("double").alias(f"q{p}") for p in (1, 5, 9)])


def thresholds(cells: DataFrame, fence: int = FENCE, shrink: int = SHRINK) -> DataFrame:
    """A row per (lang, source) with the upper limit of every measure and the lower one of word length."""
    own = _quantiles(cells, "lang", "source")
    whole = _quantiles(cells.groupBy("lang", "measure", "cell").agg(F.sum("n").alias("n")), "lang")
    key = F.coalesce(F.concat(F.lit("s"), F.col("lang")), F.lit("n")).alias("_l")
    both = own.select("*", key).join(whole.select(key, "measure", *[F.col(f"q{p}").alias(f"w{p}") for p in (1, 5, 9)]), ["_l", "measure"])
    drawn = [((F.col("n") * F.col(f"q{p}") + shrink * F.col(f"w{p}")) / (F.col("n") + shrink)).alias(f"q{p}") for p in (1, 5, 9)]
    x = both.select("lang", "source", "measure", *drawn, "w5")

    def of(measure: str, value: Column) -> Column:
        return F.max(F.when(F.col("measure") == measure, value))

    wide = [F.sqrt(of(u, F.col("w5")) / of(u, F.col("q5"))).alias(f"{u}_scale") for u in _UNITS]
    tail = [of(k, F.col("q9") + fence * (F.col("q9") - F.col("q5"))).alias(f"{k}_tail") for k in SLACK]
    low = of("word_milli", F.col("q1") - fence * (F.col("q5") - F.col("q1"))).alias("word_milli_low")
    g = x.groupBy("lang", "source").agg(*wide, *tail, low)
    limits = [(F.col(f"{k}_tail") + s * F.col(f"{u}_scale")).alias(f"{k}_max") for k, (s, u) in SLACK.items()]
    return g.select("lang", "source", *limits, (F.col("word_milli_low") - SLACK["word_milli"][0] * F.col("n_words_scale")).alias("word_milli_min"))


def rate(docs: DataFrame, fence: int = FENCE, text_hash: bool = False) -> DataFrame:
    """Counts, base_failed, kept and the reasons of each document."""
    m = materialize(with_rates(measures(docs, text_hash)), "measures")
    t = materialize(thresholds(sketches(m), fence), "thresholds")
    key = [F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit("n")).alias(f"_{c}") for c in ("lang", "source")]
    limits = t.select(*key, *[c for c in t.columns if c.endswith(("_max", "_min"))])
    both = m.select("*", *key).join(limits, ["_lang", "_source"], "left")
    broken = [F.when(F.col(k) > F.col(f"{k}_max"), F.lit(k)) for k in SLACK] + [F.when(F.col("word_milli") < F.col("word_milli_min"), F.lit("word_milli"))]
    out = both.withColumn("base_failed", base_failed()).withColumn("reasons", F.array_compact(F.array(*broken)))
    names = ["doc_id", *(["text_hash"] if text_hash else []), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(*names, "base_failed", (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"), "reasons")


def keep_good(docs: DataFrame, fence: int = FENCE) -> DataFrame:
    """The documents that are kept, with all their columns. The counts are taken a second time rather than joined back to rows that may lack an id."""
    ship(docs.sparkSession)
    m = materialize(with_rates(measures(docs)), "measures")
    t = materialize(thresholds(sketches(m), fence), "thresholds")
    key = [F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n")).alias(f"_{c}") for c in ("lang", "source")]
    limits = t.select(*key, *[c for c in t.columns if c.endswith(("_max", "_min"))])
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    wide = docs.select(row, F.col("text").cast("string").alias("_text"), *key)
    schema = wide.select("_row", "_lang", "_source").schema
    ddl = schema.simpleString()[len("struct<") : -1]
    counted = wide.mapInArrow(_measures, f"{_ddl(schema)}, {BASE}") if ddl else wide
    both = with_rates(counted).join(limits, ["_lang", "_source"], "left")
    bad = base_failed()
    for k in SLACK:
        bad = bad | F.coalesce(F.col(k) > F.col(f"{k}_max"), F.lit(False))
    bad = bad | F.coalesce(F.col("word_milli") < F.col("word_milli_min"), F.lit(False))
    return both.where(~bad).select("_row.*")


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
