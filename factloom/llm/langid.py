"""Operator 7: language identification by interpolated Kneser-Ney character models.

A text is scored by its words: runs between white space, lower-cased, letters only, with a start and an end
sign. Each language has a Kneser-Ney model over these characters whose n-grams live in sorted arrays of 64-bit hashes, one
array per order, with the interpolated probability of each gram and the back-off weight of each context. A
distinct word is scored once per batch; texts add up their words' scores. The language with the lowest cross-entropy
per character wins.

Calibration: a part of the training sample is not counted into the models. On it, a logistic curve (fitted to
smoothed targets) turns the winning margin into a score between 0 and 1, and a high quantile of the
cross-entropy of each language plus ``slack`` becomes the limit beyond which a text is rejected; a language with too few texts for that has
the limit of all languages together, and all share one number of signs, so that a rare label takes no foreign texts.

The models are fitted on at most ``docs_per_lang`` labelled documents of each language, those with the smallest hash of
identifier and text; this bounds model and driver. Prediction reads every text whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; rows whose lang or text is null teach
nothing; without any training row all texts are ``und``; ties go to the first language by code point; null
ids are never held out and repeated rows stay; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, ship

ORDER, DOCS_PER_LANG, CALIBRATION_PART, SLACK = 4, 1500, 5, 1.5
START, END, SEP = "\x02", "\x03", "\n"
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)


def core(word: bytes) -> str:
    return "".join(filter(str.isalpha, word.decode("utf-8", "replace").lower()))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M
    return h ^ (h >> np.uint64(29))


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 0..order, the hash of the k code points that end at each position (garbage where fewer stand before it)."""
    c = codes.astype(np.uint64) + np.uint64(1)
    out = [np.zeros(len(c), np.uint64)]
    raw = np.zeros(len(c), np.uint64)
    for k in range(1, order + 1):
        shifted = np.concatenate([np.zeros(k - 1, np.uint64), c[: len(c) - k + 1]]) if k <= len(c) else np.zeros(len(c), np.uint64)
        raw = raw + _mix(shifted * _P + np.uint64(k))
        out.append(_mix(raw + np.uint64(k * int(_M) & 0xFFFFFFFFFFFFFFFF)))
    return out


@dataclass
class LanguageModel:
    """Sorted hash arrays of one language: for each order, grams with log-probabilities and contexts with log back-off weights."""

    grams: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    unknown: float = -20.0


def fit(counts: Counter[str], order: int = ORDER, vocab: int | None = None) -> LanguageModel:
    """A model from counts of words (letters only). ``vocab`` is the number of signs, one unseen among them; by default those of ``counts``."""
    by_order: list[Counter[str]] = [Counter() for _ in range(order + 1)]
    for word, n in counts.items():
        s = START + word + END
        for i in range(1, len(s)):
            k = min(order, i + 1)
            by_order[k][s[i + 1 - k : i + 1]] += n  # full order, or shorter where it begins at the start sign
    for k in range(order, 1, -1):  # below: in how many different ways a gram is continued to the left
        for gram in [g for g in by_order[k]]:
            if len(gram) > 1:
                by_order[k - 1][gram[1:]] += 1
    chars = {c for g in by_order[1] for c in g}
    vocab = vocab or len(chars) + 1
    model = LanguageModel(unknown=math.log(1.0 / vocab))
    lower: dict[str, float] = defaultdict(lambda: 1.0 / vocab)
    lower_empty = 1.0 / vocab
    probs: dict[str, float] = {}
    weights: dict[str, float] = {}
    for k in range(1, order + 1):
        grams = by_order[k]
        ones, twos = sum(v == 1 for v in grams.values()), sum(v == 2 for v in grams.values())
        discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        total: Counter[str] = Counter()
        kinds: Counter[str] = Counter()
        for g, n in grams.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        new: dict[str, float] = {}
        gamma = {h: discount * kinds[h] / total[h] for h in total}
        for g, n in grams.items():
            below = (probs[g[1:]] if g[1:] in probs else _down(g[1:], probs, weights, vocab)) if k > 1 else 1.0 / vocab
            new[g] = max(n - discount, 0.0) / total[g[:-1]] + gamma[g[:-1]] * below
        probs |= new
        weights |= gamma
        model.grams.append(list(new))
        model.logp.append(np.log(np.array(list(new.values()) or [1.0])[: len(new)]))
        model.contexts.append(list(gamma))
        model.backoff.append(np.log(np.array(list(gamma.values()) or [1.0])[: len(gamma)]))
    for k in range(order):
        for keys, vals, size in ((model.grams, model.logp, k + 1), (model.contexts, model.backoff, k)):
            h = _hash_strings(keys[k], size)
            at = np.argsort(h)
            keys[k], vals[k] = h[at], vals[k][at]
    return model


def _down(gram: str, probs: dict, weights: dict, vocab: int) -> float:
    factor = 1.0
    while gram:
        if gram in probs:
            return factor * probs[gram]
        factor *= weights.get(gram[:-1], 1.0)
        gram = gram[1:]
    return factor / vocab


def _hash_strings(grams: list[str], k: int) -> np.ndarray:
    if not grams:
        return np.zeros(0, np.uint64)
    if k == 0:
        return np.zeros(len(grams), np.uint64)
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)
    return gram_hashes(codes, k)[k][k - 1 :: k]


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def score_words(words: list[str], models: list[LanguageModel], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of each word in each model (words x models), and the number of predicted characters."""
    flat = START + (END + START).join(words) + END
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lens)
    pos = np.arange(len(codes)) - np.repeat(ends - lens, lens)  # place in the word; the start sign has 0
    hashes = gram_hashes(codes, order)
    ask = np.flatnonzero(pos > 0)
    length = np.minimum(order, pos[ask] + 1)
    # equal grams are looked up once: the full-order hash (or the whole beginning of a word) names a position's gram
    top = np.choose(length - 1, [hashes[k][ask] for k in range(1, order + 1)])
    _, first, back = np.unique(top, return_index=True, return_inverse=True)
    spot, length = ask[first], length[first]
    out = np.zeros((len(words), len(models)))
    for m, model in enumerate(models):
        logp = np.zeros(len(spot))
        open_ = np.arange(len(spot))
        for k in range(order, 0, -1):
            here = open_[length[open_] >= k]
            at, hit = _find(model.grams[k - 1], hashes[k][spot[here]])
            logp[here[hit]] += model.logp[k - 1][at[hit]]
            miss = here[~hit]
            # the context of a missed gram: the k - 1 code points before it
            ctx = hashes[k - 1][spot[miss] - 1] if k > 1 else np.zeros(len(miss), np.uint64)
            at, known = _find(model.contexts[k - 1], ctx)
            logp[miss[known]] += model.backoff[k - 1][at[known]]
            gone = np.zeros(len(spot), bool)
            gone[here[hit]] = True
            open_ = open_[~gone[open_]]
        logp[open_] += model.unknown
        sums = np.concatenate([[0.0], np.cumsum(logp[back])])
        n = lens - 1
        hi = np.cumsum(n)
        out[:, m] = sums[hi] - sums[hi - n]
    return out, lens - 1


@dataclass
class Identifier:
    langs: list[str]
    models: list[LanguageModel]
    slope: float = 1.0
    offset: float = 0.0
    limits: list[float] = field(default_factory=list)

    def entropies(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats per character of each text in each language, and its characters."""
        index: dict[bytes, int] = defaultdict(itertools.count().__next__)
        parts = [np.fromiter(map(index.__getitem__, w), np.int64, len(w)) for w in ((t or b"").split() for t in texts)]
        cores: dict[str, int] = defaultdict(itertools.count().__next__)
        of = np.fromiter((cores[core(w)] for w in index), np.int64, len(index))
        words = list(cores)
        if not words:
            return np.zeros((len(texts), len(self.models))), np.zeros(len(texts), np.int64)
        logp, chars = score_words(words, self.models)
        empty = np.fromiter((not w for w in words), bool, len(words))
        logp[empty], chars[empty] = 0.0, 0
        doc = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        at = of[np.concatenate(parts)] if len(doc) else np.zeros(0, np.int64)
        n = np.bincount(doc, chars[at], len(texts)).astype(np.int64)
        sums = np.stack([np.bincount(doc, logp[at, m], len(texts)) for m in range(len(self.models))], axis=1)
        return -sums / np.maximum(n, 1)[:, None], n

    @staticmethod
    def margin(h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How far the best language is ahead, in nats over at most 50 characters."""
        s = np.sort(h, axis=1)
        gap = s[:, 1] - s[:, 0] if h.shape[1] > 1 else np.full(len(h), 1.0)
        return gap * np.minimum(n, 50)

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float, float | None, bool]]:
        if not self.models:
            return [("und", 0.0, None, True)] * len(texts)
        out: list[tuple] = []
        for lo in range(0, len(texts), 2000):
            h, n = self.entropies(texts[lo : lo + 2000])
            best = np.argmin(h, axis=1)
            score = 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(h, n) + self.offset, -500, 500)))
            for i, b in enumerate(best.tolist()):
                if n[i] == 0:
                    out.append(("und", 0.0, None, True))
                else:
                    out.append((self.langs[b], float(score[i]), float(h[i, b]), bool(h[i, b] > self.limits[b])))
        return out


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, slack: float = SLACK, by_fold: bool = True) -> Identifier:
    """Fit models and calibration on a bounded sample of rows with a language (and, ``by_fold``, not held out)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (~held_out() if by_fold else F.lit(True)))
    h = F.xxhash64("doc_id", "text")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not totals:
        return Identifier([], [])
    # the hash is even over its range, so a share of the range holds a little more than is wanted; the exact number is cut from that
    limits = {lang: int(-(2**63) + (2**64 - 1) * min(1.0, (1.25 * docs_per_lang + 50) / n)) for lang, n in totals.items()}
    limits = {lang: min(cut, 2**63 - 1) for lang, cut in limits.items()}
    cut = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(limits.items()) for x in kv]), F.col("lang"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    near = rows.select("lang", "text", h.alias("h")).where(F.col("h") <= cut)
    sample = near.withColumn("rn", rank).where(F.col("rn") <= docs_per_lang)  # equal rows share a hash
    counts: dict[str, Counter[str]] = {lang: Counter() for lang in sorted(limits)}
    aside: list[tuple[str, bytes]] = []
    for r in sample.select("lang", "text", "rn").toLocalIterator():
        if r["rn"] % CALIBRATION_PART == 0:
            aside.append((r["lang"], r["text"].encode()))
        else:
            counts[r["lang"]].update(core(w) for w in r["text"].encode().split())
    for c in counts.values():
        c.pop("", None)
    langs = [lang for lang in counts if counts[lang]]
    # one number of signs for all, so that no language takes unseen ones for their few
    vocab = len({c for lang in langs for word in counts[lang] for c in word}) + 2
    who = Identifier(langs, [fit(counts[lang], vocab=vocab) for lang in langs])
    who.limits = [math.inf] * len(langs)
    if not langs:
        return who
    aside = [x for x in aside if x[0] in langs]
    if aside:
        h_, n = who.entropies([t for _, t in aside])
        best = np.argmin(h_, axis=1)
        want = np.array([langs.index(lang) for lang, _ in aside])
        use = n > 0
        who.slope, who.offset = _platt(who.margin(h_, n)[use], (best == want)[use])
        long = use & (n >= 20)
        every = h_[long, want[long]]
        for i in range(len(langs)):
            own = h_[long & (want == i), i]
            if len(own) or len(every):  # a language without texts for calibration has the limit of all together
                who.limits[i] = float(np.quantile(own if len(own) else every, 0.999)) + slack
    return who


def _platt(x: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Logistic fit of being right on the margin, with the smoothed targets of Platt's method."""
    if not len(x):
        return 1.0, 0.0
    pos, neg = right.sum(), (~right).sum()
    y = np.where(right, (pos + 1) / (pos + 2), 1 / (neg + 2))
    # margins of zero are a coin's toss: they stand for the wrong answers a small sample may lack
    x, y = np.concatenate([x, np.zeros(10)]), np.concatenate([y, np.full(10, 0.5)])
    a, b = 0.1, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - y) * x).sum() + 1e-3 * a, (p - y).sum() + 1e-3 * b])
        hess = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        size = np.abs(step).max()
        a, b = a - step[0] / max(1.0, size), b - step[1] / max(1.0, size)
    return float(max(a, 0.0)), float(b)


def identify(docs: DataFrame, who: Identifier | None = None, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy and rejected of each document."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(who or train(docs, **options))  # bounded by docs_per_lang

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.value.predict(as_bytes(batch.column(2)))
            cols = list(zip(*got)) if got else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, PREDICTED)


def keep_known(docs: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(docs, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            yield batch.filter(pa.array([not r[3] for r in model.value.predict(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
