"""The whole pipeline against plain Python: no frames, one document at a time."""

import collections
import hashlib
import math
import re

import numpy as np
from test_llm import slow_fingerprint, slow_targets

import corpus_pipeline
from factloom.llm import langid
from factloom.llm.common import default_tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars, symbols, dup = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    part = lambda a, b: a * 1_000_000 // b if b else 0
    rates = {"symbol": part(symbols, chars), "dup": part(dup, len(lines)), "repeat": part(len(covered), n), "word": chars * 1000 // n if n else 0}
    return n, len(covered), rates | {"chars": chars, "lines": len(lines), "words": n}


def floor_cell(x):
    shift = max(0, x.bit_length() - 6)
    return x >> shift << shift


def decile(xs, p):
    xs = sorted(xs)
    return float(xs[-(-len(xs) * p // 10) - 1])


def brute(rows, who):
    rows = [r for r in rows if not who.predict([r["text"].encode()])[0][3]]
    slack = {"symbol": (20_000, "chars"), "dup": (300_000, "lines"), "repeat": (100_000, "words"), "word": (1_000, "words")}
    seen = [(r, *counts(r["text"])) for r in rows]
    groups, langs = collections.defaultdict(list), collections.defaultdict(list)
    for r, n, _, m in seen:
        if n:
            cells = {k: floor_cell(v) for k, v in m.items()}
            groups[r["lang"], r["source"]].append(cells)
            langs[r["lang"]].append(cells)

    def limits(key):
        own, whole = groups[key], langs[key[0]]
        q = {(k, p): (len(own) * decile([x[k] for x in own], p) + 50 * decile([x[k] for x in whole], p)) / (len(own) + 50) for k in own[0] for p in (1, 5, 9)}
        out = {}
        for k, (s, unit) in slack.items():
            s *= math.sqrt(decile([x[unit] for x in whole], 5) / q[unit, 5])
            out[k] = q[k, 1] - 3 * (q[k, 5] - q[k, 1]) - s if k == "word" else -1.0, q[k, 9] + 3 * (q[k, 9] - q[k, 5]) + s
        return out

    bounds = {key: limits(key) for key in groups}
    good = []
    for r, n, covered, m in seen:
        if n >= 10 and 100 * covered <= 20 * n and all(lo <= m[k] <= hi for k, (lo, hi) in bounds[r["lang"], r["source"]].items()):
            good.append(r)
    good.sort(key=lambda r: r["doc_id"])
    fps = [slow_fingerprint(r["text"]) for r in good]
    up = list(range(len(good)))
    for i in range(len(good)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    kept = [r for i, r in enumerate(good) if up[i] == i]
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in kept}
    total = collections.Counter()
    for r in kept:
        total[r["source"]] += size[r["doc_id"]]
    target = slow_targets(dict(total))
    times = {}
    for s in total:
        rate = target[s] / total[s]
        whole = math.floor(rate + 1e-12)
        part, taken, wanted = max(rate - whole, 0.0), 0, 0
        of = collections.defaultdict(list)
        for r in kept:
            if r["source"] == s:
                of[size[r["doc_id"]]].append((int(hashlib.md5(f"7:{r['doc_id']}".encode()).hexdigest()[:8], 16), r["doc_id"]))
        for n in sorted(of, reverse=True):
            wanted += n * len(of[n])
            k = max(0, min(len(of[n]), math.floor((part * wanted - taken) / n + 0.5)))
            taken += k * n
            for i, (_, d) in enumerate(sorted(of[n])):
                times[d] = whole + (i < k)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer_path("word_bpe_49k.json"))
    out = collections.Counter()
    for r in kept:
        ids = t.encode(r["text"], add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        out[r["doc_id"], len(ids), *digest] += times[r["doc_id"]]
    return +out


def test_pipeline_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    got = collections.Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    assert got == brute(rows, langid.train(docs))
