"""Small fixtures for every operator: brute force, libraries, round trips, and the defined results for odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import bpe, graph, html_text, langid, licenses, mixing, quality, simhash, sstable, token_counts, vector_dedup
from factloom.llm.common import default_tokenizer_path, new_path

ODD = ["", None, "  ", "a  b   c", " x", "x ", "a\n b", "a \n\nb", "<|endoftext|> hi<|endoftext|>", "<s> a</s>", "ÉÅ é ̸ x", "x▁ ▁y", "a b　c", "ΑΣ ΣΑΣ", "İI", "\x00 a\x00b", "you'll don't 123 !!", "ﬁ Ａ 你好", "\t\r\nq\x1cz\x85w\xa0", " " * 50 + "x" + " " * 7, "😀‍ x\n\n\n y", "ß" * 3000, "the " * 4000, "line one.\nThe next, line.\nThe end."]


@pytest.fixture(scope="module")
def rows():
    return [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "again"), (3, "again")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", "x", 1) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, units string, fp int").repartition(3)


EMPTY = "doc_id long, text string, lang string, source string"


def test_bpe_against_library(spark, docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer_path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, bpe.encode(docs, digest=True).collect())) == want
    small = bpe.encode(docs, digest=True, block_units=50, bucket_units=20)  # many blocks and buckets
    assert collections.Counter(map(tuple, small.collect())) == want
    tokens = bpe.encode(docs)
    assert collections.Counter((r.doc_id, r.decoded) for r in tokens.collect()) == collections.Counter((r.doc_id, r.decoded) for r in bpe.decode(tokens).collect())
    assert bpe.encode(spark.createDataFrame([], EMPTY), digest=True).count() == 0


def test_token_counts_and_prefixes(spark, docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=default_tokenizer_path("piece_bpe_32k.model"))
    want = collections.Counter((i, len((x or "").encode()), len(sp.encode(x or "")), len(sp.encode(x or "")) > 4096) for i, x in rows)
    assert collections.Counter(tuple(r)[:4] for r in token_counts.count_tokens(docs).collect()) == want
    short = [(i, x) for i, x in rows if len(x or "") < 100]
    got = {(r.doc_id, r.n_tokens): r for r in token_counts.count_prefixes(spark.createDataFrame(short, "doc_id long, text string")).collect()}
    for i, x in short:
        prefixes = [len(sp.encode(x[:k])) for k in range(1, len(x or "") + 1)]
        assert got[i, len(sp.encode(x or ""))].prefix_tokens == prefixes
    for limit in (1, 3, 7):
        for r in token_counts.count_tokens(spark.createDataFrame(short, "doc_id long, text string"), limit=limit).collect():
            text = next(x or "" for i, x in short if i == r.doc_id and len(sp.encode(x or "")) == r.n_tokens and len((x or "").encode()) == r.n_bytes)
            assert r.budget_chars == max([k for k in range(len(text) + 1) if len(sp.encode(text[:k])) <= limit])
    budget = spark.createDataFrame([([1, 2, 2, 3, 4],)], "p array<int>").select(token_counts.longest_prefix(F.col("p"), 2)).first()[0]
    assert budget == 3
    assert token_counts.count_tokens(spark.createDataFrame([], EMPTY)).count() == 0


def test_shards_round_trip(spark, docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer_path("byte_bpe_50k.json"))
    manifest = sstable.write_shards(docs, new_path(spark, "sst"), shard_bytes=2000)
    got = sorted(sstable.read_shards(manifest, digest=True).collect(), key=lambda r: r.start)
    want = [(i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x in rows]
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter((i, len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for i, v in want)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    found = sstable.lookup(manifest, [3, 5, 999]).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in found) == collections.Counter((i, tuple(v)) for i, v in want if i in (3, 5))
    assert sstable.round_trip(spark, spark.createDataFrame([], EMPTY)).count() == 0


def test_shard_block_damage_is_seen(tmp_path):
    path = str(tmp_path / "a.sst")
    w = sstable.ShardWriter(sstable.open_path(path, write=True), 2)
    for i in range(-50, 500):
        w.add(i, np.arange(i % 7, dtype=np.uint32))
    w.close()
    with sstable.open_path(path) as f:
        r = sstable.ShardReader(f)
        assert [d for d, _ in r] == list(range(-50, 500)) and len(r.get(-50)) == 1 and r.get(9999) == []
        assert sum(r.may_hold(i) for i in range(1000, 3000)) < 100
    data = bytearray(open(path, "rb").read())
    data[20] ^= 255
    open(path, "wb").write(data)
    with sstable.open_path(path) as f, pytest.raises(Exception):
        list(sstable.ShardReader(f))


def slow_fingerprint(x):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_against_brute_force(spark, docs, rows):
    rng = np.random.default_rng(4)
    base = [" ".join(map(str, rng.integers(0, 50, 400))) for _ in range(6)]
    texts = [t for _, t in rows]
    for b in base:
        w = b.split()
        texts += [b, b] + [" ".join([*w[:k], "new", *w[k:]]) for k in range(0, 400, 40)]
    data = list(enumerate(texts))
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4), tile=8).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i, _ in data] == [f"{f:016x}" for f in fps]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    assert [got[i].component_id for i, _ in data] == roots(len(fps), pairs)
    kept = simhash.keep_one(docs).collect()
    assert simhash.keep_one(docs).columns == docs.columns
    odd = [(i, slow_fingerprint(t)) for i, t in rows]
    pairs = [(a, b) for a in range(len(odd)) for b in range(a) if bin(odd[a][1] ^ odd[b][1]).count("1") <= 3]
    assert len(kept) == len(set(roots(len(odd), pairs)))
    assert simhash.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0 and simhash.keep_one(spark.createDataFrame([], EMPTY)).count() == 0


def test_fingerprint_of_null_ids(spark):
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (None, "q w e r t z u i o p")], "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.component_id) for r in got) == {(None, 7): 1, (7, 7): 1, (None, None): 1}


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    want = roots(1300, pairs)
    touched = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: want[x] for x in touched}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for label in range(3):
        centres = rng.standard_normal((60 if label else 260, 16))
        for c in centres:
            for _ in range(rng.integers(1, 4)):
                rows.append((len(rows), (c + 0.04 * rng.standard_normal(16)).astype(np.float32).tolist(), label))
    hub = rng.standard_normal(16)
    rows += [(len(rows) + i, (hub + 0.02 * rng.standard_normal(16)).astype(np.float32).tolist(), 0) for i in range(150)]
    same = rows[5][1]
    rows += [(len(rows) + i, same, 0) for i in range(40)]
    odd = [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] + [1.0] * 15, 1), (9003, same, None), (9004, [1.0] * 8, 0), (9005, [None] + [1.0] * 15, 1), (9006, [], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df, leaf=64, tile=32).collect()}
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    assert [got[i].n_links for i in range(len(rows))] == near.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(rows))] == roots(len(rows), zip(*np.nonzero(near)))
    for i, *_ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_quality_measures_against_brute_force(spark, docs, rows):
    def slow(x):
        x = x or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        seen, dup = set(), 0
        for line in x.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(cover)

    for x in [*ODD, "a b c d e a b c d e", "# x\n\n# x\n# x", "|a| |b|\n" * 5, " ".join(map(str, range(9000))) + " 1 2 3 4 5 6"]:
        assert quality.measure((x or "").encode())[:5] == slow(x), x
    got = quality.rate(docs).collect()
    assert len(got) == len(rows) and all(not r.kept for r in got if r.base_failed)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.rate(spark.createDataFrame([], EMPTY)).count() == 0


def test_quality_thresholds_adapt(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(4000)]
    good = [" ".join(rng.choice(words, 60)) for _ in range(200)]
    rows = [(i, t, "en", "a") for i, t in enumerate(good)] + [(900, " ".join(w + "%%%" for w in rng.choice(words, 60)), "en", "a")]
    rows += [(1000 + i, " ".join(w + "%" for w in rng.choice(words, 60)), "en", "symbols") for i in range(200)]
    got = {r.doc_id: r.kept for r in quality.rate(spark.createDataFrame(rows, EMPTY)).collect()}
    assert not got[900] and sum(got[i] for i in range(200)) == 200 and sum(got[1000 + i] for i in range(200)) == 200


def test_sketch_cells(spark):
    xs = [0, 1, 63, 64, 65, 127, 128, 1000, 999_999, 2**40]
    df = spark.createDataFrame([(x,) for x in xs], "x long").selectExpr("x", f"cast({quality.cell('x')} as long) c").selectExpr("x", "c", f"cast({quality.low_end('c')} as long) low")
    for r in df.collect():
        assert r.low <= r.x <= r.low * (1 + 1 / 32) + 1e-9


def test_kneser_ney_sums_to_one():
    counts = collections.Counter("the then there this that with thing other".split() * 3 + "zoo".split())
    m = langid.fit(counts)
    letters = sorted({c for w in counts for c in w})

    def log_p(ctx, c):
        codes = np.frombuffer((langid.START + ctx + c).encode("utf-32-le"), np.uint32)
        h = langid.gram_hashes(codes, langid.ORDER)
        p, k, out = len(codes) - 1, min(langid.ORDER, len(codes)), 0.0
        while k > 0:
            at, hit = langid._find(m.grams[k - 1], h[k][p : p + 1])
            if hit[0]:
                return out + m.logp[k - 1][at[0]]
            at, hit = langid._find(m.contexts[k - 1], h[k - 1][p - 1 : p] if k > 1 else np.zeros(1, np.uint64))
            out += m.backoff[k - 1][at[0]] if hit[0] else 0.0
            k -= 1
        return out + m.unknown

    for ctx in ("", "t", "th", "the", "xq"):
        assert abs(sum(np.exp(log_p(ctx, c)) for c in [*letters, langid.END, "☃"]) - 1) < 1e-9
    words = ["the", "hello", "zoo", "ß"]
    got, n = langid.score_words(words, [m])
    for i, w in enumerate(words):
        assert abs(got[i, 0] - sum(log_p(w[:k], (w + langid.END)[k]) for k in range(len(w) + 1))) < 1e-9 and n[i] == len(w) + 1


def test_language_id_held_out(spark, sf_dir, docs):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)
    shuffled = langid.identify(df.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("q")))
    assert {(r.doc_id, r.lang_pred, r.score) for r in shuffled.collect()} == {(r.doc_id, r.lang_pred, r.score) for r in got}
    odd = langid.identify(docs).collect()
    assert {r.lang_pred for r in odd} == {"en", "und"} and langid.keep_known(docs).columns == docs.columns
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == len(odd)
    assert langid.identify(spark.createDataFrame([], EMPTY)).count() == 0


def test_a_rare_language_takes_no_foreign_texts(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rare = [(10**7 + i, t, "it") for i, t in enumerate(["la casa era vuota e silenziosa", "domani andremo tutti al mare", "il treno parte alle otto di sera", "una tazza di caffè molto forte"]) if zlib.crc32(str(10**7 + i).encode()) % 5]
    who = langid.train(df.unionByName(spark.createDataFrame(rare, df.schema)))
    assert "it" in who.langs and all(np.isfinite(who.limits))
    foreign = ["это предложение написано по русски и довольно длинное", "这 是 一 个 中文 句子 没有 别的 语言", "zxqv wkjq pqzx vvkw qjxz kzzq xqvw jjkq", "łódź żółć gęślą jaźń pchnąć w tę łódź jeża"]
    assert all(r[3] for r in who.predict([t.encode() for t in foreign]))


def test_prediction_of_words_against_a_plain_model():
    """Interpolated probabilities by recursion, without hashes or arrays."""
    words = collections.Counter({"aba": 3, "abb": 1, "ba": 2, "cab": 1})
    model, order = langid.fit(words), langid.ORDER
    grams = [collections.Counter() for _ in range(order + 1)]
    for w, n in words.items():
        s = "\x02" + w + "\x03"
        for i in range(1, len(s)):
            k = min(order, i + 1)
            grams[k][s[i + 1 - k : i + 1]] += n
    for k in range(order, 1, -1):
        for g in list(grams[k]):
            if len(g) > 1:
                grams[k - 1][g[1:]] += 1
    vocab = len(grams[1]) + 1

    def p(gram):
        if not gram:
            return 1 / vocab
        own = grams[len(gram)]
        ones, twos = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        with_context = {g: v for g, v in own.items() if g[:-1] == gram[:-1]}
        if not with_context:
            return p(gram[1:])
        total = sum(with_context.values())
        return max(own[gram] - d, 0) / total + d * len(with_context) / total * p(gram[1:])

    for w in ("aba", "cab", "bbb", "xa", "ab"):
        s = "\x02" + w + "\x03"
        want = sum(np.log(p(s[max(0, i + 1 - order) : i + 1])) for i in range(1, len(s)))
        got, n = langid.score_words([w], [model])
        assert n[0] == len(w) + 1 and abs(got[0, 0] - want) < 1e-9


def slow_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), list(names)
    while open_:
        share = left / sum(w[s] for s in open_)
        full = [s for s in open_ if share * w[s] > cap * sizes[s]]
        if not full:
            return out | {s: share * w[s] for s in open_}
        for s in full:
            out[s] = float(cap * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def test_mixing(spark, sf_dir, docs):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "one two", "en", None, 7), (10**6 + 1, None, "en", "zz", 0), (None, "a " * 50, "en", "Ä", 9)], df.schema)
    df = df.unionByName(extra)
    own = {(r.doc_id, r.source): len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in df.collect()}
    sizes = collections.Counter()
    for (_, s), n in own.items():
        sizes[s] += n
    want = slow_targets(dict(sizes))
    source = {k[0]: k[1] for k in own}
    got = mixing.plan(df).collect()
    again = mixing.plan(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.size == own[r.doc_id, s] and r.source_size == sizes[s] and abs(r.target - want[s]) <= 1e-6 * max(1, want[s])
        assert r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(60, 0.03 * want[s]) for s in sizes if sizes[s] > 500)
    mixed = mixing.sample(df)
    assert mixed.columns == df.columns
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({r.doc_id: r.times for r in got if r.times})
    assert mixing.sample(docs).columns == docs.columns and mixing.sample(docs).count() == sum(r.times for r in mixing.plan(docs).collect())
    assert mixing.plan(spark.createDataFrame([], EMPTY)).count() == 0


def test_licenses(spark, docs):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n"
    end = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
    cases = [(1, mit + end, "MIT"), (2, mit, ""), (3, "Text.\nReleased under the MIT License.\nMore", "MIT"), (4, "All rights reserved. Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0,proprietary"), (5, None, ""), (6, "the MIT License is nice", "")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string")).collect()}
    assert {i: r.licenses for i, r in got.items()} == {c[0]: c[2] for c in cases}
    assert got[2].sentence_ids == "MIT-3,MIT-4"
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(docs.limit(0)).count() == 0


PUBLISHED = {
    "MIT": """MIT License

Copyright (c) 2020 A Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
}


PUBLISHED["BSD-3-Clause"] = PUBLISHED["BSD-2-Clause"] + """

3. Neither the name of Example Holdings Inc. nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""
PUBLISHED["X11"] = PUBLISHED["MIT"] + """

Except as contained in this notice, the name of the X Consortium shall not be
used in advertising or otherwise to promote the sale, use or other dealings in
this Software without prior written authorization from the X Consortium."""
PUBLISHED |= {
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0""",
    "BSL-1.0": """Distributed under the Boost Software License, Version 1.0.
(See accompanying file LICENSE_1_0.txt or copy at
https://www.boost.org/LICENSE_1_0.txt)""",
    "EPL-2.0": """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "CC-BY-NC-SA-4.0": """This work is licensed under a Creative Commons
Attribution-NonCommercial-ShareAlike 4.0 International License.""",
}


def test_published_licenses(spark):
    """Bare, behind comment signs, and with the line ends of other systems."""
    forms = [lambda t: t, lambda t: "/*\n" + "\n".join(" * " + x for x in t.split("\n")) + "\n */", lambda t: "\n".join("# " + x for x in t.split("\n")), lambda t: "\n".join("// " + x for x in t.split("\n")), lambda t: t.replace("\n", "\r\n")]
    cases = [(name, f(t)) for name, t in PUBLISHED.items() for f in forms]
    cases += [("MIT", "This project is licensed under the MIT License."), ("", "This project is not licensed under the MIT License."), ("", "Licensed under\n\nthe MIT license"), ("MIT", "A title\n# licensed under the MIT license\n# and a comment")]
    cases += [("Apache-2.0,MIT", "// SPDX-License-Identifier: (MIT OR Apache-2.0)\nint x;"), ("GPL-2.0-or-later", "# SPDX-License-Identifier: GPL-2.0-or-later"), ("MPL-2.0", "Released under the Mozilla Public License 2.0.")]
    cases += [("BSD-2-Clause,BSD-3-Clause", PUBLISHED["BSD-3-Clause"] + "\n\n" + PUBLISHED["BSD-2-Clause"]), ("ISC,MIT", PUBLISHED["ISC"] + "\n\n" + PUBLISHED["MIT"])]
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.licenses, t[:60]) for r, (_, t) in zip(got, cases)] == [(name, t[:60]) for name, t in cases]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var x="<p>no</p>";</script></head><body><header><p>Site, with a slogan. Nice.</p></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice">We use cookies, as all do. Accept them, please.</div>
<div id="main-col"><article><h1>Big &amp; small</h1><p>First paragraph, with <b>bold</b> words;
and a second line.<p>Second paragraph: it is long enough, and has marks, too.<br>After the break.<ul><li>one item</li><li>two items</li></ul><blockquote>Said &eacute;mile, once.</blockquote>
<form><label>Mail</label><input><button>Go</button></form><div class="share-buttons">Share this, now.</div></article>
<aside>Related, and more. Read it.</aside><section class="comments"><article class="comment"><p>Reader says, it is good. Very good, indeed, and long.</p></article></section></div>
<footer>&copy; Owner, all rights. Imprint.</footer></body></html>"""


def test_main_text(spark):
    want = ["Big & small", "First paragraph, with bold words; and a second line.", "Second paragraph: it is long enough, and has marks, too. After the break.", "one item", "two items", "Said émile, once."]
    assert html_text.main_text(PAGE).split("\n\n") == want
    for odd in (None, "", "   ", "<", "<p", "<!--", "<p title=\"" + '"' * 5000, "&am", "<script>", "</div></p>", "<nav>x</nav>"):
        html_text.main_text(odd)
    assert html_text.main_text("<p>just one</p>") == "just one" and html_text.main_text("<html><body><article><p>cut of</arti") == "cut of"
    df = spark.createDataFrame([(1, "u", PAGE), (None, None, None), (1, "u", PAGE)], "page_id long, url string, html string")
    got = html_text.extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, len("\n\n".join(want)), len("\n\n".join(want))]
    assert html_text.extract(df.limit(0)).count() == 0


def test_main_text_of_long_and_wrapped_articles():
    long = "".join(f"<p>Paragraph {i} of the body, which is long, and has marks, too; it goes on, for a while.</p>" for i in range(40))
    lede = "<h1>Headline</h1><p>The lede, which says it all, is one sentence.</p>"
    for body in (long, long * 5):
        got = html_text.main_text(f"<body><article>{lede}<div class=body>{body}</div></article></body>").split("\n\n")
        assert got[:2] == ["Headline", "The lede, which says it all, is one sentence."] and len(got) == 2 + body.count("<p>")
        got = html_text.main_text(f"<body><div><section><p>A short section, of one sentence, first.</p></section><section>{body}</section></div></body>").split("\n\n")
        assert got[0] == "A short section, of one sentence, first." and len(got) == 1 + body.count("<p>")
    rest = "<div>Some line, elsewhere.</div><section class=comments><p>A reader says, it is good.</p></section>"
    for wrap in ("<div id='content-sidebar-wrap'>{}</div>", "<div class='post comments-open'>{}</div>", "<div id='content-sidebar-wrap'><article class='post comments-open'>{}</article></div>"):
        got = html_text.main_text("<body>" + wrap.format(lede + long) + rest + "</body>")
        assert got.startswith("Headline\n\nThe lede") and "Paragraph 39" in got and "reader" not in got
    assert "reader" not in html_text.main_text("<body><article>" + lede + "</article><section class=comments><article class=comment><p>" + "A reader says, it is good. " * 99 + "</p></article></section></body>")


def test_pages_of_the_test_data(spark, sf_dir):
    import html

    def plain(h):
        m = re.search(r"<article>(.*?)(</article>|\Z)", h or "", re.S)
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", m[1]) if m else []
        texts = [" ".join(html.unescape(re.sub(r"<(?:[^>]*>|[a-z/!]?[^>]*\Z)", "", x.replace("<br>", " "))).split()) for x in parts]
        return "\n\n".join(t for t in texts if t)

    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got == {r.page_id: plain(r.html) for r in df.collect()}


LEDE = "The first sentence of it stands here, with a comma. The second one follows, as it should, and ends. "
PROSE = "".join(f"<p>{LEDE * 3}</p>" for _ in range(5))
PLAIN = "\n\n".join([" ".join((LEDE * 3).split())] * 5)
LINK_LIST = "".join(f"<p><a href=/x{i}>Link number {i} to go</a></p>" for i in range(12))


@pytest.mark.parametrize(
    "page,want",
    [
        (f'<body><div class="page has-sidebar"><article>{PROSE}</article><div class=sidebar>{LINK_LIST}</div></div></body>', PLAIN),
        (f'<body><article class="post no-comments">{PROSE}</article></body>', PLAIN),
        (f'<body><form id="aspnetForm"><div>{PROSE}</div></form></body>', PLAIN),
        (f'<body><div><div class=c1>{PROSE}</div><div class="c9">{LINK_LIST}</div></div></body>', PLAIN),
        (f'<body><article>{PROSE}<div class="c9">{LINK_LIST}</div></article></body>', PLAIN),
        (f'<body><div class=c1>{PROSE}<div class="c9">{LINK_LIST}</div>{PROSE}</div></body>', PLAIN + "\n\n" + PLAIN),
        (f"<body><div>Site</div><h1>T</h1>{PROSE}<div>Copyright 2020 Owner</div></body>", "T\n\n" + PLAIN),
        (f"<body><article>{PROSE}<ul><li>one</li><li>two</li></ul></article></body>", PLAIN + "\n\none\n\ntwo"),
        (f"<table><tr><td>{LINK_LIST}</td><td>{PROSE}</td></tr></table>", PLAIN),
        (f'<body><div class=sidebar><article>{PROSE}</article></div><p>x y</p></body>', PLAIN),
        (f"<body><nav>{LINK_LIST}</nav></body>", ""),
        (f"<body>{PROSE}{PROSE}</body>", PLAIN + "\n\n" + PLAIN),
    ],
)
def test_paths_decide_and_not_names(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("part", ["<div>", "<a x", '<a x="', "<p><li><x-y>", "<div></p>", "<div class=sidebar>", "<!--", "</", "<div class=ad><article>", "<p>a"])
def test_broken_pages_take_linear_time(part):
    import time

    def took(n):
        best = 9.0
        for _ in range(2):
            t = time.process_time()
            html_text.main_text(part * n + "x, y. z")
            best = min(best, time.process_time() - t)
        return best

    assert took(40_000) < 0.2 + 10 * took(8_000)
    assert html_text.main_text("<article><p>" + "<b" * 1000 + "<p>end.") in ("end.", "")


def test_pages_with_odd_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>a.</p>", 5, "t")], "page_id long, url string, html string, n_chars int, text string")
    assert [tuple(r) for r in html_text.extract(df).collect()] == [(1, "u", "a.", 2)]
