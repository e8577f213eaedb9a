"""Hand-worked cases, brute force and properties of the operators."""

import itertools
import math
import random
import sqlite3

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom import frames
from factloom.functions import text as T
from factloom.operators import bandit, export, graph, lifecycle, promotion, ranking, scoring, sets
from factloom.plans import graph_queries, ranking_queries, text_queries
from factloom.streaming import observers as O
from factloom.streaming import promoter


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_notation(spark):
    parts = {k: one(spark, " C[api]: no breaking changes ", lambda c, k=k: T.notation(c)[k]) for k in ("type", "target", "content", "rate")}
    assert parts == {"type": "C", "target": "api", "content": "no breaking changes", "rate": 0.3}
    assert one(spark, "plain text", lambda c: T.notation(c)["target"]) == "general"
    assert one(spark, "✓[a]: b", lambda c: T.notation(c)["type"]) == "done"


def test_slug_and_null(spark):
    assert one(spark, "The quick brown fox is here", T.slug) == "quick-brown-fox"
    assert one(spark, "", T.slug) == "general"
    assert one(spark, None, T.slug) == "general"
    assert one(spark, None, T.category) == "factual"
    assert one(spark, None, T.factuality) == one(spark, "", T.factuality)


def test_bm25_equals_fts5(spark):
    random.seed(5)
    vocabulary = "port ports server database db deploy cache queue auth token release build".split()
    docs = [(i, " ".join(random.choices(vocabulary, k=random.randint(3, 12))), random.choice(["api", "queue", "general"])) for i in range(40)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(content, target)")
    con.executemany("INSERT INTO f(rowid, content, target) VALUES (?, ?, ?)", docs)
    facts = spark.createDataFrame([(i, f"{c} {t}", True) for i, c, t in docs], "id long, text string, allowed boolean")
    for n, query in enumerate(["port server", "release queue", "tokens", "dep"]):
        q = spark.createDataFrame([(n, query)], "query_id long, query string")
        terms = sorted(q.select(T.terms(F.col("query")).alias("t")).first()["t"])
        want = dict(con.execute("SELECT rowid, -rank FROM f WHERE f MATCH ? ORDER BY rank LIMIT 50", (" OR ".join(f"{t}*" for t in terms),)).fetchall())
        got = {r["id"]: r["bm25"] for r in ranking.bm25(facts, q).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_fusion_turns_rank_only_from_the_last_negative_backwards(spark):
    rows = [(0, 0, 0, 5.0, 0.0), (0, 1, 1, -1.0, 2.0), (0, 2, 2, 3.0, 1.0)]
    got = {r["id"]: (r["negative"], r["rrf"]) for r in ranking.fuse(spark.createDataFrame(rows, "query_id int, id int, row_seq int, score double, bm25 double")).collect()}
    assert [got[i][0] for i in range(3)] == [True, True, False]
    assert math.isclose(got[2][1], 0.92 * 3.0 / 62 + 0.08 * 1.0 / 62)


def test_diversity_is_a_choice_of_the_pool(spark):
    rng = np.random.default_rng(1)
    rows = [(q, i, i, float(rng.random()), rng.random(4).tolist(), [f"w{i % 3}"]) for q in range(2) for i in range(30)]
    df = spark.createDataFrame(rows, "query_id int, id int, row_seq int, score double, embedding array<double>, tokens array<string>")
    got = ranking.diversify(df).collect()
    for q in range(2):
        pool = {r[1] for r in sorted((r for r in rows if r[0] == q), key=lambda r: -r[3])[:12]}
        mine = [r for r in got if r["query_id"] == q]
        assert len(mine) == 8 and {r["id"] for r in mine} <= pool and max(r["score"] for r in mine) == max(r[3] for r in rows if r[0] == q)


def test_reward_ema_is_a_fold_in_order(spark):
    rows = [(1, 3, 1.0, 4), (1, 1, 0.0, 1), (1, 2, 1.0, 1), (2, 1, -9.0, 1)]
    got = {r["id"]: r["q"] for r in ranking.reward_ema(spark.createDataFrame(rows, "id int, seq int, signal double, n_retrieved int")).collect()}
    q = 0.5
    for s in (0.0, 1.0, 0.5):
        q = q + 0.1 * (s - q)
    assert math.isclose(got[1], q) and got[2] == 0.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=25))
def test_cut_vertices_against_removal(pairs):
    edges = {(min(a, b), max(a, b)) for a, b in pairs if a != b}

    def parts(without=None):
        nodes = {n for e in edges for n in e} - {without}
        left, n = set(nodes), 0
        while left:
            n += 1
            todo = [left.pop()]
            while todo:
                x = todo.pop()
                for a, b in edges:
                    y = b if a == x else a if b == x else None
                    if y in left:
                        left.discard(y)
                        todo.append(y)
        return n

    whole = parts()
    want = {n for n in {n for e in edges for n in e} if parts(n) > whole}
    assert graph.cut_vertices(sorted(edges)) == want


def test_articulation_points_in_frames(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (8, 9)], "source_id long, target_id long")
    assert {r["id"] for r in graph.articulation_points(e).collect()} == {3, 4}


def test_articulation_points_of_a_forest(spark):
    """Many components of every shape, a path and loops among them; no component goes to one task as a group."""
    rng = random.Random(3)
    edges = [(40 * k + rng.randrange(12), 40 * k + rng.randrange(12)) for k in range(25) for _ in range(rng.randint(1, 20))]
    edges += [(2000 + i, 2001 + i) for i in range(9)] + [(5000, 5000 + i) for i in range(1, 40)]
    got = graph.articulation_points(spark.createDataFrame(edges, "source_id long, target_id long"))
    assert sorted(r["id"] for r in got.collect()) == sorted(graph.cut_vertices(sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})))
    assert "InPandas" not in got._jdf.queryExecution().toString()


def test_articulation_points_query_takes_all_links(spark, tmp_path):
    """Parts that met once are links as well."""
    lines = [(1, 1), (1, 2), (2, 2), (2, 3), (3, 4), (3, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [r["id"] for r in graph_queries.articulation_points(spark, str(tmp_path)).collect()] == [2]


def test_similar_sets_against_all_pairs(spark):
    random.seed(9)
    sets = [(i, random.sample("abcdefghijkl", random.randint(0, 9))) for i in range(80)] + [(90 + i, list("abcde")) for i in range(5)]
    for limit in (0.4, 0.8, 1.0):
        want = {(a, b) for a, x in sets for b, y in sets if a > b and x and y and len(set(x) & set(y)) >= limit * len(set(x) | set(y)) - 1e-12}
        got = {(r["a"], r["b"]) for r in graph.similar_sets(spark.createDataFrame(sets, "id int, tokens array<string>"), limit).collect()}
        assert got == want


def test_near_duplicates_of_documents_from_four_tenths(spark, tmp_path):
    texts = ["a b c d e f g h", "a b c d E f x y", "a b c d x z w v", "A b  c d e f g h", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["a"], r["b"]): r["jaccard"] for r in graph_queries.QUERIES["near_dup_documents"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): 0.6, (3, 0): 1.0, (3, 1): 0.6, (2, 1): 0.454545}


def test_coupling_of_all_facts(spark, sf_dir):
    words = {r["id"]: {t for t in r["tokens"] if len(t) > 3} for r in graph_queries._tokens(spark, sf_dir).collect()}
    want = {(a, b) for a, x in words.items() for b, y in words.items() if a > b and x and y and len(x & y) / math.sqrt(len(x) * len(y)) > 0.3}
    got = {(r["source_id"], r["target_id"]) for r in graph_queries.QUERIES["bibliographic_facts"](spark, sf_dir).collect()}
    assert got == want and len(words) >= 200


def test_parts_of_texts_do_not_pass_through_the_driver(spark, sf_dir):
    """A file below the limit of broadcasts holds millions of texts; what is made of them is many times the file."""
    assert "BroadcastHashJoin" not in text_queries.QUERIES["contradiction_score"](spark, sf_dir)._jdf.queryExecution().toString()


def test_tokens_do_not_pass_through_the_driver(spark, sf_dir):
    assert "BroadcastHashJoin" not in graph_queries.QUERIES["keyword_links"](spark, sf_dir)._jdf.queryExecution().toString()


def test_links_of_some_parts_alone(spark, sf_dir):
    """Recall pairs only the orders of parts that it can return; their links are those of the whole."""
    some = spark.range(0, 200, 7)
    whole = {tuple(r) for r in ranking_queries._links(spark, sf_dir).collect() if r["source_id"] % 7 == 0}
    assert {tuple(r) for r in ranking_queries._links(spark, sf_dir, some).collect()} == whole and len(whole) > 100


def test_npmi_bounds(spark):
    rows = [(a / 10, b / 10, c / 10) for a, b, c in itertools.product(range(0, 11), repeat=3) if a <= b and a <= c]
    got = spark.createDataFrame(rows, "ab double, a double, b double").select(graph.npmi(F.col("ab"), F.col("a"), F.col("b")).alias("v")).collect()
    assert all(-1.0 <= r["v"] <= 1.0 for r in got)


def test_promotion_is_idempotent(spark, sf_dir):
    from factloom.plans.views import NOW, spark_view

    once = promotion.promote(spark_view(spark, sf_dir, "pending"), NOW)
    assert promotion.metrics(once, promotion.promote(once, NOW)).count() == 0


def test_latest_of_a_key_wins_and_ties_go_to_the_later_row(spark):
    rows = [(1, 1, "V", "t", "s", "observed", "provisional", 5.0), (2, 2, "V", "t", "s", "observed", "provisional", 5.0), (3, 3, "V", "t", "z", "agent_inference", "provisional", 5.0)]
    df = spark.createDataFrame(rows, "id int, row_seq int, type string, target string, session_id string, source string, status string, updated_at double")
    assert {r["id"]: r["status"] for r in promotion.promote(df, 605.0).collect()} == {1: "retracted", 2: "promoted", 3: "provisional"}
    assert {r["id"]: r["status"] for r in promotion.promote(df, 606.0).collect()}[3] == "promoted"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3)), min_size=1, max_size=12))
def test_write_fold_matches_the_set_form(spark, writes):
    """Where no text is shared between keys, latest-wins by runs of equal text is the one-by-one write."""
    log = [(f"k{k}", f"k{k}-{v}", "V") for k, v in writes]
    inserted, gone = lifecycle.write_log(log)
    want = []
    last: dict[str, str] = {}
    for i, (k, h, _) in enumerate(log):
        if last.get(k) != h:
            want.append(i)
        last[k] = h
    assert inserted == want
    assert set(gone) == {i for i in want if any(j > i and log[j][0] == log[i][0] for j in want)}


def test_explore_without_links(spark):
    links = spark.createDataFrame([], "source_id long, target_id long, strength double")
    got = graph.explore(links, spark.createDataFrame([(1, 2.0)], "id long, seed double"), rounds=3).collect()
    assert len(got) == 1 and math.isclose(got[0]["s"], 0.45)


def test_linucb_solve(spark):
    rng = np.random.default_rng(3)
    rows = [("a", *map(float, rng.random(3)), float(rng.random())) for _ in range(50)]
    df = spark.createDataFrame(rows, "arm string, f0 double, f1 double, f2 double, reward double")
    got = bandit.solve(bandit.statistics(df, ["f0", "f1", "f2"]), 3).first()
    x, r = np.array([t[1:4] for t in rows]), np.array([t[4] for t in rows])
    a = np.eye(3) + x.T @ x
    assert np.allclose(got["theta"], np.linalg.solve(a, x.T @ r)) and math.isclose(got["bonus"], math.sqrt(np.ones(3) @ np.linalg.solve(a, np.ones(3))), rel_tol=1e-9)


def ev(spark, kind, **payload):
    base = spark.range(1).select(*[F.lit(v).alias(k) for k, v in payload.items()] or [F.lit(0).alias("z")])
    return base.select(*O.event(kind, F.lit("s1"), F.lit(1.0), **{k: F.col(k) for k in payload}))


def test_observers(spark):
    def got(f, kind, **p):
        return [r["content"] for r in f(ev(spark, kind, **p)).collect()]

    assert got(O.test_failures, "tool_result", tool="pytest", exit_code=0, stdout="FAILED x") == []
    assert got(O.test_failures, "tool_result", tool="pytest", exit_code=1, stdout="boom") == []
    assert len(got(O.test_failures, "tool_result", tool="pytest", exit_code=1, stdout="FAILED a.py::b - no")) == 2
    assert got(O.version_control, "tool_result", tool="git", command="git push origin main", exit_code=1, stderr="! [rejected]") == ["push to main rejected: ! [rejected]"]
    assert got(O.user_statements, "user_message", content="why is it so") == []
    assert got(O.user_statements, "user_message", content="I prefer tabs.") == ["user prefers: tabs"]
    lines = "error here\nhttps://a.example/x.\n" + "x\n" * 8 + "https://far.example/y"
    assert got(O.error_context, "tool_result", output=lines) == ["?[error]: error here", "V[url]: https://a.example/x", "V[file]: //a.example"]
    assert got(O.memory_writes, "memory_write", action="delete", content="x") == []
    assert got(O.user_content, "user_message", content="see /a.b") == []


def test_stream_equals_batch(spark, sf_dir):
    from factloom.plans import stream_queries as q
    from factloom.plans.views import NOW

    got = {(r["status"], r["type"]): r["n"] for r in q.stream_promote(spark, sf_dir).collect()}
    facts = O.user_statements(q.user_events(q._rows(spark, sf_dir)))
    batch = promotion.promote(promoter.pending_of(facts).dropDuplicates(["id"]), NOW)
    assert sum(got.values()) == batch.count()


def test_training_pairs_order_and_kinds(spark):
    facts = spark.createDataFrame([(1, "fact", 0.9, 2, 1)], "id int, content string, q_value double, access_count int, row_seq int")
    ix = spark.createDataFrame([(1, "q1", "a", True, [1]), (2, "q2", "b", False, [1, 7])], "ix int, query string, scope string, followed_by_store boolean, recalled_ids array<int>")
    got = [(r["pair_type"], r["input"]) for r in export.training_pairs(facts, ix).collect()]
    assert got == [("cross_context", "[a] q1 → fact | [b] q2 → fact"), ("fact_recall", "q1"), ("task_completion", "q1"), ("fact_recall", "q2")]


def test_source_config(spark):
    raw = spark.createDataFrame([('{"base_url": "u0", "hosts": {"h": {"base_url": "u1"}}}',)], "json string")
    r = export.source_config(raw, "h", {"api_key": "k"}).first()
    assert (r["base_url"], r["api_key"]) == ("u1", "k")


def test_ranks_spread_a_group_over_tasks(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2]), i, float(rng.randrange(5))) for i in range(500)]
    x = frames.materialize(spark.createDataFrame(rows, "query_id int, row_seq int, score double"))
    got = {(r.query_id, r.row_seq): r.place for r in frames.ranks(x, "query_id", [F.desc("score"), F.col("row_seq")], "place").collect()}
    for q in (1, 2):
        order = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        assert [got[q, r[1]] for r in order] == list(range(len(order)))
    assert frames.ranks(x.limit(0), "query_id", [F.col("row_seq")], "place").count() == 0


def test_attach_with_and_without_sending_everywhere(spark, monkeypatch):
    x, few = spark.range(50).withColumn("k", F.col("id") % 5), spark.range(4).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    small = sorted(map(tuple, frames.attach(x, few, "k", "left").collect()), key=str)
    monkeypatch.setattr(frames, "BROADCAST_ROWS", 2)
    assert sorted(map(tuple, frames.attach(x, few, "k", "left").collect()), key=str) == small and len(small) == 50


def test_questions_asked_twice_are_answered_twice(spark):
    facts = spark.createDataFrame([(i, t, True) for i, t in enumerate(["port of the api", "red widget", "api gateway port"])], "id long, text string, allowed boolean")
    asked = spark.createDataFrame([(1, "api port"), (2, "port, api?"), (3, "nothing of it"), (4, None)], "query_id long, query string")
    got = {}
    for r in ranking.bm25(facts, asked).collect():
        got.setdefault(r.query_id, {})[r.id] = r.bm25
    assert got[1] == got[2] and set(got) == {1, 2} and set(got[1]) == {0, 2}
    assert ranking.bm25(facts, asked.limit(0)).count() == 0 and ranking.bm25(facts.limit(0), asked).count() == 0


def test_similar_sets_against_all_pairs(spark):
    rng = random.Random(9)
    sets = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 2) for _ in range(rng.randint(0, 14))] for _ in range(120)]
    sets += [sets[5]] * 4 + [list("abcdefgh"), list("abcdefghi"), None]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>")
    for measure, threshold in (("jaccard", 0.8), ("jaccard", 0.4), ("cosine", 0.3)):
        want = {}
        for i, a in enumerate(sets):
            for j in range(i):
                x, y = set(a or ()), set(sets[j] or ())
                if x and y:
                    sim = len(x & y) / (len(x | y) if measure == "jaccard" else math.sqrt(len(x) * len(y)))
                    if sim >= threshold:
                        want[i, j] = round(sim, 9)
        assert {(r.a, r.b): round(r.sim, 9) for r in graph.similar_sets(df, threshold, measure).collect()} == want
    assert graph.similar_sets(df.limit(0), 0.8).count() == 0


def test_components_of_hubs_and_paths(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)] + [(500, 600 + i) for i in range(700)] + [(900 + i, 901 + i) for i in range(40)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    df = spark.createDataFrame([*edges, (None, 3)], "source_id long, target_id long")
    assert {r.id: r.component for r in graph.components(df).collect()} == want
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 5)
    assert {r.id: r.component for r in graph.components(df).collect()} == want
    assert graph.components(df.limit(0)).count() == 0


def test_temporal_links_across_spans(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), round(rng.random() * 2000, 3), i) for i in range(150)]
    want = {}
    for s in "ab":
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[3]))
        for n, r in enumerate(own):
            for k in range(4):
                if n - k - 1 >= 0:
                    w = 0.28 * 0.85**k * math.exp(-(r[2] - own[n - k - 1][2]) / 120)
                    if w > 0.02:
                        want[r[0], own[n - k - 1][0]] = round(w, 9)
    df = spark.createDataFrame(rows, "id long, scope_id string, created_at double, row_seq long")
    assert {(r.source_id, r.target_id): round(r.strength, 9) for r in graph.temporal_links(df).collect()} == want


def test_a_stream_goes_on_after_a_stop(spark, tmp_path):
    """A second run with the same checkpoint takes the new files alone and continues the store."""
    def said(n, user, name):
        spark.createDataFrame([(user, float(n), f"I always run pytest before step {n}.")], "user string, secs double, said string").select(*O.event("user_message", F.col("user"), F.col("secs"), content=F.col("said"))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    said(1, "u", "a")
    store = promoter.PendingStore(spark, f"file://{tmp_path}/store")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    for n in (2, 3):
        facts = O.user_statements(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        promoter.promote_stream(facts, store, 1e6, f"file://{tmp_path}/progress").awaitTermination()
        said(n, "u", "b")
    assert store.read().count() == 2


def test_pairs_of_sets_that_are_not_similar_are_not_written(spark, monkeypatch):
    """Large sets that share a third of their tokens look alike to small bitmaps; only similar ones may leave the tasks they meet in."""
    rng = random.Random(4)
    lists = [[f"t{x}" for x in rng.sample(range(600), 300)] for _ in range(90)]
    lists += [x[:250] + [f"n{i}{j}" for j in range(20)] for i, x in enumerate(lists[:20])]
    written = []
    for where in (graph, sets):
        monkeypatch.setattr(where, "materialize", lambda df, name="frame", f=where.materialize: written.append(f(df, name)) or written[-1])
    monkeypatch.setattr(sets, "SETS", 40)
    want = {(i, j) for i, a in enumerate(lists) for j in range(i) if len(set(a) & set(lists[j])) >= 0.4 * len(set(a) | set(lists[j]))}
    got = graph.similar_sets(spark.createDataFrame(list(enumerate(lists)), "id long, tokens array<string>"), 0.4)
    assert {(r.a, r.b) for r in got.collect()} == want and 20 <= len(want) < 400
    assert all(x.count() <= len(want) for x in written if {"k", "k2"} <= set(x.columns))


@pytest.mark.parametrize("measure, threshold", [("jaccard", 0.4), ("cosine", 0.3), ("cosine", 0.8)])
def test_blocks_of_sets_against_all_pairs(measure, threshold, monkeypatch):
    """Over several tiles, and with shared columns."""
    rng = np.random.default_rng(6)
    for name, value in (("LEFT", 16), ("RIGHT", 32), ("COLUMNS", 256), ("CELLS", 256 * 24)):
        monkeypatch.setattr(sets, name, value)
    zipf = 1 / np.arange(1, 2001)
    made = [np.sort(rng.choice(2000, rng.integers(3, 300), False, zipf / zipf.sum())) for _ in range(150)]
    made += [np.unique(np.r_[x[5:], rng.integers(0, 2000, 9)]) for x in made[:60]]

    def block(at):
        b = object.__new__(sets._Block)
        b.no, b.k, b.m = at[0], np.array(at), np.array([len(made[i]) for i in at], np.int32)
        b.tokens, inv = np.unique(np.concatenate([made[i] for i in at]), return_inverse=True)
        b.n, b.who = np.bincount(inv).astype(np.int32), np.repeat(np.arange(len(at)), b.m).astype(np.uint16)[np.argsort(inv, kind="stable")]
        return b

    left, right = block(list(range(0, 210, 2))), block(list(range(1, 210, 2)))
    rows = [x for a, b in ((left, left), (left, right), (right, right)) for r in sets._pairs(a, b, threshold, measure) for x in r.to_pylist()]
    got = {(min(x["k"], x["k2"]), max(x["k"], x["k2"])): x["shared"] for x in rows}
    want = {}
    for i, a in enumerate(made):
        for j in range(i + 1, len(made)):
            n = len(np.intersect1d(a, made[j]))
            if n / (len(a) + len(made[j]) - n if measure == "jaccard" else math.sqrt(len(a) * len(made[j]))) >= threshold:
                want[i, j] = n
    assert got == want and len(rows) == len(got) and len(want) > 40


def test_features_are_worked_out_once_for_each_text(spark, monkeypatch):
    """Copies of a text, nulls among them, cost one evaluation and keep their rows."""
    seen = []
    monkeypatch.setattr(scoring, "fact_features", lambda x, f=scoring.fact_features: seen.append(x.count()) or f(x))
    rows = [(i, ["run pip install pkg", "we decided on x", None][i % 3], "general", "V") for i in range(30)]
    facts = spark.createDataFrame(rows, "id long, content string, target string, type string")
    got = scoring.features_once(facts)
    assert seen == [3] and got.count() == 30
    names = ["id", "adv", "own_terms", "text_flags", "settled"]
    plain = scoring.fact_features(facts).select(*names)
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, plain.collect()))
