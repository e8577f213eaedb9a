"""Write path, recall, state snapshots, and small functions."""

import pytest
from pyspark.sql import functions as F

from factloom.config import Config
from factloom.functions import text as T
from factloom.operators import bandit, lifecycle, memory
from factloom.schemas import STATE
from factloom.sources.state import State

NOW = 1_700_000_000.0


def test_unknown_profile():
    assert Config.profile().top_k == 8
    with pytest.raises(ValueError):
        Config.profile("fast")


def test_store_supersedes_and_drops_copies(spark):
    facts = spark.createDataFrame([], STATE["facts"])
    first = spark.createDataFrame([(1, "C[api]: use v1", "s"), (2, "C[api]: use v1", "s"), (3, "plain text here", "s")], "row_seq long, raw string, scope_id string")
    one = memory.store(first, facts, NOW)
    assert {(r.row_seq, r.status) for r in one.collect()} == {(1, "active"), (3, "active")}
    second = spark.createDataFrame([(4, "C[api]: use v2", "s"), (5, "plain text here", "t")], "row_seq long, raw string, scope_id string")
    two = memory.store(second, one, NOW + 5)
    assert {(r.row_seq, r.status) for r in two.collect()} == {(1, "superseded"), (3, "active"), (4, "active")}


def snapshot(spark):
    rows = [(i, i, c, [float(i == 0), 1.0, float(i)], k, t, None, "active", 1.0, 0.5, i, "factual", NOW - 1000 * i) for i, (c, k, t) in enumerate([("the port is 8080", "V", "api"), ("deploy on friday", "C", "general"), ("widgets are red", "V", "general"), ("the queue is slow", "V", "queue")])]
    return spark.createDataFrame(rows, "id long, row_seq long, content string, embedding array<float>, type string, target string, scope_id string, status string, metabolic_rate double, importance double, access_count int, category string, created_at double")


def test_recall_finds_the_fact_and_writes_nothing(spark):
    facts = snapshot(spark)
    access = spark.createDataFrame([(0, NOW - 50.0), (2, NOW - 90_000.0)], "fact_id long, seen_at double")
    links = spark.createDataFrame([(0, 3, 0.5, NOW - 86400.0)], "source_id long, target_id long, strength double, last_updated double")
    queries = spark.createDataFrame([(100, "what is the port of the api?", None, [1.0, 1.0, 0.0])], "query_id long, query string, query_scope string, embedding array<float>")
    results, uses, pairs = memory.recall(queries, facts, access, links, NOW)
    got = results.orderBy("rank").collect()
    assert got[0]["id"] == 0 and len(got) == 4
    assert uses.count() == 4 and pairs.where("place = 1").count() == 1
    wide = links.union(spark.createDataFrame([(3, 9, 0.9, NOW), (9, 8, 0.9, NOW)], links.schema))
    more = facts.select("id", "status").union(spark.createDataFrame([(9, "cold"), (8, "superseded")], "id long, status string"))
    found = {r["id"]: r for r in memory.explore(results, wide, more).collect()}
    assert set(found) == {0, 1, 2, 3, 9} and found[9]["discovered"] and not found[3]["discovered"]
    first = {r["id"]: r["score"] for r in results.collect()}
    assert found[3]["score"] > first[3]
    assert {r["id"] for r in memory.explore(results, links.limit(0), more).collect()} == {0, 1, 2, 3}


def test_near_copies_and_contradictions(spark):
    old = spark.createDataFrame([(1, 1, "the api uses Redis 6.0 for sessions", [1.0, 0.0]), (2, 2, "cats sleep", [0.0, 1.0])], "id_long long, row_seq long, content string, embedding array<float>")
    new = spark.createDataFrame([(10, 10, "the api uses Redis 6.0 for all sessions", [1.0, 0.01]), (11, 11, "Migrated from Redis 6.0 to Postgres", [1.0, 0.1])], "id_long long, row_seq long, content string, embedding array<float>")
    assert {r.id for r in memory.near_copies(new, old).collect()} == {10}
    assert {r.id for r in memory.contradicted(new.where("id_long = 11"), old).collect()} == {1}


def test_no_close_vector_falls_out_of_copies_and_contradictions(spark):
    """More close vectors than any fixed number, and nearer ones of another scope, before the fact that counts."""
    kind = "id_long long, row_seq long, content string, embedding array<float>, scope_id string"
    old = [(1, 1, "the api uses Redis 6.0 for sessions", [1.0, 0.2], "s")] + [(i, i, f"cats {i} sleep", [1.0, 0.1], "s") for i in range(2, 90)]
    old += [(i, i, "the api uses Redis 6.0 for sessions", [1.0, 0.1], "t") for i in range(-60, 0)]
    copy = spark.createDataFrame([(100, 100, "the api uses Redis 6.0 for all sessions", [1.0, 0.1], "s")], kind)
    back = spark.createDataFrame([(101, 101, "Migrated from Redis 6.0 to Postgres", [1.0, 0.1], "s")], kind)
    assert {r.id for r in memory.near_copies(copy, spark.createDataFrame(old[:89], kind)).collect()} == {100}
    assert {r.id for r in memory.contradicted(back, spark.createDataFrame(old, kind)).collect()} == {1}
    free = back.withColumn("scope_id", F.lit(None).cast("string"))
    assert {r.id for r in memory.contradicted(free, spark.createDataFrame(old, kind)).collect()} == {-60}


def test_state_snapshots(spark, tmp_path):
    s = State(spark, f"file://{tmp_path}/state")
    assert s.read("facts").count() == 0
    facts = memory.store(spark.createDataFrame([(1, "V[x]: y", None)], "row_seq long, raw string, scope_id string"), s.read("facts"), NOW)
    pending = spark.createDataFrame([("p", 1, "c")], "id string, row_seq long, content string")
    s.write(facts=facts, pending=pending)
    assert [r.target for r in s.read("facts").collect()] == ["x"]
    s.reset()
    assert s.read("facts").count() == 0 and s.read("pending").count() == 1


def test_small_functions(spark):
    r = spark.createDataFrame([('{"a": "1"}', "self.name", 0.0)], "j string, t string, s double").select(T.patch_json(F.col("j"), a=F.lit(2), b=F.lit("x")).alias("j"), T.is_identity(F.col("t")).alias("i"), T.show_time(F.col("s")).alias("s")).first()
    assert r["j"] == '{"a":"2","b":"x"}' and r["i"] and r["s"] == "1970-01-01 00:00:00"


def test_decide(spark):
    solved = spark.createDataFrame([("run", [1.0, 0.0]), ("skip", [0.0, 1.0])], "arm string, theta array<double>")
    x = spark.createDataFrame([(2.0, 1.0), (1.0, 2.0), (1.0, 1.0)], "a double, b double")
    assert [r["runs"] for r in bandit.decide(x, solved, ["a", "b"], "run", "skip").collect()] == [True, False, True]


def test_gauge_of_an_empty_store(spark):
    facts = snapshot(spark).withColumn("pinned", F.lit(False)).withColumn("last_accessed", F.lit(0.0)).limit(0)
    assert lifecycle.used_chars(facts).first()["used"] == 0


def test_writing_equals_the_row_by_row_fold(spark, trials=2):
    """Texts that come again after they were replaced, under their own and other keys, in one batch and in two."""
    import random

    rng = random.Random(4)
    for _ in range(trials):
        rows = [(i, rng.choice(["C", "V", "plain"]), rng.choice(["a", "b"]), rng.choice(["x", "y", "z"])) for i in range(60)]
        raw = [(i, text if kind == "plain" else f"{kind}[{target}]: {text}", "s") for i, kind, target, text in rows]
        keys = [(f"general{i}" if kind == "plain" else f"{kind}.{target}", text, kind) for i, kind, target, text in rows]
        kept, gone = lifecycle.write_log(keys)
        want = {(i, "superseded" if i in gone else "active") for i in kept}
        frame = spark.createDataFrame(raw, "row_seq long, raw string, scope_id string")
        empty = spark.createDataFrame([], STATE["facts"])
        assert {(r.row_seq, r.status) for r in memory.store(frame, empty, NOW).collect()} == want
        half = memory.store(frame.where("row_seq < 30"), empty, NOW)
        both = memory.store(frame.where("row_seq >= 30"), half, NOW + 9)
        assert {(r.row_seq, r.status) for r in both.collect()} == want
        assert memory.first_access(half, both, NOW).count() == both.count() - half.count()


def test_spans_carry_over(spark, monkeypatch):
    monkeypatch.setattr(lifecycle, "SPAN", 2)
    test_writing_equals_the_row_by_row_fold(spark, 1)


def test_the_last_of_a_key_stays(spark):
    raw = spark.createDataFrame([(1, "C[db.port]: 5432", None), (2, "C[db.port]: 5433", None), (3, "C[db.port]: 5432", None), (4, "✓[t]: one", None), (5, "✓[t]: two", None)], "row_seq long, raw string, scope_id string")
    got = {r.row_seq: (r.type, r.status) for r in memory.store(raw, spark.createDataFrame([], STATE["facts"]), NOW).collect()}
    assert got == {1: ("C", "superseded"), 2: ("C", "superseded"), 3: ("C", "active"), 4: ("V", "superseded"), 5: ("V", "active")}


def test_merged_accesses_and_last_links(spark):
    access = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "fact_id long, seen_at double")
    mapping = spark.createDataFrame([(3, 1)], "dup long, into long")
    assert sorted(map(tuple, lifecycle.merge_access(access, mapping).collect())) == [(1, 1.0), (1, 3.0), (2, 2.0)]
    from factloom.operators import graph

    links = spark.createDataFrame([(1, 2, 0.9, 1), (2, 1, 0.1, 2), (2, 3, 0.5, 3)], "source_id long, target_id long, strength double, row_seq long")
    seeds = spark.createDataFrame([(1, 1.0)], "id long, seed double")
    last = {r["id"]: r["s"] for r in graph.explore(links, seeds, 3, 0.45, "row_seq").collect()}
    most = {r["id"]: r["s"] for r in graph.explore(links, seeds, 3, 0.45).collect()}
    # node 2 pulls from 1 by 0.1 of 0.6 in the one case, by 0.9 of 1.4 in the other
    assert last[2] < most[2]


def test_a_cycle_of_consolidation(spark):
    facts = snapshot(spark).withColumns({"pinned": F.lit(False), "layer": F.lit("working"), "last_accessed": F.lit(NOW)})
    access = spark.createDataFrame([(0, NOW - 9.0), (0, NOW - 5.0), (1, NOW - 3.0)], "fact_id long, seen_at double")
    links = spark.createDataFrame([(0, 1, 0.5, 1), (1, 2, 0.5, 1), (2, 3, 0.0101, 1)], "source_id long, target_id long, strength double, co long")
    scopes = spark.createDataFrame([], "id string, status string")
    after, left = memory.consolidate(facts, access, links, scopes, NOW)
    got = {r.id: (r.pinned, r.layer) for r in after.collect()}
    assert got == {0: (False, "working"), 1: (True, "working"), 2: (True, "working"), 3: (False, "core")}
    rows = {(r.source_id, r.target_id): (round(r.strength, 6), round(r.npmi, 6)) for r in left.collect()}
    assert set(rows) == {(0, 1), (1, 2)} and rows[0, 1][0] == 0.475 and rows[1, 2][1] == 0.0


def test_access_by_text_and_by_vector(spark):
    asked = spark.createDataFrame([(1, "PORT is", [0.0, 0.0, 1.0]), (2, "nowhere", [0.0, 1.0, 3.0]), (3, "nothing", [-1.0, -1.0, 0.0])], "ask long, needle string, embedding array<float>")
    assert {r.ask: r.id for r in memory.access_by_text(snapshot(spark), asked).collect()} == {1: 0, 2: 3}


def test_links_and_pending_rows_asked_for(spark):
    import json

    from factloom.operators import graph, promotion

    links = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.4)], "source_id long, target_id long, strength double")
    assert [tuple(r) for r in graph.between(links, links.where("source_id = 2")).collect()] == [(2, 1, 0.4)]
    pending = spark.createDataFrame([(i, i, "s", "observed", "provisional", float(i)) for i in range(4)], "id long, row_seq long, session_id string, source string, status string, updated_at double")
    out = json.loads(promotion.as_json(pending, limit=3).first()["json"])
    assert out["count"] == 3 and [r["id"] for r in out["pending"]] == [3, 2, 1]
    assert json.loads(promotion.as_json(pending.limit(0)).first()["json"]) == {"pending": [], "count": 0}


def test_whole_recall_gives_degrees_apart_from_links(spark, sf_dir, monkeypatch):
    """Links are read for the candidates alone; hubs are judged by the links of all parts."""
    from factloom.plans import ranking_queries

    seen = {}
    monkeypatch.setattr(ranking_queries.memory, "recall", lambda *a, **k: seen.update(k) or (spark.createDataFrame([], "query_id long, id long, rank long, score double"), None, None))
    ranking_queries.whole_recall(spark, sf_dir)
    assert seen["degree"].columns == ["id", "degree"] and seen["degree"].count() == ranking_queries._links(spark, sf_dir).select("source_id").distinct().count()


def test_copies_are_judged_once(spark, monkeypatch):
    """Equal texts with equal vectors are one fact while pairs are made; every copy is in the result, and the first old one is taken back."""
    sizes, plain = [], memory.similarities
    monkeypatch.setattr(memory, "similarities", lambda v, q, *a, **k: sizes.append((v.count(), q.count())) or plain(v, q, *a, **k))
    kind = "id_long long, row_seq long, content string, embedding array<double>"
    old = spark.createDataFrame([(i, 9 - i, "The port is 80", [1.0, 0.0]) for i in range(5)], kind)
    new = spark.createDataFrame([(10 + i, 10 + i, "the port is 80", [1.0, 0.0]) for i in range(4)], kind)
    assert sorted(r["id"] for r in memory.near_copies(new, old).collect()) == [10, 11, 12, 13]
    assert [r["id"] for r in memory.contradicted(new, old).collect()] == [4]
    assert sizes == [(1, 1), (1, 1)]


def test_a_chain_of_replacements_takes_one_pass(spark, monkeypatch):
    """Each copy leaves a text active that makes the next row a copy; frames written must not grow with the chain."""
    rows = [(i, f"V[k{i}]: text{i}", "s") for i in range(12)] + [(20 + i, f"V[k{i + 1}]: text{i}", "s") for i in range(11)] + [(40, "V[k0]: last", "s"), (41, "V[k5]: text0", "s"), (42, "V[k6]: text5", "s")]
    raw = spark.createDataFrame(rows, "row_seq long, raw string, scope_id string")
    coded = memory.encode(raw, NOW).orderBy("row_seq").collect()
    kept, gone = lifecycle.write_log([(r.target, r.source_hash, r.type) for r in coded])
    written = []
    monkeypatch.setattr(lifecycle, "materialize", lambda df, name="frame", f=lifecycle.materialize: written.append(name) or f(df, name))
    got = {(r.row_seq, r.status) for r in memory.store(raw, spark.createDataFrame([], STATE["facts"]), NOW).collect()}
    assert got == {(coded[i].row_seq, "superseded" if i in gone else "active") for i in kept}
    assert len(written) <= 5
