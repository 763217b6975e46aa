"""Operators on small hand-made tables."""

import sqlite3

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from memlens.functions.vectors import encode
from memlens.operators import consolidation as con
from memlens.operators import mining, ranking, routing, store
from memlens.operators.hierarchy import descendants, linked, resolve_roots
from memlens.operators.references import memory_references, missing_references, parent_keys
from memlens.schemas import FEEDBACK, MEMORY

BASE = dict(
    memory_type="decision", context="c", action="a", result="r", score=0.5, indexed=True, tags=None, project=None, parent_id=None, source_ids=None, insight_type=None,
    created_at="2024-01-01T00:00:00Z", updated_at="2024-01-01T00:00:00Z", used_count=0, last_used_at=None, superseded_by=None,
)


def memories(spark, *given):
    data = [tuple({**BASE, **g}.get(f.name) for f in MEMORY) for g in given]
    return spark.createDataFrame(data, MEMORY)


def feedback(spark, *given):
    return spark.createDataFrame([tuple(g) for g in given], FEEDBACK)


# -- hierarchy and references

def test_roots_depths_paths_and_cycles(spark):
    links = [("a", None), ("b", " A"), ("c", "b "), ("d", "nowhere"), ("e", "f"), ("f", "e"), ("g", "e"), ("h", "h"), ("i", " "), ("j", "c")]
    df = spark.createDataFrame(links, "id string, parent_id string").selectExpr("*", "1 as depth", "'x' as key", "'y' as anc")
    edges = linked(df, "parent_id")
    assert rows(resolve_roots(edges)) == [("b", "a", 1), ("c", "a", 2), ("e", "cycle", -1), ("f", "cycle", -1), ("g", "cycle", -1), ("h", "cycle", -1), ("j", "a", 3)]
    paths = {r.id: r.path for r in resolve_roots(edges, with_path=True).collect()}
    assert paths["j"] == ["j", "c", "b", "a"] and paths["e"] is None
    assert rows(descendants(edges)) == [("a", "b", 1), ("a", "c", 2), ("a", "j", 3), ("b", "c", 1), ("b", "j", 2), ("c", "j", 1)]
    assert resolve_roots(linked(df.limit(0), "parent_id")).count() == 0


def test_a_cycle_beside_a_long_chain(spark):
    """Paths are built for walks that end only, and a cycle costs a few rounds, not as many as the table's length asks for."""
    from memlens.operators import hierarchy

    links = [("a", "b"), ("b", "a"), ("c", "a")] + [(f"n{i:03d}", f"n{i - 1:03d}" if i else None) for i in range(200)]
    edges = linked(spark.createDataFrame(links, "id string, parent_id string"), "parent_id")
    got = {r.id: (r.root_id, r.depth, r.path) for r in resolve_roots(edges, with_path=True).collect()}
    assert got["c"] == ("cycle", -1, None) and got["n199"][:2] == ("n000", 199) and len(got["n199"][2]) == 200 and len(got) == 202
    assert descendants(edges).where("id = 'c' or ancestor_id = 'a'").count() == 0 and descendants(edges).count() == 199 * 200 // 2
    cuts = []
    real = hierarchy.cut
    try:
        hierarchy.cut = lambda df: cuts.append(1) or real(df)
        many = spark.range(5000).selectExpr("cast(id as string) as id", "cast(if(id < 3, (id + 1) % 3, id - id % 3) as string) as parent")
        assert resolve_roots(many.where("id < 3 or id % 3 <> 0")).where("depth < 0").count() == 3 + 0 and len(cuts) <= 5
    finally:
        hierarchy.cut = real


def test_long_chain(spark):
    df = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(300)], "id string, parent_id string")
    got = {r.id: (r.root_id, r.depth) for r in resolve_roots(linked(df, "parent_id")).collect()}
    assert got == {f"n{i}": ("n0", i) for i in range(1, 300)}


def test_missing_references(spark):
    m = memories(spark, dict(id="A1"), dict(id="b2", parent_id=" a1 ", source_ids="a1,gone1"), dict(id="c3", parent_id="GONE1", superseded_by=" ", created_at="2024-02-29T23:30:00-05:00"), dict(id="d4", parent_id="gone1", source_ids='["gone2","gone2"]', created_at="bad"))
    f = feedback(spark, *[("gone3", None, "2024-03-01T00:00:00Z", False, None)] * 50, ("A1", None, "2024-03-01T00:00:00Z", False, None), (None, None, None, None, None))
    got = rows(missing_references(memory_references(m, f), parent_keys(m)))
    assert got == sorted([
        ("feedback_tracking.memory_id", "gone3", "2024-03"), ("memories.parent_id", "gone1", "2024-03"), ("memories.parent_id", "gone1", None),
        ("memories.source_ids", "gone1", "2024-01"), ("memories.source_ids", "gone2", None),
    ], key=repr)
    assert missing_references(memory_references(m.limit(0), f.limit(0)), parent_keys(m.limit(0))).count() == 0
    assert missing_references(memory_references(m.limit(0), f), parent_keys(m.limit(0))).count() == 2


# -- store

def test_insert_replace_and_delete(spark):
    m = memories(spark, dict(id="a"), dict(id="i", memory_type="insight"))
    with pytest.raises(store.Conflict):
        store.insert(m, memories(spark, dict(id="a")))
    with pytest.raises(store.Conflict):
        store.insert(m, memories(spark, dict(id="x"), dict(id="x")))
    assert store.insert(m, memories(spark, dict(id="x"))).count() == 3
    assert store.replace_insights(m, m.limit(0)).count() == 2
    assert {r.id for r in store.replace_insights(m, memories(spark, dict(id="j", memory_type="insight"))).collect()} == {"a", "j"}
    f = feedback(spark, ("a", "q", "t", False, None), ("i", "q", "t", False, None))
    left, told = store.delete(m, f, spark.createDataFrame([("a",)], "id string"))
    assert [r.id for r in left.collect()] == ["i"] and told.count() == 1
    with pytest.raises(ValueError):
        store.delete_insights(m, spark.createDataFrame([("a",)], "id string"))
    assert store.delete_insights(m, spark.createDataFrame([("i",)], "id string")).count() == 1


def test_updates(spark):
    m = memories(spark, dict(id="a", used_count=None), dict(id="b", superseded_by="a"))
    up = store.set_fields(m, spark.createDataFrame([("a", 0.9, "b")], "id string, score double, superseded_by string"))
    assert {(r.id, round(r.score, 2), r.superseded_by) for r in up.collect()} == {("a", 0.9, "b"), ("b", 0.5, "a")}
    with pytest.raises(store.NotFound):
        store.set_fields(m, spark.createDataFrame([("z", 1.0)], "id string, score double"))
    t = store.touch(m, spark.createDataFrame([("a", "t1"), ("a", "t2")], "id string, at string"))
    assert {(r.id, r.used_count, r.last_used_at) for r in t.collect()} == {("a", 2, "t2"), ("b", 0, None)}
    f = feedback(spark, ("a", "q", "t", False, None), ("a", "q", "t", True, "old"), ("b", "q", "t", False, None))
    j = store.mark_judged(f, spark.createDataFrame([("a", "now")], "memory_id string, at string"))
    assert rows(j.select("memory_id", "judged", "judged_at")) == [("a", True, "now"), ("a", True, "old"), ("b", False, None)]
    q = spark.createDataFrame([("search", "debug", "raw", 0.5, 3, "t")], "router_level string, state string, action string, value double, update_count long, updated_at string")
    new = spark.createDataFrame([("search", "debug", "raw", 0.7, 2, "u"), ("search", "debug", "raw", 0.6, 1, "s"), ("llm", "x", "y", 0.1, 1, "s")], "router_level string, state string, action string, value double, seq int, updated_at string")
    assert rows(store.upsert_q(q, new).select("router_level", "value", "update_count")) == [("llm", 0.1, 1), ("search", 0.7, 5)]
    assert rows(store.q_value(q, new.select("router_level", "state", "action").distinct()).select("router_level", "value")) == [("llm", 0.0), ("search", 0.5)]
    assert rows(store.upsert_meta(spark.createDataFrame([("k", "1"), ("l", "2")], "key string, value string"), spark.createDataFrame([("k", "9")], "key string, value string"))) == [("k", "9"), ("l", "2")]


def test_reads(spark):
    m = memories(
        spark, dict(id="a", created_at="2024-01-02T00:00:00Z"), dict(id="b", indexed=False), dict(id="c", indexed=False, superseded_by="a", embedding_context=encode([1.0])),
        dict(id="d", memory_type="insight"),
    )
    ids = lambda df: [r.id for r in df.collect()]
    assert rows(store.ordered_ids(m)) == [(1, "b"), (2, "a")] and ids(store.unindexed(m, 5)) == ["b", "c"] and ids(store.reindex_candidates(m)) == ["c"]
    assert sorted(ids(store.indexed_ids(m))) == ["a", "d"] and ids(store.insights(m)) == ["d"] and ids(store.by_id(m, "a")) == ["a"]
    assert sorted(ids(store.training_rows(m))) == ["a", "b"] and sorted(ids(store.training_rows(m, ["insight"]))) == ["d"]
    assert ids(store.recent(m, 2)) == ["a", "b"]
    bad = memories(spark, dict(id="x", memory_type="odd", insight_type="odd", context=None, result="y" * 10_001))
    assert {r.problem for r in store.violations(bad).collect()} == {"memory_type", "insight_type", "field_bytes", "null_text"}
    with pytest.raises(ValueError):
        store.check_unit("score", float("nan"))
    with pytest.raises(ValueError):
        store.check_query("x" * 5001)
    for bad_call in (lambda: store.check_id(""), lambda: store.check_id("x" * 101), lambda: store.check_days(3651), lambda: store.check_days(-1)):
        with pytest.raises(ValueError):
            bad_call()
    store.check_id("x")
    store.check_days(3650)
    assert {r.id: r.indexed for r in store.contains(m.where("id = 'a'"), m).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_import_export_and_migration(spark):
    m = memories(spark, dict(id="a"), dict(id="b", superseded_by="a"))
    new = memories(spark, dict(id="a"), dict(id="n", tags="x, y", indexed=True, superseded_by="a"), dict(id="n", created_at="2025-01-01T00:00:00Z"))
    added, totals = store.merge_import(m, new)
    r = added.collect()
    assert len(r) == 1 and r[0].tags == '["x","y"]' and not r[0].indexed and r[0].superseded_by is None and tuple(totals.first()) == (1, 2)
    assert store.portable(m).columns == [c for c in MEMORY.fieldNames() if c in store.PORTABLE] and len(store.PORTABLE) == 15
    assert tuple(store.envelope(m, "t").first()) == (1, 1, "t")
    src = memories(spark, dict(id="a", project="p"), dict(id="k", project="p"), dict(id="l"), dict(id="o", project="q"))
    rows_, stats = store.migrate(m, src, "p")
    assert [x.id for x in rows_.collect()] == ["k"] and tuple(stats.first()) == (4, 2, 1, 1, 1, 1)
    assert store.migrate(m, src, None)[1].first().migrated == 3
    tags, counts = store.migrate_tags(memories(spark, dict(id="a", tags="x,y"), dict(id="b", tags='["z"]'), dict(id="c", tags="w"), dict(id="d")))
    assert {r.id: r.tags for r in tags.collect()} == {"a": '["x","y"]', "b": '["z"]', "c": '["w"]', "d": None} and tuple(counts.first()) == (3, 1, 1, 1)
    with pytest.raises(ValueError):
        store.migrate_tags(memories(spark, dict(id="a", tags="x,y")), strict=True)
    assert "q" in store.add_column(m, "q").columns and store.add_column(m, "id") is m


# -- retrieval

TEXTS = [
    ("m1", "rust ownership model for safe memory", "borrow checker", "works"), ("m2", "python gc cycles", "collect", "slow"), ("m3", "rust async runtime", "tokio payments", "ok"),
    ("m4", "bind react-hook-form to schema", "useMutation", "done"), ("m5", "payments payment gateway", "queued queue", "is as"), ("m6", None, "", "rust rust rust"),
]


@pytest.mark.parametrize("query", ["rust", "payment", "payments", "react-hook-form", "react form", "useMut", "mutation", "pay", "queue", "rust async payments", "@#$%", "rust rust model"])
def test_bm25_equals_the_full_text_index(spark, query):
    """Scores of the bundled database's index, to 6 digits."""
    m = memories(spark, *[dict(id=i, context=c, action=a, result=r) for i, c, a, r in TEXTS])
    got = {r.id: r.rank for r in ranking.bm25(m, ranking.query_tokens(spark.createDataFrame([("q", query)], "query_id string, query string"), stem=True), 10, stem=True).collect()}
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id unindexed, context, action, result, tokenize='porter unicode61')")
    db.executemany("insert into t values (?, ?, ?, ?)", TEXTS)
    import re

    terms = re.findall(r"[^\W_]+", query)
    want = dict(db.execute("select id, rank from t where t match ?", (" OR ".join(f'"{t}"*' for t in terms),)).fetchall()) if terms else {}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_knn_ties_widths_and_nulls(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("d", [0.0, 0.0]), ("e", None), ("f", [1.0])], "id string, vec array<float>")
    q = spark.createDataFrame([("q", [3.0, 0.0]), ("z", None)], "query_id string, vec array<float>")
    assert [(r.id, r.sim, r.pos) for r in ranking.knn(v, q, 3).orderBy("pos").collect()] == [("a", 1.0, 1), ("b", 1.0, 2), ("c", 0.0, 3)]
    assert ranking.knn(v, q.limit(0), 3).count() == 0 and ranking.knn(v.limit(0), q, 3).count() == 0


def test_knn_equals_brute_force(spark, sf):
    from memlens.plans.search_queries import knn_many

    assert knn_many(spark, sf).groupBy("query_id").count().where("count <> 10").count() == 0


def hits(spark, *given):
    return spark.createDataFrame([("q", i, p) for p, i in enumerate(given, 1)], "query_id string, id string, pos int")


def test_rank_fusion(spark):
    got = {r.id: (r.score, r.place) for r in ranking.rrf(hits(spark, "a", "b"), hits(spark, "a", "c")).collect()}
    assert abs(got["a"][0] - 1 / 61) < 1e-12 and [got[i][1] for i in "abc"] == [1, 2, 3]
    nine = [f"n{i}" for i in range(8)]
    first = lambda w: ranking.rrf(hits(spark, "x", *nine[1:], "y"), hits(spark, "y"), 60, w, 1 - w).where("place = 1").first().id
    assert first(0.9) == "x" and first(0.7) == "y"
    fused = spark.createDataFrame([("q", "a", 0.5, 1), ("q", "b", 0.3, 2), ("q", "c", 0.1, 3), ("q", "d", 0.1, 4), ("z", "a", 0.0, 1)], "query_id string, id string, score double, place int")
    r = ranking.shadow_rewards(fused)
    assert [(x.k, round(x.reward, 6)) for x in r.orderBy("k").collect()] == [(3, 0.9), (5, 1.0), (10, 1.0), (20, 1.0)]
    assert ranking.rewards_json(r).first().shadow_rewards.startswith('[{"k":3,"reward":0.9')


def test_near_duplicate_needs_all_fields(spark):
    f = lambda *s: spark.createDataFrame([("q", i, v) for i, v in s], "query_id string, id string, sim double")
    got = ranking.near_duplicate([f(("a", 1.0), ("b", 0.99), ("c", 0.96)), f(("a", 0.95), ("b", 0.97), ("c", 0.97)), f(("a", 1.0), ("b", 0.98), ("c", 1.0))])
    assert rows(got) == [("q", "b", 0.97)]
    assert ranking.recall_at(f(("a", 1.0)), f(("a", 1.0), ("b", 1.0)), 2).first().recall == 0.5


def test_search_drops_superseded_after_the_cut(spark):
    m = memories(spark, dict(id="a", context="rust", superseded_by="b"), dict(id="b", context="rust and more", tags='["X"]'), dict(id="c", context="rust and very much more"))
    q = spark.createDataFrame([("q", "rust")], "query_id string, query string")
    assert [r.id for r in ranking.search(m, q, None, 2).orderBy("place").collect()] == ["b"]
    assert [r.id for r in ranking.search(m, q, None, 3, tags=["x"]).collect()] == ["b"]


# -- routing and relevance

def test_modes_and_bandit(spark):
    texts = {"found a bug in the trace": "debug", "plan the design structure": "plan", "": "routine", "bugs": "routine", "Review THIS": "review"}
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert {r.v: r.m for r in df.select("v", routing.detect_mode(F.col("v")).alias("m")).collect()} == texts
    ev = spark.createDataFrame([("search", "debug", "high_threshold", r, i) for i, r in enumerate([1.0, -1.0, None, 0.5])], "router_level string, state string, action string, reward double, seq long")
    q = 0.0
    for r in (1.0, -1.0, 0.5):
        q += 0.5 * (r - q)
    got = routing.fold_rewards(ev, 0.5).first()
    assert abs(got.value - q) < 1e-12 and got.update_count == 3
    again = routing.fold_rewards(ev.where("seq > 1"), 0.5, routing.fold_rewards(ev.where("seq < 2"), 0.5)).first()
    assert abs(again.value - q) < 1e-12 and again.update_count == 3
    table = spark.createDataFrame([("search", "debug", "low_threshold", 0.5, 1), ("search", "debug", "medium_threshold", 0.5, 1), ("search", "debug", "high_threshold", 0.9, 0)], "router_level string, state string, action string, value double, update_count long")
    assert routing.best_actions(table).first().action == "medium_threshold"
    ask = spark.createDataFrame([("1", "debug", None), ("2", "plan", 2)], "query_id string, mode string, top_k int")
    d = {r.query_id: r for r in routing.decide(ask, table).collect()}
    assert d["1"].search_strategy == "medium_threshold" and d["1"].top_k == 3 and d["2"].search_strategy == "low_threshold" and d["2"].top_k == 2
    assert routing.decide(ask, table, rng=0.12).first().search_strategy == "low_threshold"


def test_judge(spark):
    df = spark.createDataFrame([("rust memory", "rust web server", 90.0, 20)], "q string, t string, d double, u long")
    score, reason = routing.judge(F.col("q"), F.col("t"), F.col("d"), F.col("u"))
    r = df.select(score.alias("s"), reason.alias("r")).first()
    assert r.r == "keyword:0.50 recency:0.05 frequency:1.00" and abs(r.s - (0.2 + 0.3 * 2.718281828459045**-3 + 0.3)) < 1e-9


# -- consolidation

def test_exact_groups_survivor_plan_and_apply(spark):
    m = memories(
        spark, *[dict(id=f"e{i}", score=0.1 * i) for i in range(6)], dict(id="ins", memory_type="insight"), dict(id="ret", superseded_by="e0"),
        dict(id="s1", context="other", score=0.05, created_at="2020-01-01T00:00:00Z"), dict(id="o1", context="lost", parent_id="gone"),
    )
    assert rows(con.exact_groups(m).select("primary_id", "size")) == [("e0", 6)]
    s = con.survivors(con.exact_members(m), m)
    assert {r.survivor_id for r in s.collect()} == {"e5"}
    now = F.lit("2024-01-10T00:00:00Z").cast("timestamp")
    stale, lost = con.stale(m, now, 30, 0.1), con.orphans(m).select("id")
    assert [r.id for r in stale.collect()] == ["s1"] and [r.id for r in lost.collect()] == ["o1"]
    p = con.plan(con.exact_members(m), stale, lost, m)
    f = feedback(spark, ("o1", "q", "t", False, None), ("e0", "q", "t", False, None))
    out, told, audit, counts = con.apply_plan(m, f, p.unionByName(p.limit(1).withColumn("id", F.lit("zzz"))), "2024-01-10T00:00:00Z")
    got = {r.id: r for r in out.collect()}
    assert "o1" not in got and got["e0"].superseded_by == "e5" and got["e5"].superseded_by is None and not got["s1"].indexed and told.count() == 1
    assert dict(counts.collect()) == {"merge": 5, "archive": 1, "delete": 1, "error": 1} and audit.select("id").distinct().count() == 7
    assert con.gate(p, 0.9).count() == 2
    verdicts = spark.createDataFrame([("e0", "merge"), ("e1", "keep")], "id string, verdict string")
    assert {(r.id, r.action, r.confidence) for r in con.plan(con.exact_members(m), stale.limit(0), lost.limit(0), m, verdicts).collect()} == {("e0", "merge", 0.8), ("e1", "keep", 0.7)}
    assert con.plan(con.exact_members(m.limit(0)), stale.limit(0), lost.limit(0), m.limit(0)).count() == 0


def test_text_groups_are_greedy(spark):
    t = lambda n: f"2024-01-0{n}T00:00:00Z"
    m = memories(
        spark, dict(id="a1", context="same text"), dict(id="b1", context="same text"), dict(id="c1", context="alpha beta gamma delta", created_at=t(2)), dict(id="d1", context="alpha beta gamma epsilon", created_at=t(3)),
        dict(id="z", context="unrelated words here", created_at=t(4)),
    )
    probes = con.text_probes(m)
    assert {r.primary_id: r.id for r in con.text_groups(m, probes).where("id <> primary_id").collect()} == {"c1": "d1"}
    assert con.text_groups(m, probes, floor=1e6).count() == 0


def test_text_groups_equal_the_sequential_pass(spark):
    import random

    rng = random.Random(8)
    ids = [f"r{i:03d}" for i in range(80)]
    when = {i: f"2024-01-{rng.randint(1, 20):02d}T00:00:00Z" for i in ids}
    m = memories(spark, *[dict(id=i, context=i, created_at=when[i]) for i in ids])
    found = [(p, h, -rng.random() * 9) for p in ids for h in rng.sample(ids, 4) if h != p]
    probes = spark.createDataFrame(found, "probe_id string, id string, rank double")
    for floor in (0.0, 4.5):
        used, want = set(), set()
        for p in sorted(ids, key=lambda i: (when[i], i)):
            free = [(h, -r) for q, h, r in found if q == p and h not in used]
            if p in used or not free or sum(r for _, r in free) / len(free) < floor:
                continue
            used |= {p, *(h for h, _ in free)}
            want |= {(p, p), *((p, h) for h, _ in free)}
        assert {(r.primary_id, r.id) for r in con.text_groups(m, probes, floor).collect()} == want


@pytest.mark.parametrize("tail", [0, 32 << 20])
def test_text_groups_wait_for_a_long_run_of_probes(spark, monkeypatch, tail):
    """Each probe meets the next; small tables take one job for all of them, and rounds give the same groups."""
    import random

    calls, in_order = [], con._in_order
    monkeypatch.setattr(con, "TAIL_BYTES", tail)
    monkeypatch.setattr(con, "_in_order", lambda *a: calls.append(1) or in_order(*a))
    ids = [f"r{i:02d}" for i in range(12)]
    m = memories(spark, *[dict(id=i, context=i, created_at=f"2024-01-{n + 1:02d}T00:00:00Z") for n, i in enumerate(ids)])
    found = [(p, h, -random.Random(p + h).random()) for n, p in enumerate(ids) for h in ids[n + 1 : n + 2] + ids[max(0, n - 1) : n]]
    got = con.text_groups(m, spark.createDataFrame(found, "probe_id string, id string, rank double"), 0.0)
    want = {(ids[n], i) for n in range(0, 12, 2) for i in ids[n : n + 2]}
    assert {(r.primary_id, r.id) for r in got.collect()} == want and len(calls) == bool(tail)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)] + [("x", "y")], "a string, b string")
    got = con.components(links).groupBy("component").count()
    assert rows(got) == [("n000", 121), ("x", 2)]


# -- mining

def test_recurrence_and_metrics(spark):
    m = memories(spark, *[dict(id=f"b{i}", memory_type="bugfix", created_at=f"2024-01-0{i + 1}T00:00:00Z", score=0.2 * i) for i in range(5)], dict(id="p", memory_type="pattern"))
    assert rows(mining.recurrence(m)) == [("bugfix", 5, 24.0)]
    got = {r.name: round(r.value, 4) for r in mining.metrics(m).collect()}
    assert got == {"memory_count": 6.0, "avg_score": round((2.0 + 0.5) / 6, 4), "type_fraction_bugfix": 0.8333, "type_fraction_pattern": 0.1667}
    assert mining.metrics(m.limit(0)).count() == 0
    assert {r.target_id for r in mining.low_scores(m).collect()} == {"b0", "b1"}
    assert mining.temporal_insights(mining.recurrence(m)).first().action == "5 occurrences with ~24.0h interval"


def test_chains(spark):
    t = lambda h: f"2024-01-01T{h:02d}:00:00Z"
    near, far = encode([1.0, 0.1]), encode([-1.0, 0.3])
    m = memories(
        spark, dict(id="a"), dict(id="b", parent_id="a", created_at=t(1)), dict(id="c", parent_id="b", created_at=t(2)), dict(id="c2", parent_id="b", created_at=t(3)),
        dict(id="x", created_at=t(4), embedding_context=near), dict(id="f", created_at=t(5), embedding_context=far), dict(id="y", created_at=t(6), embedding_context=near),
        dict(id="z", created_at=t(12), embedding_context=near), dict(id="late", created_at=t(19), embedding_context=near),
    )
    assert rows(mining.explicit_chains(m)) == [("a", 0, "a"), ("a", 1, "b"), ("a", 2, "c")]
    assert rows(mining.implicit_chains(m)) == [("x", 0, "x"), ("x", 1, "y"), ("x", 2, "z")]
    assert mining.chain_insights(mining.explicit_chains(m), m).first().result == "Chain: a -> b -> c"


def test_average_linkage(spark):
    m = memories(spark, *[dict(id=i, embedding_context=encode(v)) for i, v in {"m1": [1, 0.0], "m2": [1, 0.05], "m3": [0, 1.0], "m4": [0.05, 1]}.items()])
    pairs = spark.createDataFrame([("m1", "m2"), ("m3", "m4")], "a string, b string")
    assert rows(mining.average_linkage_clusters(m, pairs)) == [("m1", "m1"), ("m1", "m2"), ("m3", "m3"), ("m3", "m4")]


def vector_tables(spark, path, vectors):
    """A store whose rows have the given vectors in all fields."""
    blob = lambda v: encode([*v, *[0.0] * (64 - len(v))])
    data = [dict(id=f"mem-{i:012x}", embedding_context=blob(v), embedding_action=blob(v), embedding_result=blob(v)) for i, v in enumerate(vectors)]
    memories(spark, *data).write.parquet(f"{path}/memories.parquet")
    return str(path)


def test_clusters_of_many_copies_are_whole(spark, tmp_path):
    """Classes and the links between them lose no pair of 30 equal and 30 near rows; groups beyond a few members too."""
    from memlens.plans.search_queries import average_linkage, cluster_classes, cluster_edges

    near = [[1.0, 0.01 * i] for i in range(30)]
    d = vector_tables(spark, tmp_path, [[0.0, 1.0]] * 30 + near)
    classes = {r.id: r["class"] for r in cluster_classes(spark, d).collect()}
    assert len(set(classes.values())) == 31 and sum(c == "mem-000000000000" for c in classes.values()) == 30
    assert len(cluster_edges(spark, d).collect()) == 30 * 29 // 2
    pairs = ranking.near_pairs(spark.createDataFrame([(f"x{i:02d}", [0.0, 1.0]) for i in range(30)], "id string, vec array<float>"), 0.85)
    assert pairs.distinct().count() == 435
    got = rows(average_linkage(spark, d))
    assert [c for c, _ in got].count("mem-000000000000") == 30 and len(got) == 60


def test_near_duplicates_among_many_copies_are_found(spark, tmp_path):
    from memlens.plans.search_queries import near_dup_lookup

    one = lambda i: [float(j == i) for j in range(64)]
    kind = [5 if i < 60 or i % 20 == 0 and i < 100 else i % 64 for i in range(120)]
    d = vector_tables(spark, tmp_path, [one(k) for k in kind])
    ids = [f"mem-{i:012x}" for i in range(120)]
    truth = {ids[i]: next((ids[j] for j in range(120) if j != i and kind[j] == kind[i]), None) for i in range(0, 120, 20)}
    assert {r.query_id: r.id for r in near_dup_lookup(spark, d).collect()} == {q: i for q, i in truth.items() if i}


def test_equal_vectors_are_ties_in_any_partition(spark):
    """100 copies and 50 near misses over several partitions: the smallest ids win, with the same cosine."""
    import numpy as np

    rng = np.random.default_rng(3)
    hot, other = rng.standard_normal(37).astype("f4"), rng.standard_normal((50, 37)).astype("f4")
    data = [(f"c{i:03d}", hot.tolist()) for i in range(100)] + [(f"a{i:03d}", v.tolist()) for i, v in enumerate(other)]
    v = spark.createDataFrame(data, "id string, vec array<float>").repartition(7)
    q = spark.createDataFrame([(f"q{i}", (hot + 0.05 * i * other[0]).tolist()) for i in range(9)], "query_id string, vec array<float>")
    got = ranking.knn(v, q, 12).collect()
    for i in range(9):
        own = sorted((r for r in got if r.query_id == f"q{i}"), key=lambda r: r.pos)
        assert [r.id for r in own] == [f"c{j:03d}" for j in range(12)] and len({r.sim for r in own}) == 1
    three = spark.createDataFrame([("x", "m1", [1.0, 0.0]), ("y", "m1", [0.0, 1.0]), ("x", "m2", [0.6, 0.8]), ("y", "m3", [0.0, 2.0])], "field string, id string, vec array<float>")
    ask = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, vec array<float>")
    assert [(r.id, round(r.sim, 6)) for r in ranking.three_field(three, ask, 3).orderBy("pos").collect()] == [("m1", 1.0), ("m3", 1.0), ("m2", 0.8)]


def test_best_rows_are_those_of_a_full_search(spark):
    """What pruning leaves out can't be among the best: frequent tokens, ties and repeated tokens."""
    import random

    rng = random.Random(4)
    words = ["the"] * 30 + ["of"] * 12 + [f"w{i}" for i in range(40)]
    m = memories(spark, *[dict(id=f"m{i:03d}", context=" ".join(rng.choice(words) for _ in range(rng.randint(3, 25)))) for i in range(300)])
    q = spark.createDataFrame([(f"q{i}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(60)], "query_id string, query string")
    index = ranking.TextIndex.build(m, stem=False)
    tokens = ranking.query_tokens(q, False)
    every = {}
    for r in ranking.bm25(index, tokens, None).collect():
        every.setdefault(r.query_id, []).append((round(r["rank"], 9), r.id))
    got = {}
    for r in ranking.bm25(index, tokens, 7).collect():
        got.setdefault(r.query_id, []).append((round(r["rank"], 9), r.id))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:7] for k, v in every.items()} and len(got) == 60


def test_text_index_is_kept(spark):
    m = memories(spark, dict(id="a", context="payments"), dict(id="b", context="gateway"), dict(id="c", context=None, action=None, result=None))
    index = ranking.TextIndex.build(m)
    find = lambda i, q: sorted(r.id for r in ranking.bm25(i, ranking.query_tokens(spark.createDataFrame([("q", q)], "query_id string, query string"), i.stem), 9).collect())
    assert find(index, "payment") == ["a"] and index.corpus().first()["n"] == 3
    index.update(memories(spark, dict(id="a", context="gateways"), dict(id="d", context="paid payment")), spark.createDataFrame([("b",)], "id string"))
    again = ranking.TextIndex.open(spark, index.path)
    assert find(again, "payment") == ["d"] and find(again, "gateway") == ["a"] and again.corpus().first()["n"] == 3
    again.compact()
    assert find(ranking.TextIndex.open(spark, index.path), "gateway") == ["a"] and len(again.segments) == 1
    empty = ranking.TextIndex.build(m.limit(0))
    assert find(empty, "payment") == [] and find(index, "@#") == []


def test_other_scripts_are_found(spark):
    m = memories(spark, dict(id="a", context="сервер упал"), dict(id="b", context="Café déjà vu"), dict(id="c", context="日本語 テスト"))
    for stem in (True, False):
        q = spark.createDataFrame([("1", "Сервер"), ("2", "café"), ("3", "日本語")], "query_id string, query string")
        assert {(r.query_id, r.id) for r in ranking.bm25(m, ranking.query_tokens(q, stem), 3, stem).collect()} == {("1", "a"), ("2", "b"), ("3", "c")}


def test_diverse_selection(spark):
    """A near copy of one taken waits for those that point elsewhere."""
    import math

    at = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    v = spark.createDataFrame([("a", at(10)), ("b", at(12)), ("c", at(-30)), ("d", None)], "id string, vec array<double>")
    c = spark.createDataFrame([("q", i, math.cos(math.radians(x))) for i, x in (("a", 10), ("b", 12), ("c", 30), ("d", 80))], "query_id string, id string, sim double")
    pick = lambda m, **k: [r.id for r in ranking.diverse(c, v, m, **k).orderBy("pos").collect()]
    assert pick(2) == ["a", "c"] and pick(3) == ["a", "c", "d"] and pick(4) == ["a", "c", "d", "b"] and pick(4, backfill=False) == ["a", "c", "d"]


def test_a_hot_key_of_the_bandit(spark):
    """Half of all events are of one key, seqs have gaps; the fold is the sequential one, and keys beyond the most are refused."""
    import random

    rng = random.Random(6)
    data = [("search", "debug" if rng.random() < 0.5 else f"s{rng.randint(0, 9)}", "a", rng.choice([rng.random(), None]), i * i) for i in range(1, 800)]
    q, first = {}, {}
    for _, state, _, r, seq in data:
        if r is not None:
            first.setdefault(state, seq)
            q[state] = q.get(state, 0.0) + 0.1 * (r - q.get(state, 0.0))
    ev = spark.createDataFrame(data, "router_level string, state string, action string, reward double, seq long")
    got = {r.state: r.value for r in routing.fold_rewards(ev).collect()}
    assert got.keys() == q.keys() and all(abs(got[k] - q[k]) < 1e-12 for k in q)
    kept = {r.state for r in routing.fold_rewards(ev, most=3).collect()}
    assert kept == set(sorted(first, key=first.get)[:3])
    full = routing.fold_rewards(ev.where("state = 'debug'"))
    assert {r.state for r in routing.fold_rewards(ev, start=full, most=1).collect()} == {"debug"}
    table = routing.fold_rewards(ev)
    assert [r.action for r in routing.actions_for_state(table, "debug").collect()] == ["a"] and routing.q_rows(table).first().state == "debug"


def test_rouge_and_models(spark):
    df = spark.createDataFrame([("a b c", "a b c"), ("a b", "c d"), ("c b a", "a b c"), (None, "x")], "c string, r string")
    assert [round(r.s, 3) for r in df.select(mining.rouge_l("c", "r").alias("s")).collect()] == [1.0, 0.0, 0.333, 0.0]
    few = memories(spark, dict(id="a"))
    assert mining.classifier(few) is None and mining.ranker(few, feedback(spark)) is None
    m = memories(spark, *[dict(id=f"t{i}", memory_type=("bugfix", "pattern")[i % 2], context=("crash fix", "reuse idea")[i % 2], score=(i % 2) * 0.5, used_count=i % 2) for i in range(30)])
    acc = mining.accuracy(mining.classifier(m).transform(mining.training_texts(m))).first().accuracy
    f = feedback(spark, *[(f"t{i}", "q", "t", True, "t") for i in range(1, 30, 2)])
    assert acc == 1.0 and mining.accuracy(mining.ranker(m, f).transform(mining.labelled(m, f))).first().accuracy == 1.0


def test_feedback_states(spark):
    f = feedback(spark, ("a", "q", "t", False, None), ("a", "q", "t", True, "u"), ("b", "q", "t", False, None), ("b", "q", "t", None, None))
    assert rows(mining.pending(f)) == [("b", 2)] and tuple(mining.feedback_counts(f).first()) == (4, 1, 3)
    h = {r.bucket: r.rows for r in mining.score_histogram(memories(spark, dict(id="a", score=-1.0), dict(id="b", score=1.0), dict(id="c", score=float("nan")), dict(id="d", score=None))).collect()}
    assert h[0] == 1 and h[9] == 1 and sum(h.values()) == 2 and len(h) == 10


def test_implicit_edges_over_many_time_blocks(spark, monkeypatch):
    """Blocks of few rows give the pairs of the definition: equal times, the end of the window, other widths and zero vectors included."""
    monkeypatch.setattr(mining, "TIME_BLOCK_LEAST", 16)
    monkeypatch.setattr(mining, "EDGE_CELLS", 64)
    rng = np.random.default_rng(3)
    base = np.repeat(rng.standard_normal((30, 8)), 8, 0) + 0.3 * rng.standard_normal((240, 8))
    hour = rng.integers(0, 60, 240)
    data = [dict(id=f"r{i:03d}", created_at=f"2024-01-{1 + h // 24:02d}T{h % 24:02d}:00:00Z", embedding_context=encode(v if i % 9 else v[:4] * (i % 2))) for i, (v, h) in enumerate(zip(base, hour))]
    truth = {}
    for i, a in enumerate(data):
        for j, b in enumerate(data):
            x, y = (np.frombuffer(d["embedding_context"], "<f4").astype(float) for d in (a, b))
            gap = int(hour[j] - hour[i])
            if len(x) == len(y) and x.any() and y.any() and 0 <= gap <= 6 and (gap or b["id"] > a["id"]) and (s := x @ y / np.sqrt((x @ x) * (y @ y))) >= 0.7:
                truth[a["id"], b["id"]] = (gap, round(s, 9))
    m = memories(spark, *data)
    found = mining.implicit_edges(m)
    assert {(r.a, r.b): (r.gap_hours, round(r.similarity, 9)) for r in found.collect()} == truth and len(truth) > 50
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString()  # rows of wide time buckets are not joined one by one
    assert mining.implicit_edges(m.limit(0)).count() == 0


def test_implicit_chains_are_greedy_in_time(spark, monkeypatch):
    """Chains over several time blocks equal the sequential pass, ties in time by id."""
    monkeypatch.setattr(mining, "TIME_BLOCK_LEAST", 16)
    rng = np.random.default_rng(8)
    v = np.repeat(rng.standard_normal((12, 8)), 15, 0) + 0.35 * rng.standard_normal((180, 8))
    hour = rng.integers(0, 48, 180)
    data = [dict(id=f"r{(i * 7) % 180:03d}", created_at=f"2024-01-{1 + h // 24:02d}T{h % 24:02d}:00:00Z", embedding_context=encode(x)) for i, (x, h) in enumerate(zip(v, hour))]
    x = np.stack([np.frombuffer(d["embedding_context"], "<f4").astype(float) for d in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order = sorted(range(180), key=lambda i: (hour[i], data[i]["id"]))
    used, truth = set(), set()
    for start in order:
        if start in used:
            continue
        chain = [start]
        while (step := next((j for j in order[order.index(chain[-1]) + 1 :] if j not in used and hour[j] - hour[chain[-1]] <= 6 and x[chain[-1]] @ x[j] >= 0.7), None)) is not None:
            chain.append(step)
        if len(chain) > 1:
            used.update(chain)
            truth |= {(data[start]["id"], p, data[i]["id"]) for p, i in enumerate(chain)}
    assert set(rows(mining.implicit_chains(memories(spark, *data)))) == truth and len(truth) > 100


def test_all_chains_find_the_explicit_ones_once(spark, monkeypatch):
    calls, explicit = [], mining.explicit_chains
    monkeypatch.setattr(mining, "explicit_chains", lambda m: calls.append(1) or explicit(m))
    near = encode([1.0, 0.1])
    m = memories(spark, dict(id="a"), dict(id="b", parent_id="a"), dict(id="x", embedding_context=near), dict(id="y", embedding_context=near))
    assert rows(mining.chains(m)) == [("explicit", "a", 0, "a"), ("explicit", "a", 1, "b"), ("implicit", "x", 0, "x"), ("implicit", "x", 1, "y")]
    assert len(calls) == 1


@pytest.mark.parametrize("seed", range(6))
def test_screened_scores_give_the_exact_best_rows(monkeypatch, seed):
    """Dense and posting-wise tokens, small steps, many rows of equal scores: best rows, ties to the smaller id, as in a plain sum."""
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(ranking, "SCORE_CELLS", [100, 5000, 1 << 22][seed % 3])
    monkeypatch.setattr(ranking, "DENSE_SHARE", [128, 1, 10**9][seed // 2])
    rows_, kinds, asking = [7, 900][seed % 2], 60, 150
    share = rng.random(kinds) ** 3
    have, weight = rng.random((kinds, rows_)) < share[:, None], np.repeat(rng.random((kinds, 1)), rows_, 1)
    have[:, rows_ // 2 :] = have[:, rng.integers(0, 3, rows_ - rows_ // 2)]
    at, row = np.nonzero(have)
    of, code = np.nonzero(rng.random((asking, kinds)) < share / 2)
    times = rng.integers(1, 3, len(of)).astype(float)
    queries, ids = np.array([f"q{i:03d}" for i in range(asking)], object), np.array([f"d{i:03d}" for i in range(rows_)], object)
    got = {q: [] for q in queries}
    for frame in ranking._best_rows(queries, of, code, times, ids, at, row, weight[at, row], kinds, 5):
        for q, i, s in frame.itertuples(index=False):
            got[q].append((i, round(s, 7)))
    for q, name in enumerate(queries):
        s = times[of == q] @ np.where(have, weight, 0)[code[of == q]]
        best = np.lexsort((np.arange(rows_), -s.round(9)))[:5]
        assert got[name] == [(ids[j], round(s[j], 7)) for j in best if s[j] > 0]
