"""Jobs of several stages, and the helpers they use."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_operators import feedback, memories

from memlens import runtime
from memlens.functions.vectors import encode, hash_collisions, resolve_hashes
from memlens.operators import consolidation as con
from memlens.operators import ingest, mining, pipeline, ranking

NOW = "2024-02-01T00:00:00Z"


def test_runs_isolate_their_stages(spark, monkeypatch):
    near = encode([1.0, 0.0])
    m = memories(spark, *[dict(id=f"m{i:02d}", score=0.1 if i == 0 else 0.9, memory_type=("bugfix", "pattern")[i % 2], embedding_context=near, parent_id=f"m{i - 1:02d}" if i in (1, 2) else None) for i in range(12)])
    f = feedback(spark, ("m01", "q", "t", True, "t"))
    run = pipeline.run_medium(m, f)
    told = [json.loads(r.value) for r in run.messages.orderBy("part").collect()]
    kinds = {t["type"] for t in told}
    assert kinds == {"progress", "insight", "recommendation", "metric", "complete"} and told[-1]["type"] == "complete" and not run.failed
    made = {r.insight_type: r for r in run.insights.collect()}
    chains = {r.result for r in run.insights.where("insight_type = 'causal'").collect()}
    assert chains == {"Chain: m00 -> m01 -> m02", "Chain: " + " -> ".join(f"m{i:02d}" for i in range(3, 12))}  # told by links, and by time and vectors
    assert set(made) == {"cluster", "temporal", "causal"} and len(made["cluster"].source_ids.split(",")) == 12
    monkeypatch.setattr(mining, "recurrence", lambda m: 1 / 0)
    monkeypatch.setattr(mining, "ranker", lambda m, f: None)  # the models took part above
    broken = pipeline.run_deep(m, f, generated=m.select("id", F.lit("a b").alias("generated"), F.lit("a b").alias("reference")))
    told = [json.loads(r.value) for r in broken.messages.orderBy("part").collect()]
    assert broken.failed == ["temporal"] and any(t.get("stage", "").startswith("temporal_failed") for t in told)
    assert {t["name"]: t["value"] for t in told if t["type"] == "metric"}.items() >= {"text_quality_rouge_l": 1.0, "training_texts": 11.0}.items()
    monkeypatch.undo()
    empty = pipeline.run_medium(m.limit(0), f.limit(0))
    assert empty.insights.count() == 0 and not empty.failed


def test_groups_with_missing_members(spark):
    m = memories(spark, dict(id="a"), dict(id="b"), dict(id="c"))
    g = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c"), ("c", "gone"), ("c", "also gone")], "primary_id string, id string")
    whole, errors = pipeline.load_groups(g, m)
    assert rows(whole.select("primary_id", "id")) == [("a", "a"), ("a", "b")] and rows(errors) == [("c", 2, "memory not found: also gone")]
    assert tuple(pipeline.preview(g, m.select("id"), m.select("id").limit(0)).first()) == (2, 3, 0)


def test_verdicts_of_a_generator(spark):
    m = memories(spark, *[dict(id=i) for i in "abcd"])
    groups = con.exact_members(m)

    def generate(prompt):
        return F.when(prompt.contains("Memory B (id=b)"), "<think>KEEP</think>merge").when(prompt.contains("Memory B (id=c)"), "KEEP_BOTH")

    assert {r.id: r.verdict for r in pipeline.verdicts(groups, m, generate).collect()} == {"b": "merge", "c": "keep", "d": "keep"}


def test_judging(spark):
    m = memories(spark, dict(id="a", context="rust memory", updated_at=NOW), dict(id="b", context="other", updated_at=NOW))
    asked = spark.createDataFrame([("a", "rust", None), ("b", "x", 1.5), ("gone", "x", None)], "memory_id string, query string, score double")
    now = F.lit(NOW).cast("timestamp")
    plain = {r.memory_id: r for r in pipeline.judge_rows(asked, m, now).collect()}
    assert set(plain) == {"a", "b"} and abs(plain["a"].score - 0.7) < 1e-9 and not plain["a"].degraded and plain["b"].score == 1.5 and plain["b"].reason == "explicit score"
    good = pipeline.judge_rows(asked, m, now, lambda p: F.when(p.isNotNull(), '{"score": 3, "reason": "yes"}')).where("memory_id = 'a'").first()
    assert (good.score, good.reason, good.degraded) == (1.0, "yes", False)
    bad = pipeline.judge_rows(asked, m, now, lambda p: F.lit("sorry").cast("string")).where("memory_id = 'a'").first()
    assert abs(bad.score - 0.7) < 1e-9 and bad.degraded
    f = feedback(spark, ("a", "q", "t", False, None))
    scored, told, _ = pipeline.judge(asked, m, f, NOW)
    assert told.first().judged and {r.id: round(r.score, 2) for r in scored.collect()} == {"a": 0.7, "b": 1.5}


def test_migrations_run_once(spark):
    m, f = memories(spark, dict(id="a", tags="x, y")), feedback(spark, ("a", "q", "t", False, None)).drop("query_id")
    meta = spark.createDataFrame([], "key string, value string")
    out, told, done, report = pipeline.run_migrations(m, f, meta)
    assert out.first().tags == '["x","y"]' and "query_id" in told.columns and report["tags_format"]["rewritten_csv"] == 1 and done.count() == 3
    again = pipeline.run_migrations(out, told, done)
    assert again[0] is out and again[3] == {} and pipeline.run_migrations(m, f, meta, dry_run=True)[0] is m
    with pytest.raises(ValueError):
        pipeline.run_migrations(m, f, meta, strict=True)


def test_retry():
    slept, calls = [], []

    def fail():
        calls.append(1)
        raise OSError("busy")

    with pytest.raises(OSError):
        runtime.retry(fail, sleep=slept.append)
    assert slept == [0.1, 0.2, 0.4] and len(calls) == 4
    with pytest.raises(OSError):
        runtime.retry(fail, again=lambda e: False, sleep=slept.append)
    assert len(calls) == 5 and runtime.retry(lambda: 7) == 7 and runtime.waits((9, 0.1, 1.0))[-1] == 1.0


def test_queries_are_embedded_once(spark):
    asked = spark.createDataFrame([("1", "short"), ("2", "short"), ("3", "one two three four"), ("4", None), ("5", "fails")], "query_id string, query string")

    def generate(prompt):
        return F.when(prompt.endswith("Query: short"), "<think>x</think>a long answer")

    got = {r.query_id: r.vec for r in ingest.embed_queries(asked, lambda c: F.array(F.length(c).cast("float")), generate, 3).collect()}
    assert got == {"1": [13.0], "2": [13.0], "3": [18.0], "4": None, "5": [5.0]}


def test_skewed_joins_lose_nothing(spark, monkeypatch):
    big = spark.range(3000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("k"), "id")
    few = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = rows(big.join(few, "k"))
    assert rows(runtime.skew_join(big, few, ["k"])) == want
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 0)
    assert rows(runtime.skew_join(big, few, ["k"], 7)) == want


def test_hashes_and_percentiles(spark):
    m = memories(spark, dict(id="a"), dict(id="b"))
    assert hash_collisions(m).count() == 0
    from memlens.functions.vectors import fnv1a_64

    h = m.select(fnv1a_64("id").alias("hash")).unionByName(spark.createDataFrame([(5,)], "hash long"))
    assert {r.id for r in resolve_hashes(h, m).collect()} == {"a", "b"}
    t = ranking.percentiles(spark.range(1, 1001).select(F.col("id").alias("ms"))).first()
    assert tuple(t) == (500, 950, 990, 999) and t.asDict().keys() == {"p50", "p95", "p99", "p99_9"}


def test_a_cluster_has_to_name_its_folder(spark):
    class Elsewhere:
        class sparkContext:
            master = "yarn"

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Elsewhere())
