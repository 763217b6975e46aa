"""The write path: embedding, storing with deduplication, re-embedding."""

import pytest
from pyspark.sql import functions as F
from test_operators import feedback, memories

from memlens.functions.vectors import deterministic_embedding
from memlens.operators import ingest

EMBED = lambda c: deterministic_embedding(16)(c)
BATCH = "n long, id string, memory_type string, context string, action string, result string, tags string"


def test_store_merges_with_history_and_within_the_batch(spark):
    m, v = memories(spark).limit(0), spark.createDataFrame([], "field string, id string, vec array<float>")
    one = spark.createDataFrame([(0, "a", "bugfix", "parser crash", "fix it", "works", "x,y"), (1, "b", "bugfix", "parser crash", "fix it", "works", None), (2, "c", "bugfix", "zzzzzzz!", "12345", "qq", None)], BATCH)
    m, new, out = ingest.store_batch(m, v, one, EMBED, "t1")
    assert {r.id: r.merged_into for r in out.collect()} == {"a": None, "b": "a", "c": None}
    got = {r.id: r for r in m.collect()}
    assert set(got) == {"a", "c"} and got["a"].used_count == 1 and got["a"].last_used_at == "t1" and got["a"].tags == '["x","y"]' and len(got["a"].embedding_result) == 64
    two = spark.createDataFrame([(0, "d", "bugfix", "parser crash", "fix it", "works", None)], BATCH)
    m, _, out = ingest.store_batch(m, new, two, EMBED, "t2")
    assert out.first().merged_into == "a" and m.where("id = 'a'").first().used_count == 2 and m.count() == 2
    with pytest.raises(ValueError):
        ingest.store_batch(m, new, two.withColumn("context", F.lit("x" * 10_001)), EMBED, "t3")


def test_store_merges_many_copies_of_a_batch(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    x = np.concatenate([np.tile([1.0, 0, 0], (40, 1)), [1.0, 0, 0] + 0.05 * rng.standard_normal((40, 3)), [1.0, 0, 0] + 0.5 * rng.standard_normal((40, 3))])
    x = x[rng.permutation(len(x))]
    known = {f"t{n}": v.tolist() for n, v in enumerate(x)} | {"zero": [0.0, 0.0, 0.0]}

    @F.pandas_udf("array<float>")
    def provider(text: pd.Series) -> pd.Series:
        return text.map(known.get)

    texts = [f"t{n}" for n in range(len(x))] + ["zero", "zero"]
    batch = spark.createDataFrame([(n, f"i{n:03d}", "bugfix", t, t, t, None) for n, t in enumerate(texts)], BATCH)
    _, _, out = ingest.store_batch(memories(spark).limit(0), spark.createDataFrame([], "field string, id string, vec array<float>"), batch, lambda c: provider(c), "t1")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    into = {}
    for n in range(len(x)):
        into[n] = next((m for m in range(n) if into[m] is None and unit[m] @ unit[n] > 0.95), None)
    truth = {f"i{n:03d}": None if m is None else f"i{m:03d}" for n, m in into.items()} | {"i120": None, "i121": None}
    assert {r.id: r.merged_into for r in out.collect()} == truth


def test_first_wins_is_the_sequential_pass(spark):
    import random

    rng = random.Random(2)
    edges = [(b, a) for b in range(60) for a in range(b) if rng.random() < 0.08]
    into = {}
    for n in range(60):
        into[n] = min((a for b, a in edges if b == n and into[a] is None), default=None)
    got = ingest.first_wins(spark.range(60).withColumnRenamed("id", "n"), spark.createDataFrame(edges, "n long, near long"))
    assert {r.n: r.into for r in got.collect()} == into


def test_reembed_guard_status(spark):
    m = memories(spark, dict(id="a"), dict(id="b", result=None), dict(id="c", superseded_by="a"))
    out, stats = ingest.reembed(m, EMBED)
    got = {r.id: r for r in out.collect()}
    assert got["a"].embedding_context and not got["b"].indexed and got["c"].embedding_context is None and tuple(stats.first()) == (1, 1)
    meta = ingest.guard_model(spark.createDataFrame([], "key string, value string"), "m1")
    assert ingest.guard_model(meta, "m1").count() == 1
    with pytest.raises(ValueError):
        ingest.guard_model(meta, "m2")
    s = ingest.status(m, feedback(spark, ("a", None, "t", False, None)), few=3, many_pending=0).first()
    assert (s.memories, s.indexed, s.pending, s.hints) == (3, 3, 1, ["train", "judge"])


def test_hyde_and_saved_search(spark):
    df = spark.createDataFrame([("short one", "a guess"), ("this is a longer query", "a guess"), ("", "a guess"), ("short", None)], "q string, h string")
    assert [r.t for r in df.select(ingest.hyde_text(F.col("q"), F.col("h"), 4).alias("t")).collect()] == ["a guess", "this is a longer query", "", "short"]
    found = spark.createDataFrame([(2, "late"), (1, "best")], "place int, context string")
    assert tuple(ingest.saved_search(found, "x").first()) == ("Searched for: x", "Found 2 results", "Top result: best")


def test_within_batch_is_the_sequential_pass_without_pairs(spark, monkeypatch):
    """Decided in heads of seven rows; vectors of other widths, null and zero ones stay; no pairs of the batch are asked for."""
    import numpy as np

    monkeypatch.setattr(ingest, "LEAD_ROWS", 7)
    monkeypatch.setattr(ingest.ranking, "all_near", None)
    rng = np.random.default_rng(4)
    x = [([1.0, 0, 0] + 0.4 * rng.standard_normal(3)).tolist() for _ in range(60)]
    x[5], x[30], x[9], x[40], x[12], x[50] = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0], [1.0, 0.1], [1.0, 0.2], None, x[3]
    n = rng.permutation(60) * 3
    unit = [None if v is None or not any(v) else np.array(v) / np.linalg.norm(v) for v in x]
    into = {}
    for i in np.argsort(n):
        near = [int(n[j]) for j in range(60) if n[j] < n[i] and into[int(n[j])] is None and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] > 0.95]
        into[int(n[i])] = min(near, default=None)
    rows = spark.createDataFrame([(int(k), v, v, v) for k, v in zip(n, x)], "n long, context array<float>, action array<float>, result array<float>")
    assert {r.n: r.into for r in ingest.within_batch(rows, 0.95).collect()} == into and sum(v is not None for v in into.values()) > 20
    assert ingest.within_batch(rows.limit(0), 0.95).count() == 0


def test_store_finds_the_stored_row_behind_many_nearer_in_one_field(spark):
    """Over 16 stored rows are nearer to the row in each single field than the only ones that are near in all three."""
    import math

    import pandas as pd

    known = {"same": [1.0, 0.0], "near": [math.cos(0.2), math.sin(0.2)], "next": [math.cos(0.25), math.sin(0.25)], "far": [0.0, 1.0]}

    @F.pandas_udf("array<float>")
    def provider(text: pd.Series) -> pd.Series:
        return text.map(known.get)

    texts = [("same", "far", "far")] * 40 + [("far", "same", "far")] * 40 + [("far", "far", "same")] * 40 + [("next",) * 3] * 40 + [("near",) * 3] * 40
    have = [(f, f"s{i:03d}", known[t]) for i, row in enumerate(texts) for f, t in zip(ingest.FIELDS, row)]
    m = memories(spark, *[dict(id=f"s{i:03d}") for i in range(len(texts))])
    v = spark.createDataFrame(have, "field string, id string, vec array<float>").repartition(7)
    batch = spark.createDataFrame([(0, "a", "bugfix", "same", "same", "same", None), (1, "b", "bugfix", "far", "far", "far", None), (2, "c", "bugfix", "far", "far", "far", None)], BATCH)
    m, _, out = ingest.store_batch(m, v, batch, lambda c: provider(c), "t1")
    assert {r.id: r.merged_into for r in out.collect()} == {"a": "s160", "b": None, "c": "b"}
    assert m.where("id = 's160'").first().used_count == 1 and m.count() == len(texts) + 1


def test_best_in_all_equals_every_pair_compared(spark, monkeypatch):
    """Copies over several tasks, rows as near as single precision tells, other widths, zero, null and not finite vectors; small steps and blocks."""
    import numpy as np

    monkeypatch.setattr(ingest.ranking, "NEAR_CELLS", 300)
    monkeypatch.setattr(ingest.ranking, "EXACT_PAIRS", 7)
    monkeypatch.setattr(ingest.ranking, "QUERY_BYTES", 1 << 14)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((3, 16))
    draw = lambda k, by: [[v.astype("f4").tolist() for v in centre + by * rng.standard_normal((3, 16))] for _ in range(k)]
    rows = draw(60, 0.3) + draw(60, 0.1) + draw(30, 1e-7)
    rows += [rows[i] for i in range(60, 140, 2)] + [[[0.0] * 16] * 3, [[float("nan")] * 16] * 3, [[1.0, 2.0]] * 3]
    asked = draw(40, 0.2) + draw(20, 1e-7) + rows[70:90] + [[[0.0] * 16] * 3, [[float("nan")] * 16] * 3, [[1.0, 2.0]] * 3]
    order = rng.permutation(len(rows))
    kind = "array<float>, ".join(["id string, context ", "action ", "result "]) + "array<float>"
    v = spark.createDataFrame([(f"m{order[i]:03d}", *x) for i, x in enumerate(rows)] + [("null", None, *rows[0][1:])], kind).repartition(5)
    q = spark.createDataFrame([(f"q{i:03d}", *x) for i, x in enumerate(asked)] + [("qnull", None, *rows[0][1:])], kind.replace("id", "query_id", 1))
    unit = lambda x: [np.array(f, float) / max(np.linalg.norm(f), 1e-300) for f in x]
    own, truth = [(f"m{order[i]:03d}", unit(x)) for i, x in enumerate(rows)], {}
    for i, x in enumerate(map(unit, asked)):
        near = [(-round(s, 9), k) for k, y in own if len(y[0]) == len(x[0]) and (s := min(float((a * b).sum()) for a, b in zip(x, y))) > 0.95]
        if near:
            truth[f"q{i:03d}"] = min(near)
    got = {r.query_id: (-round(r.sim, 9), r.id) for r in ingest.ranking.best_in_all(v, q, ingest.FIELDS, 0.95).collect()}
    assert got == truth and 40 < len(truth) < len(asked)
    assert ingest.ranking.best_in_all(v, q.limit(0), ingest.FIELDS, 0.95).count() == 0 and ingest.ranking.best_in_all(v.limit(0), q, ingest.FIELDS, 0.95).count() == 0
