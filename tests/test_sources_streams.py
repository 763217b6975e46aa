"""Files, configuration and streams."""

import json
import uuid
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_operators import feedback, memories

from memlens import runtime
from memlens.operators import routing
from memlens.schemas import FEEDBACK, MEMORY
from memlens.sources import portable
from memlens.streaming import jobs


def test_cut_is_durable_and_small_is_checked(spark):
    df = runtime.cut(spark.range(10))
    assert df.count() == 10 and df.inputFiles()[0].startswith("file:") and runtime.estimated_bytes(df) > 0
    assert "broadcast" in runtime.small(df)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in runtime.small(df, limit=1)._jdf.queryExecution().logical().toString().lower()
    runtime.drop_table(df)
    with pytest.raises(Exception):
        df.collect()


def test_json_round_trip(spark, tmp_path):
    m = memories(spark, dict(id="a", tags='["x"]'), dict(id="b", project="p"), dict(id="c", superseded_by="a"))
    portable.write_export(m, str(tmp_path / "out"))
    back = portable.read_lines(spark, str(tmp_path / "out"))
    assert rows(back.select("id", "tags", "project")) == [("a", '["x"]', None), ("b", None, "p")]
    one = {"version": 1, "memories": [r.asDict() for r in back.collect()]}
    (tmp_path / "e.json").write_text(json.dumps(one, indent=1))
    assert rows(portable.read_export(spark, str(tmp_path / "e.json")).select("id", "score")) == [("a", 0.5), ("b", 0.5)]
    (tmp_path / "v2.json").write_text(json.dumps({"version": 2, "memories": []}))
    with pytest.raises(portable.BadInput):
        portable.read_export(spark, str(tmp_path / "v2.json"))


def test_messages(spark, tmp_path):
    lines = ['{"type":"progress","stage":"x","percent":0.5}', "", '{"type":"insight","id":"i","context":"c","source_ids":"a,b"}', '{"type":"metric","name":"n","value":1}']
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    got = portable.read_messages(spark, str(tmp_path / "m.jsonl"))
    assert got.count() == 3 and portable.insights_of(got).first().source_ids == "a,b"
    (tmp_path / "bad.jsonl").write_text('{"type":"x"}\nnot json')
    with pytest.raises(Exception):
        portable.read_messages(spark, str(tmp_path / "bad.jsonl")).collect()
    assert spark.range(1).select(portable.message("metric", name=F.lit("n"), value=F.lit(1.5)).alias("m")).first().m == '{"type":"metric","name":"n","value":1.5}'
    assert [r.value for r in portable.to_lines(spark.createDataFrame([(1, None)], "a int, b string"), "text").collect()] == ["a: 1\nb: "]


def test_tables_and_model_folder(spark, tmp_path):
    assert portable.open_table(spark, str(tmp_path / "none"), MEMORY).count() == 0
    memories(spark, dict(id="a")).write.parquet(str(tmp_path / "t"))
    assert portable.open_table(spark, str(tmp_path / "t"), MEMORY).first().id == "a"
    (tmp_path / "models").mkdir()
    for n in ("b.onnx", "a.json", "skip.bin"):
        (tmp_path / "models" / n).write_text("xx")
    assert [(r.name, r.size) for r in portable.model_files(spark, str(tmp_path / "models")).collect()] == [("a.json", 2), ("b.onnx", 2)]
    assert portable.models_stale(spark, str(tmp_path / "models"), datetime(2100, 1, 1)) and not portable.models_stale(spark, str(tmp_path / "models"), datetime(2000, 1, 1))


def test_config_layers(tmp_path):
    (tmp_path / "g.toml").write_text('[search]\nrrf_k = 10\n[embedding]\napi_key = "s"\nlist = [1, 2]\n')
    (tmp_path / "p.toml").write_text('[search]\nvector_weight = 1.0\n[embedding]\napi_key = "other"\nlist = [3]\n')
    c = portable.load_config(str(tmp_path / "g.toml"), str(tmp_path / "p.toml"), {"MEMLENS_SEARCH__TEXT_WEIGHT": "0.5", "X": "1"})
    assert c["search"] == {"rrf_k": 10, "vector_weight": 1.0, "text_weight": 0.5} and c["embedding"]["list"] == [3] and c["embedding"]["api_key"] == "s"
    assert portable.public_config(c)["embedding"]["has_api_key"] and "api_key" not in portable.public_config(c)["embedding"]
    for bad in ({"MEMLENS_DEDUP__THRESHOLD": "1.5"}, {"MEMLENS_SEARCH__RRF_K": "0"}, {"MEMLENS_SEARCH__TEXT_WEIGHT": "0", "MEMLENS_SEARCH__VECTOR_WEIGHT": "0"}):
        with pytest.raises(portable.BadInput):
            portable.load_config(env=bad)


def test_request_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text('{"id":"1","method":"memory_search","params":{"query":"x"}}\nnot json\n\n{"id":"2"}\n')
    seen = {"good": [], "bad": []}

    def handle(good, bad, _):
        seen["good"] += [r.method for r in good.collect()]
        seen["bad"] += [r.code for r in bad.collect()]

    q = jobs.serve(spark, str(tmp_path / "in"), f"r{uuid.uuid4().hex}", handle)
    q.awaitTermination(60)
    assert seen == {"good": ["memory_search"], "bad": [4000, 4000]}


def drain(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_feedback_stream_equals_batch(spark, tmp_path):
    data = [("a", "q", "2024-01-01T00:00:00Z", False, None), ("a", "q", "2024-01-02T00:00:00Z", True, "t"), ("b", None, "2024-01-01T12:00:00+02:00", False, None)]
    feedback(spark, *data).write.parquet(str(tmp_path / "f"))
    live = drain(spark, jobs.judged_state(jobs.read_feedback(spark, str(tmp_path / "f"))), "complete", "judged_live")
    assert rows(live) == rows(jobs.judged_state(spark.read.schema(FEEDBACK).parquet(str(tmp_path / "f"))))
    windows = drain(spark, jobs.shown_by_window(jobs.read_feedback(spark, str(tmp_path / "f"))), "complete", "windows_live")
    assert [(r.shown, r.judged) for r in windows.orderBy("start").collect()] == [(2, 0), (1, 1)]


def test_bandit_stream_equals_batch(spark, tmp_path):
    ev = spark.createDataFrame([("search", f"s{i % 2}", "x", (i * 7 % 10) / 10, i) for i in range(40)], "router_level string, state string, action string, reward double, seq long")
    ev.where("seq < 20").coalesce(1).write.parquet(str(tmp_path / "e"))
    ev.where("seq >= 20").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    live = drain(spark, jobs.fold_stream(stream), "update", "bandit_live")
    last = {r.state: r for r in live.orderBy("update_count").collect()}
    for r in routing.fold_rewards(ev).collect():
        assert last[r.state].update_count == r.update_count == 20
        # the files come in either order, so the batch order decides the value
    assert all(0 <= r.value <= 1 for r in last.values())


def test_reindex_tick(spark):
    m = memories(spark, *[dict(id=f"x{i}", indexed=i % 2 == 0, embedding_context=b"1234") for i in range(10)])
    assert [r.id for r in jobs.reindex(m, lambda ids: ids, 3).collect()] == ["x1", "x3", "x5"]


def test_reindex_clock(spark):
    ticks = []
    assert jobs.reindex_every(spark, 0, ticks.append) is None
    q = jobs.reindex_every(spark, 1, ticks.append, f"c{uuid.uuid4().hex}", once=True)
    assert ticks and 0 not in ticks and not q.isActive


def test_responses_and_lines(spark):
    import json

    from pyspark.sql import functions as F

    q = spark.createDataFrame([("1", None), ("2", 4001)], "id string, code int")
    got = [json.loads(r.r) for r in q.select(portable.response(F.col("id"), F.struct("id"), F.col("code"), F.lit("bad")).alias("r")).collect()]
    assert got == [{"id": "1", "ok": True, "data": {"id": "1"}}, {"id": "2", "ok": False, "error": {"code": 4001, "message": "bad"}}]
    hits = spark.createDataFrame([("1", 1, "m", 0.5, "c", "a", "r", "bugfix", None)], "query_id string, place int, id string, score double, context string, action string, result string, memory_type string, tags string")
    text = portable.search_lines(hits, q.select(F.col("id").alias("query_id")), F.lit(True), "text").orderBy("query_id", "line").collect()
    assert [r.value.split("\n")[0] for r in text] == ["id: m", "degraded: true", "degraded: true"]
    lines = portable.search_lines(hits, q.select(F.col("id").alias("query_id")), F.lit(False)).orderBy("query_id", "line").collect()
    assert json.loads(lines[0].value)["id"] == "m" and [r.value for r in lines[1:]] == ['{"degraded":false}'] * 2
    assert json.loads(portable.error_line(ValueError("no"))) == {"type": "error", "message": "no"}
