"""Packed fields, text, time and vector functions against plain versions."""

import json
import re
import sqlite3

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memlens.functions import text as T
from memlens.functions import prompts as P
from memlens.functions.packed import MARK, explode_packed, split_packed
from memlens.functions.timeutil import instant, month_utc, strict_instant
from memlens.functions.vectors import cosine, deterministic_embedding, encode, fnv1a, fnv1a_64, hash_uniform, blob_to_vector, vector_to_blob

CASES = {
    "p95": ["p95"], '["onnx"]': ["onnx"], '"[\\"onnx\\"]"': ["onnx"], "['a', 'b']": ["a", "b"], "{lock,\"a, b\"}": ["lock", "a, b"], "{}": [], "[]": [],
    '"auth, sessions"': ["auth, sessions"], "a -> b": ["a", "b"], ",x,,y, ": ["x", "y"], "null": [], '"null"': ["null"], "[null, \"x\"]": ["x"],
    '"size 3"" disk";v2.1': ['size 3" disk', "v2.1"], '["caf\\u00e9-ui"]': ["café-ui"], ' ["cli", "x"': ["cli", "x"], '["a",]': ["a"],
    "a\r\nb\tc": ["a", "b", "c"], "dead letter": ["dead letter"], "a  b": ["a", "b"], '["it\'s"]': ["it's"], "['it\\'s \"q\"']": ["it's \"q\""],
    '"[\\"the \\\\\\"fast\\\\\\" path\\"]"': ['the "fast" path'], "": [], " ": [], f"a {MARK}0 b": ["a", "0 b"], "x,x": ["x", "x"], "[\n \"a\",\n \"b\"\n]": ["a", "b"],
}


def test_packed_cases(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "v string")
    got = {r.v: r.t for r in df.select("v", split_packed(F.col("v")).alias("t")).collect()}
    assert got == CASES


def test_packed_ids_split_at_blanks(spark):
    df = spark.createDataFrame([("mem-1  mem-2 mem-3",), ("mem-1 -> mem-2",), ('"mem-1", mem-2',)], "v string")
    assert [r.t for r in df.select(split_packed(F.col("v"), "id").alias("t")).collect()] == [["mem-1", "mem-2", "mem-3"], ["mem-1", "mem-2"], ["mem-1", "mem-2"]]


def test_packed_positions_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([("r", "a,b", 1, 2), ("s", None, 1, 2), (None, "c", 1, 2)], "id string, tags string, pos int, item int")
    got = explode_packed(df, {"t": ("tags", "tag")})
    assert rows(got) == [("t", "r", 1, "a"), ("t", "r", 2, "b"), ("t", None, 1, "c")] and dict(got.dtypes)["pos"] == "bigint"
    assert explode_packed(df.limit(0), {"t": ("tags", "tag")}).count() == 0


def test_packed_long_text(spark):
    df = spark.createDataFrame([(",".join(f'"v{i}, x"' for i in range(20_000)),)], "v string")
    assert df.select(F.size(split_packed(F.col("v")))).first()[0] == 20_000
    open_quote = spark.createDataFrame([('"' + "a" * 100_000,)], "v string")
    assert open_quote.select(F.size(split_packed(F.col("v")))).first()[0] == 1


ITEM = st.text(alphabet='ab ,;|"\\é', min_size=1, max_size=8).filter(lambda s: s.strip() and s.strip().lower() != "null" and not (s.strip().startswith('"') and s.strip().endswith('"')))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(ITEM, max_size=5), min_size=20, max_size=40))
def test_packed_json_round_trip(spark, lists):
    data = [(i, json.dumps(v), json.dumps(json.dumps(v))) for i, v in enumerate(lists)]
    df = spark.createDataFrame(data, "i int, once string, twice string")
    got = df.select("i", split_packed(F.col("once")).alias("a"), split_packed(F.col("twice")).alias("b")).collect()
    for r in got:
        want = [x.strip() for x in lists[r.i]]
        assert r.a == want and r.b == want


def test_packed_layers_are_all_undone(spark):
    """Lists and values encoded six times and more come out as they were."""
    import json

    data = []
    for layers in range(8):
        field, value = json.dumps(["a b", "c"]), "x, y"
        for _ in range(layers):
            field, value = json.dumps(field), json.dumps(value)
        data.append((layers, field, json.dumps([value, "z"])))
    df = spark.createDataFrame(data, "n int, field string, value string")
    for r in df.select("n", split_packed(F.col("field")).alias("f"), split_packed(F.col("value")).alias("v")).collect():
        assert r.f == ["a b", "c"] and r.v == ["x, y", "z"], r.n


def test_times(spark):
    df = spark.createDataFrame([("2024-01-31T22:30:00-05:00",), ("2024-01-31 22:30:00",), ("2024-01-31T22:30:00.5Z",), ("2024-02-01",), ("junk",), (None,)], "v string")
    got = [(r.m, r.s) for r in df.select(month_utc(instant(F.col("v"))).alias("m"), strict_instant(F.col("v")).isNotNull().alias("s")).collect()]
    assert got == [("2024-02", False), ("2024-01", False), ("2024-01", False), ("2024-02", False), (None, False), (None, False)]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert df.select(month_utc(instant(F.col("v")))).first()[0] == "2024-02"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stemmer_matches_full_text_index():
    """The index of the bundled database stems with the same algorithm."""
    words = """caresses ponies caress cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing
    happy sky relational conditional rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator
    feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness
    revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption communism activate effective
    bowdlerize probate rate cease controll roll payments payment queue queued running retries caching indexes is as was""".split()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, 'row')")
    for w in words:
        db.execute("delete from t")
        db.execute("insert into t values (?)", (w,))
        assert [r[0] for r in db.execute("select term from v")] == [T.porter(w)], w


def test_tag_forms(spark):
    cases = {'["a", ""]': '["a"]', '["a",1]': '["[\\"a\\"","1]"]', "a, b": '["a","b"]', " x ": '["x"]', "": None, " , ": None, "[]": None, None: None, '[" a "]': '[" a "]'}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.t for r in df.select("v", T.normalize_tags(F.col("v")).alias("t")).collect()} == cases
    tagged = spark.createDataFrame([('["A","b"]',), ('["a"]',), ("a,b",), (None,), ('["a",1]',)], "v string")
    assert [r.h for r in tagged.select(T.has_tags(F.col("v"), ["a", "B"]).alias("h")).collect()] == [True, False, False, False, False]
    assert tagged.where(T.has_tags(F.col("v"), [])).count() == 5


def test_small_text_functions(spark):
    df = spark.createDataFrame([("react-hook-form, ok?",)], "v string")
    r = df.select(T.query_terms(F.col("v")).alias("q"), T.probe_text(F.col("v")).alias("p"), T.word_count(F.col("v")).alias("n")).first()
    assert r.q == ["react", "hook", "form", "ok"] and r.p == "reacthookform ok" and r.n == 2
    replies = spark.createDataFrame([("<think>a</think> merge now",), ("KEEP",), (" Merge",)], "v string")
    assert [x.m for x in replies.select(T.merge_verdict(T.strip_thinking(F.col("v"))).alias("m")).collect()] == ["merge", "keep", "merge"]
    scores = spark.createDataFrame([('{"score": 1.7, "reason": "x"}',), ("no",)], "v string")
    assert [x.s for x in scores.select(P.judge_reply(F.col("v")).alias("s")).collect()] == [(1.0, "x"), None]
    one = spark.createDataFrame([("q {context}", "c", None, "r")], "q string, c string, a string, r string")
    said = one.select(P.judge_prompt(F.col("q"), F.col("c"), F.col("a"), F.col("r")).alias("p")).first().p
    assert "Query: q {context}\n" in said and "- Context: c\n- Action: \n- Result: r\n" in said and said.endswith('{"score": <float>, "reason": "<string>"}')
    assert df.select(T.preview(F.lit("é" * 60))).first()[0] == "é" * 60 + "..." and df.select(T.preview(F.lit("x" * 80))).first()[0] == "x" * 80
    assert df.select(T.audit_ids(F.lit('["a","b"]'))).first()[0] == ["a", "b"] and df.select(T.audit_ids(F.lit("raw"))).first()[0] == ["raw"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0], [-3.0]), ([0.0], [1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, -1.0, 0.0, None, None]
    blobs = spark.createDataFrame([(encode([1.5, -2.0]),), (b"abc",), (None,)], "v binary")
    assert [r.v for r in blobs.select(blob_to_vector("v").alias("v")).collect()] == [[1.5, -2.0], None, None]
    assert blobs.select(vector_to_blob(blob_to_vector("v")).alias("v")).first().v == encode([1.5, -2.0])
    text = spark.createDataFrame([("abcab",), ("",), (None,)], "v string")
    e = [np.array(r.e) for r in text.select(deterministic_embedding(3)("v").alias("e")).collect()]
    want = np.array([97 + 97, 98 + 98, 99]) / 255
    assert np.allclose(e[0], want / np.linalg.norm(want), atol=1e-6) and not e[1].any()
    assert fnv1a([b"", b"a", b"foobar"]).tolist() == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    h = text.select(fnv1a_64("v").alias("h"), hash_uniform(fnv1a_64("v")).alias("u")).collect()
    assert h[0].h % 2**64 == int(fnv1a([b"abcab"])[0]) and 0 <= h[0].u < 1 and h[2].h is None


@pytest.mark.parametrize("word", ["naïve", "Größe"])
def test_fold(word):
    assert re.fullmatch("[a-zß]+", T.fold(word))
