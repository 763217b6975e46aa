"""Set join, tokens, leaks and reading levels against plain versions."""

import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from memlens.llm import setjoin
from memlens.llm.leaks import _by_join, leaks, report, words
from memlens.llm.reading import GradeModel, consensus, fit, prose_words, reading_levels
from memlens.llm.setjoin import WORD, near_duplicates
from memlens.llm.tokens import PATTERN, VOCABULARY, encode, load_ranks, merge_word


def true_pairs(records, least=0.75, least_words=12):
    bags = {i: Counter(WORD.findall(" ".join(t or "" for t in texts).lower())) for i, *texts in records if i is not None}
    bags = {i: b for i, b in bags.items() if sum(b.values()) >= least_words}
    ids = sorted(bags)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sum((bags[a] & bags[b]).values()) >= least * sum((bags[a] | bags[b]).values())}


def retold(count, seed=0, length=30, vocabulary=400):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    out = []
    for i in range(count):
        if out and rng.random() < 0.6:
            text = (rng.choice(out)[1]).split()
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rng.shuffle(text)
        else:
            text = [rng.choice(vocab[:20] if rng.random() < 0.4 else vocab) for _ in range(length)]
        out.append((f"r{i:04d}", " ".join(text), None if i % 7 else "", "Extra, Words!" if i % 3 else None))
    return out


SCHEMA = "id string, a string, b string, c string"


def test_set_join_equals_brute_force(spark):
    data = retold(400) + [(None, "x " * 20, None, None), ("short", "a b c", "", None), ("long", "word " * 30_000, "", "")]
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as tokens", "2 as kind", "3 as node")
    got = [tuple(r) for r in near_duplicates(df, ["a", "b", "c"]).collect()]
    truth = true_pairs(data)
    assert len(got) == len(set(got)) and set(got) <= truth
    assert len(truth) > 200 and len(set(got)) / len(truth) > 0.98


def test_set_join_branches_and_blocks_large_nodes(spark, monkeypatch):
    """With tiny nodes every level and the blocks of nodes that stay large take part."""
    monkeypatch.setattr(setjoin, "NODE_ROWS", 8)
    monkeypatch.setattr(setjoin, "LEVELS", 2)
    monkeypatch.setattr(setjoin, "BLOCK_ROWS", 16)
    data = retold(300, seed=4, vocabulary=60)
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(data, SCHEMA), ["a", "b", "c"]).collect()}
    truth = true_pairs(data)
    assert got <= truth and len(got) / len(truth) > 0.97


def test_set_join_grows_trees_until_enough_is_found(spark, monkeypatch):
    """Trees that lose most pairs are repeated, so that far more is found than in one go."""
    monkeypatch.setattr(setjoin, "NODE_ROWS", 4)
    monkeypatch.setattr(setjoin, "LEVELS", 1)
    monkeypatch.setattr(setjoin, "TREES", 2)
    monkeypatch.setattr(setjoin, "CHILDREN_SHARE", 1.2)
    data = retold(300, seed=7)
    df, truth = spark.createDataFrame(data, SCHEMA), true_pairs(data)
    found = {}
    for goes in (1, 6):
        monkeypatch.setattr(setjoin, "GOES", goes)
        found[goes] = {tuple(r) for r in near_duplicates(df, ["a", "b", "c"]).collect()}
        assert found[goes] <= truth
    assert len(found[1]) < 0.97 * len(truth) and len(found[6]) > len(found[1]) and len(found[6]) > 0.97 * len(truth)


def test_set_join_of_a_class_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "CLASS_ROWS", 7)
    same = [(f"x{i:02d}", "one two three four five six seven eight nine ten eleven twelve", None, None) for i in range(40)]
    got = near_duplicates(spark.createDataFrame(same, SCHEMA), ["a", "b", "c"]).collect()
    assert len(got) == len(set(got)) == 40 * 39 // 2


def one_group(count, others, seed=5, length=60, edits=9):
    """Distinct near copies of one text, each with up to ``edits`` other words, among unlike records."""
    rng = random.Random(seed)
    rare = [f"r{i}" for i in range(3000)]
    base = [f"b{i}" for i in range(length)]
    out = []
    for i in range(count):
        text = list(base)
        for at in rng.sample(range(length), rng.randint(3, edits)):
            text[at] = rng.choice(rare)
        out.append((f"g{i:05d}", " ".join(text), None, None))
    return out + [(f"o{i:05d}", " ".join(rng.choice(rare) for _ in range(length)), None, None) for i in range(others)]


def test_set_join_of_a_large_group_of_near_copies(spark):
    """With the constants as they are, nodes of over a thousand distinct near copies lose under a hundredth of the pairs."""
    data = one_group(1500, 1500)
    vocab = {}
    at = [[vocab.setdefault(w, len(vocab)) for w in set(r[1].split())] for r in data]
    x = np.zeros((1500, len(vocab)), np.float32)
    for i in range(1500):
        x[i, at[i]] = 1
    common, n = x @ x.T, x.sum(1)
    true = np.triu(common / (n[:, None] + n - common) >= 0.75 - 1e-6, 1)
    got = near_duplicates(spark.createDataFrame(data, SCHEMA), ["a", "b", "c"]).toPandas()
    a, b = (got[c].str[1:].astype(int).to_numpy() for c in ("id_a", "id_b"))
    assert true[a, b].all() and true.sum() > 100_000 and len(got) / true.sum() > 0.99


def test_set_join_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty, ["a", "b", "c"]).count() == 0
    same = spark.createDataFrame([(f"x{i}", "one two three four five six seven eight nine ten eleven twelve", None, None) for i in range(3)], SCHEMA)
    assert {tuple(r) for r in near_duplicates(same, ["a", "b", "c"]).collect()} == {("x0", "x1"), ("x0", "x2"), ("x1", "x2")}


def test_encoding_equals_the_public_library(spark):
    import tiktoken

    rng = random.Random(1)
    texts = [None, "", " ", "hello  world\n\n x", "naïve café 日本語 🐛🐛", "<|endoftext|>", "a" * 3000, "x=1;" * 500, "\t\r\n", "it's we'll"]
    texts += ["".join(rng.choice("ab e\n1.é日") for _ in range(200)) for _ in range(30)]
    texts += ["".join(chr(rng.randrange(1, 0x2FFF)) for _ in range(400)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in encode(df).collect()}
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(VOCABULARY), special_tokens={})
    assert got == {i: plain.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert encode(df.limit(0)).count() == 0


def test_short_and_long_words_merge_alike(monkeypatch):
    from memlens.llm import tokens

    ranks, rng = load_ranks(VOCABULARY), random.Random(3)
    for _ in range(200):
        word = "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 120))).encode()
        short = merge_word(word, ranks)
        assert tokens._merge_long(word, ranks) == short if word not in ranks else True


ITEMS = "item_id string, suite string, passage string"


def leak_tables(spark):
    p = " ".join(f"tok{i}" for i in range(40))
    q = " ".join(f"other{i}" for i in range(30))
    w = p.split()
    docs = [
        (1, "intro " + " ".join(w[5:17]) + " end"), (2, " ".join(w[5:16])), (3, None), (4, ""), (5, p.upper().replace(" ", ", ")), (6, " ".join(w[20:40] + w[:20])),
        (7, q + " x " + p), (8, "the " * 5000), (9, p.replace("tok5 ", "t​ók5 ")), (5, p),
    ]
    items = [("a", "s", p), ("b", "s", q), ("c", "s", None), ("d", "s", "too short"), ("e", "s", "the " * 60), (None, "s", p)]
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'z' as item_id", "1 as h"), spark.createDataFrame(items, ITEMS)


def test_leaks_find_runs_of_twelve(spark):
    docs, items = leak_tables(spark)
    found = leaks(docs, items)
    got = sorted((r.doc_id, r.item_id, r.longest) for r in found.collect())
    assert got == [(1, "a", 12), (5, "a", 40), (5, "a", 40), (6, "a", 20), (7, "a", 40), (7, "b", 30), (8, "e", 60), (9, "a", 40)]
    cover = {(r.doc_id, r.item_id): r.coverage for r in found.collect()}
    assert cover[6, "a"] == 1.0 and cover[1, "a"] == 0.3  # reordered halves are both tiles
    assert {r.item_id: r.documents for r in report(found).collect()} == {"a": 6, "b": 1, "e": 1}


def test_leaks_by_broadcast_and_by_join_are_the_same(spark):
    docs, items = leak_tables(spark)
    want = sorted(map(tuple, leaks(docs, items).collect()))
    assert sorted(map(tuple, leaks(docs, items, broadcast_seeds=60).collect())) == want
    assert sorted(map(tuple, leaks(docs, items, coverage=0.9, broadcast_seeds=60).collect())) == [w for w in want if w[3] >= 0.9] != want
    joined = _by_join(docs.where("doc_id <> 5"), "doc_id", "text", items.where("item_id is not null and passage is not null"), 12)
    assert sorted(map(tuple, joined.collect())) == [w for w in want if w[0] != 5]
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0


def test_words_are_folded():
    assert words("ﬁne Ｆｏｏ-Bar_é​1") == ["fine", "foo", "bar", "e1"] and words(None) == []


EASY = "The cat sat on the mat and the dog ran to the gate. "
HARD = "Notwithstanding the institutional heterogeneity, the orchestration of the methodology substantiated our multidimensional generalization. "


def grade_tables(spark):
    docs = [(i, EASY * 6) for i in range(5)] + [(i, HARD * 6) for i in range(10, 15)]
    docs += [(20, None), (21, ""), (22, EASY), (23, "```\n" + EASY * 9 + "\n```"), (24, "| a | b |\n" * 50), (25, "let x = foo(3);\n" * 60), (26, "Der Hund und die Katze sind im Haus und im Garten. " * 9)]
    docs += [(27, "# A long heading of words\n\n" + EASY * 6), (28, HARD * 2000)]
    labels = [(0, "r1", 1), (0, "r1", 1), (0, "r2", 2), (0, "r3", 1), (1, "r1", 1), (10, "r1", 5), (11, "r1", 5), (11, "r2", None), (None, "r1", 3), (99, "r1", 4)]
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as grade", "'y' as word"), spark.createDataFrame(labels, "doc_id long, rater string, grade int")


def test_reading_levels_of_prose_only(spark):
    docs, labels = grade_tables(spark)
    assert {r.doc_id: r.grade for r in consensus(labels).collect()} == {0: 1, 1: 1, 10: 5, 11: 5, 99: 4}
    got = {r.doc_id: r.grade for r in reading_levels(docs, fit(docs, labels)).collect()}
    assert got == {**dict.fromkeys([0, 1, 2, 3, 4, 27], 1), **dict.fromkeys([10, 11, 12, 13, 14, 28], 5)}


def test_the_gate_is_learnt(spark):
    """What rated documents share tells their kind; other words, however many, don't pass."""
    docs, labels = grade_tables(spark)
    model = fit(docs, labels)
    assert {"the", "cat", "institutional"} <= model.gate.common and "hund" not in model.gate.common and 0 < model.gate.share < 1
    assert model.gate.passes(EASY.lower().replace(".", "").split()) and not model.gate.passes("der hund und die katze".split())


def test_held_out_gate():
    """The gate of one half of the rated documents passes the other half, and of documents labelled with another language only those that are English all the same."""
    import pyarrow.parquet as pq

    from memlens.llm.reading import COMMON, SLACK, TAIL, Gate

    d = "/root/testdata/sf0.1"
    docs = pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pandas().set_index("doc_id")
    rated = sorted(pq.read_table(f"{d}/reading_labels.parquet").to_pandas().dropna()["doc_id"].unique())
    known, held = ([prose_words(docs["text"][i]) for i in rated[k::2]] for k in (0, 1))
    inside = Counter(w for words in known for w in set(words))
    gate = Gate({w for w, n in inside.items() if n >= COMMON * len(known)}, 0)
    gate = Gate(gate.common, SLACK * sorted(map(gate.of, known))[len(known) // TAIL])
    assert np.mean([gate.passes(w) for w in held]) > 0.995
    foreign = docs[docs["lang"].isin(["de", "fr", "es", "ru", "zh", "ja", "it", "pt", "nl"])]
    passed = [t for t in foreign["text"] if (w := prose_words(t)) and gate.passes(w)]
    stop = set("the a an our one this each every and".split())
    english = [sum(w in stop for w in prose_words(t)) / len(prose_words(t)) for t in passed]
    assert min(english, default=1) > 0.05  # what passes is English prose under a wrong label


def test_reading_levels_without_labels_or_texts(spark):
    docs, labels = grade_tables(spark)
    assert reading_levels(docs, fit(docs, labels.limit(0))).count() == 0
    assert reading_levels(docs.limit(0), fit(docs, labels)).count() == 0


def test_held_out_accuracy():
    """Half of the ratings of the small table grade the other half."""
    import pandas as pd
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.1"
    docs = pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pandas().set_index("doc_id")["text"]
    labels = pq.read_table(f"{d}/reading_labels.parquet").to_pandas().dropna().drop_duplicates()
    best = labels.groupby("doc_id")["grade"].agg(lambda g: int(g.mode()[0]))
    rows, held = [], []
    for i, g in best.items():
        w = prose_words(docs[i])
        (held if i % 2 else rows).append((g, w))
    counts = Counter((g, x) for g, w in rows for x in w)
    model = GradeModel(
        pd.DataFrame([(g, x, n) for (g, x), n in counts.items()], columns=["grade", "word", "n"]),
        pd.DataFrame(Counter(g for g, _ in rows).items(), columns=["grade", "documents"]),
    )
    right = np.mean([model.grade(w) == g for g, w in held if w])
    assert len(held) > 200 and right > 0.9


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p4_found", "p6_found", "p6_described", "p6_density", "p8_ids", "p9_found", "p9_report", "p10_found"])
def test_queries_run(spark, sf, name):
    from memlens.llm.queries import ORACLE, QUERIES

    columns = {"p1_found": ["arrival_no"], "p2_found": ["field_name", "id", "neighbour_id"], "p4_found": ["id_a", "id_b"], "p6_found": ["cluster_id", "id"], "p6_described": ["cluster_id", "size", "typical"], "p6_density": ["id", "density"], "p9_report": ["item_id", "documents", "longest", "coverage"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "grade"]}
    df = QUERIES[name](spark, sf)
    got = df.collect()
    assert df.columns == columns[name] and (got or name == "p9_report")
    if name in ORACLE:
        duck = duckdb.connect()
        for f in os.listdir(sf):
            duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
        cursor = duck.execute(ORACLE[name])
        at = [[d[0] for d in cursor.description].index(c) for c in df.columns]
        assert sorted(map(tuple, got)) == sorted(tuple(r[i] for i in at) for r in cursor.fetchall())
