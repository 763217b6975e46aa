"""Neighbours, clusters and history against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlens.llm import history, vectors
from memlens.llm.clusters import clusters, describe
from memlens.llm.history import History
from memlens.llm.neighbours import nearest
from memlens.llm.vectors import DIM, Tree, matrix, usable

BLOBS = ["embedding_context", "embedding_action", "embedding_result"]
SCHEMA = "id string, embedding_context binary, embedding_action binary, embedding_result binary, vec string, field int, n int"


def groups(count, size, noise, seed=0, dim=DIM):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((count, dim))
    v = np.repeat(centres / np.linalg.norm(centres, axis=1)[:, None], size, 0) + noise * rng.standard_normal((count * size, dim)) / np.sqrt(dim)
    return (v * rng.uniform(0.1, 9, (len(v), 1))).astype("<f4")


BAD = [None, b"", b"abc", bytes(256), np.full(DIM, np.nan, "<f4").tobytes(), np.ones(32, "<f4").tobytes(), np.ones(DIM, "<f8").tobytes()]


def table(spark, vectors, start=0):
    data = [(f"m{start + i:05d}", v[0].tobytes(), v[1].tobytes(), v[2].tobytes(), "x", 7, i) for i, v in enumerate(vectors)]
    data += [(f"bad{start + i}", b, b, b, None, None, None) for i, b in enumerate(BAD)]
    return spark.createDataFrame(data, SCHEMA)


def triple(v):
    return np.stack([v, v[:, ::-1], np.roll(v, 5, axis=1)], 1)


def cosines(v):
    x = v.astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x @ x.T


def true_near(v, k, least):
    c = cosines(v)
    np.fill_diagonal(c, -2)
    out = set()
    for i, row in enumerate(c):
        near = np.flatnonzero(row >= least)
        for j in near[np.lexsort((near, -row[near].round(12)))][:k]:
            out.add((f"m{i:05d}", f"m{j:05d}"))
    return out


def test_usable_takes_only_whole_finite_vectors():
    assert not usable(BAD).any()
    tiny = np.full(DIM, 1e-30, "<f4").tobytes()
    assert usable([tiny, None]).tolist() == [True, False]
    assert np.allclose(np.linalg.norm(matrix([tiny]), axis=1), 1)


def test_neighbours_equal_brute_force_on_ties_copies_and_bad_blobs(spark):
    v = groups(40, 6, 0.3)
    v[1], v[2] = v[0], v[0]
    v[50] = v[0] * 2
    found = nearest(table(spark, triple(v)), {"context": BLOBS[0], "result": BLOBS[2]}, k=5, least=0.85)
    got = {(r.id, r.neighbour_id) for r in found.where("field_name = 'context'").collect()}
    truth = true_near(v, 5, 0.85)
    assert len(got & truth) / len(truth) > 0.99 and got == {(r.id, r.neighbour_id) for r in found.where("field_name = 'result'").collect()}


def test_neighbours_of_a_vector_that_a_third_of_rows_share(spark):
    v = groups(30, 4, 0.3)
    v = np.concatenate([v, np.repeat(v[:1], 60, 0)])
    got = nearest(table(spark, triple(v)), {"context": BLOBS[0]}, k=5)
    by = {}
    for r in got.collect():
        by.setdefault(r.id, set()).add(r.neighbour_id)
    copies = ["m00000"] + [f"m{i:05d}" for i in range(120, 180)]
    for c in copies:
        assert by[c] == set([x for x in copies if x != c][:5])
    assert len(by) == 180


def test_neighbours_of_nothing(spark):
    empty = table(spark, triple(groups(1, 1, 0)))
    assert nearest(empty.limit(0), {"context": BLOBS[0]}).count() == 0
    assert nearest(empty, {"context": BLOBS[0]}).count() == 0


def test_tree_recall_on_many_leaves():
    v = groups(1500, 4, 0.45, seed=3)
    x = v / np.linalg.norm(v, axis=1)[:, None]
    tree = Tree(x[::2], len(x), leaf_rows=100)
    assert tree.leaf.sum() > 40
    visits = tree.calibrate(x[::2], 0.8, 0.99, 1)
    at = tree.visit(x, visits)
    c = x @ x.T
    np.fill_diagonal(c, 0)
    a, b = np.nonzero(c >= 0.8)
    assert len(a) > 100 and (at[a][:, :, None] == at[b][:, None, :]).any((1, 2)).mean() > 0.97
    assert (np.sort(at, 1)[:, 1:] != np.sort(at, 1)[:, :-1]).all()  # no leaf twice


def true_groups(v, least):
    c = cosines(v) >= least
    label = np.arange(len(v))
    while True:
        new = np.where(c, label[None, :], len(v)).min(1)
        if (new == label).all():
            return label
        label = new


def test_clusters_are_components(spark):
    v = groups(50, 5, 0.4, seed=1)
    v = np.concatenate([v, v[:1], v[:1]])
    label = true_groups(v, 0.85)
    truth = {(f"m{label[i]:05d}", f"m{i:05d}") for i in range(len(v)) if (label == label[i]).sum() > 1}
    found = clusters(table(spark, triple(v)), BLOBS[0])
    assert {(r.cluster_id, r.id) for r in found.collect()} == truth
    told = {r.cluster_id: r for r in describe(found).collect()}
    for c, r in told.items():
        assert r["size"] == sum(1 for t in truth if t[0] == c) and 1 <= len(r["typical"]) <= 3
    assert clusters(table(spark, triple(v)).limit(0), BLOBS[0]).count() == 0


def test_clusters_with_a_frequent_vector(spark):
    v = np.concatenate([groups(10, 3, 0.2), np.repeat(groups(1, 1, 0, seed=9), 70, 0)])
    found = {(r.cluster_id, r.id) for r in clusters(table(spark, triple(v)), BLOBS[0]).collect()}
    assert {i for c, i in found if c == "m00030"} == {f"m{i:05d}" for i in range(30, 100)}


def test_density_counts_all_copies_of_a_frequent_vector(spark):
    """70 copies outweigh 20 rows by their side, which are near some of the others only."""
    angles = np.concatenate([np.linspace(-0.6, -0.5, 20), np.zeros(70), [0.4]])
    v = np.zeros((len(angles), DIM), "<f4")
    v[:, 0], v[:, 1] = np.cos(angles), np.sin(angles)
    near = cosines(v) >= 0.85
    found = clusters(table(spark, triple(v)), BLOBS[0])
    assert {r.id: r.density for r in found.collect()} == {f"m{i:05d}": int(near[i].sum()) - 1 for i in range(len(v))}
    best = sorted(range(len(v)), key=lambda i: (-near[i].sum(), i))[:3]
    assert [r.typical for r in describe(found).collect()] == [[f"m{i:05d}" for i in best]]


def peaks_of(v, ids, least):
    """Density, delta and peak of every row by the definition."""
    c = cosines(v)
    near = c >= least
    density = near.sum(1) - 1
    rank = {i: r for r, i in enumerate(sorted(range(len(v)), key=lambda i: (-density[i], ids[i])))}
    up = {}
    for i in range(len(v)):
        denser = [j for j in range(len(v)) if near[i, j] and rank[j] < rank[i]]
        up[i] = min(denser, key=lambda j: (-round(c[i, j], 9), rank[j]), default=None)
    out = {}
    for i in range(len(v)):
        at = i
        while up[at] is not None:
            at = up[at]
        out[ids[i]] = (density[i], None if up[i] is None else round(1 - c[i, up[i]], 6), ids[at])
    return {k: t for k, t in out.items() if t[0]}


@pytest.mark.parametrize("rows", [8000, 40])
def test_density_delta_and_peaks_are_global(spark, monkeypatch, rows):
    """Chains of groups over many leaves, with leaves split into blocks too."""
    monkeypatch.setattr(vectors, "LEAF_ROWS", 60)
    monkeypatch.setattr("memlens.llm.vectors.hot_leaves.__defaults__", (rows,))
    monkeypatch.setattr("memlens.llm.vectors.fit_trees.__defaults__", (60, "id"))
    angles = np.random.default_rng(4).uniform(0, 12, 150)
    v = np.concatenate([groups(60, 4, 0.35, seed=2), np.zeros((150, DIM), "<f4")])
    v[240:, 0], v[240:, 1], v[240:, 2] = np.cos(angles), np.sin(angles), angles / 3
    ids = [f"m{i:05d}" for i in range(len(v))]
    got = {r.id: (r.density, r.delta if r.delta is None else round(r.delta, 6), r.peak) for r in clusters(table(spark, triple(v)), BLOBS[0], recall=1.0).collect()}
    truth = peaks_of(v, ids, 0.85)
    assert got == truth and len({t[2] for t in truth.values()}) > 50
    label = true_groups(v, 0.85)
    found = {(r.cluster_id, r.id) for r in clusters(table(spark, triple(v)), BLOBS[0], recall=1.0).collect()}
    assert found == {(ids[label[i]], ids[i]) for i in range(len(v)) if (label == label[i]).sum() > 1}


def test_neighbours_in_split_leaves(spark, monkeypatch):
    v = groups(30, 8, 0.3, seed=6)
    plain = {tuple(r) for r in nearest(table(spark, triple(v)), {"context": BLOBS[0]}, k=5).collect()}
    monkeypatch.setattr("memlens.llm.vectors.hot_leaves.__defaults__", (50,))
    assert {tuple(r) for r in nearest(table(spark, triple(v)), {"context": BLOBS[0]}, k=5).collect()} == plain and len(plain) > 1000


def test_visits_widen_until_the_rate_is_reached():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, DIM))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = Tree(x, len(x), leaf_rows=30)
    leaves = int(tree.leaf.sum())
    assert leaves > 30 and 8 < tree.calibrate(x, 0.1, 0.97, 1) <= leaves and tree.calibrate(x, 0.5, 1.1, 1) == leaves
    assert tree.calibrate(x, 0.5, 0.97, 1, one_sided=True) >= tree.calibrate(x, 0.5, 0.97, 1)


def greedy(old, new, least):
    def near(a, b):
        return min(float(a[i].astype(float) @ b[i].astype(float) / np.linalg.norm(a[i].astype(float)) / np.linalg.norm(b[i].astype(float))) for i in range(3)) > least

    kept, cases = list(old), []
    for n, v in enumerate(new):
        if any(near(v, k) for k in kept):
            cases.append(n)
        else:
            kept.append(v)
    return cases


def batch(spark, vectors, first=0):
    return table(spark, vectors).where("id like 'm%'").withColumn("arrival", F.col("n") + first).unionByName(table(spark, vectors[:0]).withColumn("arrival", -F.length("id")))


@pytest.mark.parametrize("together", [True, False])
def test_history_accepts_as_one_by_one(spark, together):
    v = triple(groups(40, 8, 0.22, seed=5))
    rng = np.random.default_rng(2)
    order = rng.permutation(len(v))
    old, new = v[order[:60]], v[order[60:]]
    new = np.concatenate([new, new[:5], old[:2]])
    truth = greedy(old, new, 0.95)
    store = History(table(spark, old))
    if together:
        got = [r.arrival for r in store.absorb(batch(spark, new), ["arrival"]).collect()]
    else:
        got = []
        for i in range(0, len(new), 90):
            got += [r.arrival for r in store.absorb(batch(spark, new[i : i + 90], i), ["arrival"]).collect()]
        assert len(store.runs) == 1 + -(-len(new) // 90)
        store.compact(1)
        assert len(store.runs) == 1
        again = History.open(spark, store.path)  # as another process would
        assert again.absorb(batch(spark, new), ["arrival"]).count() == len(new)
        assert len(History.open(spark, store.path).runs) == len(again.runs)
    assert sorted(got) == truth and len(truth) > 50


def test_history_asks_for_more_neighbours_than_it_lists(spark):
    """A row near many refused rows is accepted only after all of them are known."""
    base = np.zeros((1, DIM), "<f4")
    base[0, 0] = 1
    ring = np.repeat(base, 20, 0)
    for i in range(20):
        ring[i, 0], ring[i, 1], ring[i, 2 + i] = np.cos(0.25), np.sin(0.25) * 0.99, 0.01
    far = np.repeat(base, 1, 0)
    far[0, 0], far[0, 1] = np.cos(0.42), np.sin(0.42)
    v = np.concatenate([base, ring, far])
    v = np.stack([v, v, v], 1)
    truth = greedy([], v, 0.95)
    assert truth == list(range(1, 21))  # the ring is refused, the last row has 20 refused neighbours
    got = History(table(spark, v[:0])).absorb(batch(spark, v), ["arrival"])
    assert sorted(r.arrival for r in got.collect()) == truth


def test_history_reads_only_the_ranges_of_a_batch(spark, monkeypatch):
    """A record reads the same few files of a history ten times as large, and small runs are merged on the way."""
    monkeypatch.setattr(history, "PART_ROWS", 100)
    monkeypatch.setattr(history, "LEAF_ROWS", 20)
    v = triple(groups(1000, 2, 0.2, seed=8))
    read = []
    for rows in (200, 2000):
        h = History(table(spark, v[:rows]))
        assert [r.arrival for r in h.absorb(batch(spark, v[3:4]), ["arrival"]).collect()] == [0]
        read.append(h.touched)
    most = sum(k.probes for k in h.keys.values())  # a file for each leaf looked into, however many there are
    assert read[0][1] <= 5 and read[1][1] > 36 and read[1][0] <= most and read[1][0] < 14
    for i in range(6):
        h.append(spark.createDataFrame([(b.tobytes(), b.tobytes(), b.tobytes()) for b in groups(5, 1, 0, seed=20 + i)], "vec0 binary, vec1 binary, vec2 binary"))
        h.compact()
    assert len(h.runs) <= 5 and max(r["rows"] for r in h.runs) == 2000 + len(BAD)


def test_history_holds_equal_rows_once(spark):
    v = triple(np.concatenate([np.repeat(groups(1, 1, 0), 500, 0), groups(20, 2, 0.1, seed=3)]))
    h = History(table(spark, v))
    assert h._read(h.runs).count() == 2 * 41
    assert h.absorb(batch(spark, v[:2]), ["arrival"]).count() == 2


def test_a_batch_in_split_leaves(spark, monkeypatch):
    v = triple(groups(40, 8, 0.22, seed=5))
    truth = greedy([], v, 0.95)
    monkeypatch.setattr(history, "BLOCK_ROWS", 30)
    got = History(table(spark, v[:0])).absorb(batch(spark, v), ["arrival"])
    assert sorted(r.arrival for r in got.collect()) == truth


@pytest.mark.parametrize("stored", [0, 160])
def test_history_misses_nothing_where_the_sample_is_wrong(spark, monkeypatch, stored):
    """With one leaf to look into and no width, as a sample without near pairs may have it, all near records are still found."""
    monkeypatch.setattr(history, "LEAF_ROWS", 8)
    monkeypatch.setattr(history, "MARGIN", 0)
    monkeypatch.setattr("memlens.llm.vectors.Tree.calibrate", lambda *_, **__: 1)
    v = triple(groups(40, 8, 0.22, seed=5))[np.random.default_rng(4).permutation(320)]
    truth = greedy(v[:stored], v[stored:], 0.95)
    h = History(table(spark, v[:stored]))
    got = h.absorb(batch(spark, v[stored:]), ["arrival"])
    assert sorted(r.arrival for r in got.collect()) == truth and len(truth) > 50


def test_history_of_nothing(spark):
    v = triple(groups(3, 1, 0))
    assert History(table(spark, v[:0])).absorb(batch(spark, v[:0]), ["arrival"]).count() == 0
    assert History(table(spark, v)).absorb(batch(spark, v[:0]), ["arrival"]).count() == 0


@pytest.mark.parametrize("work", ["block_density", "block_pointers", "block_borders"])
def test_a_dense_block_stays_bounded(work):
    """All pairs of 3,000 rows are near; the vectors of a piece of them were gigabytes."""
    import tracemalloc

    import pandas as pd

    from memlens.llm import clusters as module

    v = 1 + 0.01 * np.random.default_rng(5).standard_normal((3000, DIM)).astype("<f4")
    ids = [f"m{i:05d}" for i in range(len(v))]
    pdf = pd.DataFrame({"id": ids, "vec": [x.tobytes() for x in v], "i": 0, "j": 0, "side": 0, "copies": 1, "density": len(v) - 1, "peak": ids[0], "lower": [[]] * len(v)})
    tracemalloc.start()
    out = getattr(module, work)(pdf, 0.85)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6, peak
    if work == "block_density":
        assert set(out["density"]) == {len(v) - 1} and len(out) == len(v)
    if work == "block_pointers":
        assert len(out) == len(v) - 1 and (out["up"] < out["id"]).all()
