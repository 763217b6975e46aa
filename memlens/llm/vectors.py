"""Vectors in blobs and the hierarchical k-means tree that the vector operators share."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlens.runtime import cut, small

DIM = 64
FIELDS = ("context", "action", "result")
#: Rows of the bounded sample a tree is fitted on.
SAMPLE_ROWS = 32_000
#: Rows a leaf is planned for, children of a node, k-means steps.
LEAF_ROWS, BRANCH, STEPS = 2000, 64, 8
#: Every so many rows of the sample are kept from the fit, to calibrate visits with.
HELD_OUT = 8
#: Copies of one vector from which they are collapsed before the index.
HOT_COPIES = 32
#: Visits of a leaf from which it is split into blocks, the columns that name a block, and bytes of vectors dealt to one task.
BLOCK_ROWS, BLOCK, TASK_BYTES = 8000, ("field", "leaf", "i", "j"), 8 << 20


def usable(blobs: pd.Series | list, dim: int = DIM) -> np.ndarray:
    """Mask of blobs that are exactly ``dim`` finite little-endian float32, not all zero."""
    width = 4 * dim
    mask = np.fromiter((b is not None and len(b) == width for b in blobs), bool, len(blobs))
    if mask.any():
        v = np.frombuffer(b"".join(b for b, m in zip(blobs, mask) if m), "<f4").reshape(-1, dim)
        mask[np.flatnonzero(mask)] = np.isfinite(v).all(1) & (v != 0).any(1)
    return mask


def matrix(blobs: pd.Series | list, dim: int = DIM) -> np.ndarray:
    """Unit rows in double precision of usable blobs."""
    v = np.frombuffer(b"".join(blobs), "<f4").reshape(-1, dim).astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True) if len(v) else 1  # else squares of tiny or huge values are lost
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of unit rows, the same bits for a pair wherever it is met."""
    return (a * b).sum(1)


def all_above(pairs: list[tuple[np.ndarray, np.ndarray]], r: np.ndarray, c: np.ndarray, least: float, step: int = 1 << 15) -> np.ndarray:
    """Mask of pairs (row ``r`` of the left, ``c`` of the right unit rows) whose cosine is above ``least`` in every field; memory stays bounded."""
    ok = np.ones(len(r), bool)
    for i in range(0, len(r), step):
        part = ok[i : i + step]
        for left, right in pairs:
            part[part] = exact_cosine(left[r[i : i + step][part]], right[c[i : i + step][part]]) > least
    return ok


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(STEPS):
        at = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        norm = np.linalg.norm(total, axis=1)
        lost = norm < 1e-6
        total[lost], norm[lost] = x[rng.choice(len(x), int(lost.sum()))], 1
        c = (total / norm[:, None]).astype(np.float32)
    return c, (x @ c.T).argmax(1)


class Tree:
    """Spherical k-means tree. Visits go best bin first: a priority queue of open nodes by cosine."""

    def __init__(self, sample: np.ndarray, total: int, leaf_rows: int = LEAF_ROWS, seed: int = 7):
        """``sample``: unit rows drawn evenly from ``total`` rows."""
        x, rng = np.asarray(sample, np.float32), np.random.default_rng(seed)
        dim = x.shape[1] if x.ndim == 2 and len(x) else DIM
        centres, kids, held = [np.zeros(dim, np.float32)], [[]], [np.arange(len(x))]
        share = total / max(1, len(x))
        stack = [0]
        while stack:
            node = stack.pop()
            rows = held[node]
            k = min(BRANCH, math.ceil(len(rows) * share / leaf_rows), len(rows) // 4)
            if k < 2:
                continue
            c, at = _kmeans(x[rows], k, rng)
            used = [j for j in range(k) if (at == j).any()]
            if len(used) < 2:
                continue
            for j in used:
                kids[node].append(len(centres))
                centres.append(c[j])
                kids.append([])
                held.append(rows[at == j])
                stack.append(kids[node][-1])
        self.centres = np.array(centres)
        self.kids = np.full((len(kids), BRANCH), -1, np.int32)
        for n, own in enumerate(kids):
            self.kids[n, : len(own)] = own
        self.leaf = np.array([not own for own in kids])
        # what the best leaf below a node gains over the node itself, on the sample: nodes queue by the leaf they promise
        self.gain = np.zeros(len(kids), np.float32)
        for n in range(len(kids) - 1, -1, -1):
            if kids[n]:
                own = x[held[n]]
                self.gain[n] = ((own @ self.centres[kids[n]].T + self.gain[kids[n]]).max(1) - own @ self.centres[n]).mean()

    def visit(self, x: np.ndarray, leaves: int) -> np.ndarray:
        """The first ``leaves`` leaves a best-bin-first walk reaches, one row per vector; -1 where there are no more."""
        x = np.asarray(x, np.float32)
        return np.concatenate([self._visit(x[i : i + 4096], leaves) for i in range(0, len(x), 4096)] or [np.zeros((0, leaves), np.int32)])

    def _visit(self, x: np.ndarray, leaves: int) -> np.ndarray:
        n = len(x)
        rows, out, got = np.arange(n), np.full((n, leaves), -1, np.int32), np.zeros(n, int)
        queue, node_of = np.zeros((n, 1), np.float32), np.zeros((n, 1), np.int32)
        while True:
            j = queue.argmax(1)
            best, node = queue[rows, j], node_of[rows, j]
            live = (best > -np.inf) & (got < leaves)
            if not live.any():
                return out
            queue[rows, j] = -np.inf
            leaf = live & self.leaf[node]
            out[rows[leaf], got[leaf]] = node[leaf]
            got[leaf] += 1
            inner = np.flatnonzero(live & ~self.leaf[node])
            if len(inner):
                kids = self.kids[node[inner]]
                score = np.einsum("nd,nkd->nk", x[inner], self.centres[kids]) + self.gain[kids]
                more, ids = np.full((n, BRANCH), -np.inf, np.float32), np.zeros((n, BRANCH), np.int32)
                more[inner], ids[inner] = np.where(kids < 0, -np.inf, score), kids
                queue, node_of = np.concatenate([queue, more], 1), np.concatenate([node_of, ids], 1)

    def near_sample(self, sample: np.ndarray, threshold: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of at least ``threshold`` to calibrate with, as two arrays of unit rows.

        Pairs of the sample with one of its rows that the tree was not fitted on (see :func:`fit_trees`) are used; where
        there are under 200, pairs made halfway between the threshold and 1 stand in for them.
        """
        x, rng = np.asarray(sample, np.float32), np.random.default_rng(seed)
        held = np.arange(0, len(x), HELD_OUT)
        q = rng.choice(held, min(len(held), 4000), replace=False)
        left, right = [np.zeros((0, x.shape[1]), np.float32)], [np.zeros((0, x.shape[1]), np.float32)]
        for i in range(0, len(q), 256):
            s = x[q[i : i + 256]] @ x.T
            s[np.arange(len(s)), q[i : i + 256]] = -1
            best = np.argpartition(-s, min(4, s.shape[1] - 1), axis=1)[:, :5]
            r, c = np.nonzero(np.take_along_axis(s, best, 1) >= threshold)
            left.append(x[q[i : i + 256]][r])
            right.append(x[best[r, c]])
        a, b = np.concatenate(left), np.concatenate(right)
        if len(a) < 200:
            a = x[q]
            d = rng.standard_normal(a.shape).astype(np.float32)
            d -= (d * a).sum(1, keepdims=True) * a
            cos = (1 + threshold) / 2
            b = cos * a + math.sqrt(1 - cos * cos) * d / np.linalg.norm(d, axis=1, keepdims=True)
        return a, b

    def calibrate(self, sample: np.ndarray, threshold: float, recall: float, least: int, one_sided: bool = False, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> int:
        """Fewest visits at which pairs of at least ``threshold`` share a leaf with rate ``recall``, ``least`` or more.

        Both rows visit so many leaves, or with ``one_sided`` one of them visits its first leaf only. There is no most: visits
        widen until the rate is reached, and with as many visits as there are leaves every pair meets. ``pairs`` of :meth:`near_sample` may be
        given.
        """
        leaves = int(self.leaf.sum())
        if len(sample) < 2 * HELD_OUT:
            return leaves if leaves < least else least
        a, b = pairs or self.near_sample(sample, threshold)
        most, met, done = 8, np.zeros(len(a), bool), 0
        while True:
            va, vb = self.visit(a, most), self.visit(b, 1 if one_sided else most)
            for v in range(done, most):
                other = slice(0, 1) if one_sided else slice(0, v + 1)
                met |= ((va[:, v : v + 1] == vb[:, other]) & (va[:, v : v + 1] >= 0)).any(1)
                if not one_sided:
                    met |= ((vb[:, v : v + 1] == va[:, :v]) & (vb[:, v : v + 1] >= 0)).any(1)
                if v + 1 >= min(least, leaves) and met.mean() >= recall:
                    return v + 1
            if most >= leaves:
                return leaves
            done, most = most, min(2 * most, leaves)


def draw(df: DataFrame, columns: list[str], rows: int = SAMPLE_ROWS, id_col: str = "id") -> tuple[pd.DataFrame, int]:
    """A bounded sample by hash of the id, the same at every partitioning, and the table's row count."""
    total = df.count()
    part = max(1, math.ceil(total / rows))
    keep = df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(part)) == 0) if part > 1 else df
    return keep.select(*columns).limit(2 * rows).toPandas(), total


def fit_trees(df: DataFrame, columns: list[str], leaf_rows: int = LEAF_ROWS, id_col: str = "id") -> dict[str, tuple[Tree, np.ndarray]]:
    """A tree and its sample for each blob column, fitted on at most ``2 * SAMPLE_ROWS`` rows."""
    pdf, total = draw(df, [id_col, *columns], id_col=id_col)
    out = {}
    for c in columns:
        ok = usable(pdf[c])
        x = matrix(pdf[c][ok]) if ok.any() else np.zeros((0, DIM))
        fit = np.arange(len(x)) % HELD_OUT != 0 if len(x) >= 2 * HELD_OUT else slice(None)
        out[c] = (Tree(x[fit], int(total * ok.mean()) if len(ok) else 0, leaf_rows), x)
    return out


def unpivot(df: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """(field, id, vec) of the blobs of the right width; field is the column's position."""
    cells = F.array(*[F.struct(F.lit(i).cast("int").alias("field"), F.col(c).alias("vec")) for i, c in enumerate(columns)])
    long = df.select(F.col(id_col).cast("string").alias("id"), F.explode(cells).alias("cell")).select("cell.field", "id", "cell.vec")
    return long.where((F.octet_length("vec") == 4 * DIM) & F.col("id").isNotNull())


def split_hot(long: DataFrame, keep: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Take all but the ``keep`` smallest ids of each vector with over HOT_COPIES copies out of the index.

    Returns the rows to index, then (field, h, id, rank, copies) of the kept, with the number of all copies, and (field, h, id)
    of the other copies, both None where no vector is that frequent.
    """
    hashed = long.withColumn("h", F.xxhash64("vec"))
    hot = cut(hashed.groupBy("field", "h").count().where(F.col("count") > HOT_COPIES).select("field", "h", F.col("count").alias("copies")))
    if hot.isEmpty():
        return long, None, None
    rank = Window.partitionBy("field", "h").orderBy("id")
    same = hashed.join(small(hot), ["field", "h"], "left_semi")
    kept = same.select("field", "h", "id").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= keep)
    kept = cut(kept.join(small(hot), ["field", "h"]).select("field", "h", "id", "rank", "copies"))
    rest = same.select("field", "h", "id").join(small(kept.select("field", "id")), ["field", "id"], "left_anti")
    rare = hashed.join(small(hot), ["field", "h"], "left_anti").select("field", "id", "vec")
    return rare.unionByName(same.join(small(kept.select("field", "id")), ["field", "id"], "left_semi").select("field", "id", "vec")), kept, rest


def spread(vec: pd.Series, blocks: int) -> np.ndarray:
    """The block of a split leaf that each vector belongs to; copies share it."""
    return np.fromiter((zlib.crc32(v) % blocks for v in vec), np.int32, len(vec))


def hot_leaves(long: DataFrame, trees: list[Tree], visits: list[int], rows: int = BLOCK_ROWS) -> tuple[dict[tuple[int, int], int], int]:
    """Blocks of each (field, leaf) that more than ``rows`` rows visit, and the number of all visits.

    Leaves are as many as the bounded sample allows, so the counts are small at every size.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf[usable(pdf["vec"])]
            for f, own in pdf.groupby("field"):
                leaf, n = np.unique(trees[f].visit(matrix(own["vec"]), visits[f]), return_counts=True)
                yield pd.DataFrame({"field": np.int32(f), "leaf": leaf[leaf >= 0].astype(np.int32), "n": n[leaf >= 0]})

    counts = long.select("field", "vec").mapInPandas(run, "field int, leaf int, n bigint").groupBy("field", "leaf").agg(F.sum("n").alias("n")).toPandas()
    hot = counts[counts["n"] > rows]
    return {(int(f), int(x)): -(-int(n) // rows) for f, x, n in hot.itertuples(index=False)}, int(counts["n"].sum())


def place(long: DataFrame, trees: list[Tree], visits: list[int], hot: dict[tuple[int, int], int] | None = None, total: int = 0, extra: str = "", lower: bool = False) -> DataFrame:
    """Each vector once per leaf it visits: (field, leaf, i, j, side, id, vec). Unusable ones fall out.

    A leaf that ``hot`` names is split: each pair (i, j) of its blocks is a group of its own, in which a row stands on the ``side``
    of its block. Other leaves are one group. ``extra`` columns (as in a schema) come along. ``lower`` adds the leaves before this one
    that the row visits too, so that a pair can be told where it meets first. Rows are dealt to tasks of about TASK_BYTES each.
    """
    hot = hot or {}
    names = [c.split()[0] for c in extra.split(",")] if extra else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf[usable(pdf["vec"])]
            for f, own in pdf.groupby("field"):
                leaves = trees[f].visit(matrix(own["vec"]), visits[f])
                row, _ = np.nonzero(leaves >= 0)
                at = leaves[leaves >= 0]
                parts = np.fromiter((hot.get((int(f), int(x)), 1) for x in at), np.int64, len(at)) if hot else np.ones(len(at), np.int64)
                side = np.zeros(len(at), np.int32)
                if (split := np.flatnonzero(parts > 1)).size:
                    crc = spread(own["vec"].iloc[row[split]], 1 << 31).astype(np.int64)
                    side[split] = crc % parts[split]
                again = np.repeat(np.arange(len(at)), parts)  # a row of a split leaf meets each of its blocks
                other = (np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)).astype(np.int32)
                row, at, side = row[again], at[again], side[again]
                out = {"field": np.int32(f), "leaf": at, "i": np.minimum(side, other), "j": np.maximum(side, other), "side": side}
                out |= {c: own[c].to_numpy()[row] for c in ("id", "vec", *names)}
                if lower:
                    out["lower"] = [x[(x >= 0) & (x < y)] for x, y in zip(leaves[row], at)]
                yield pd.DataFrame(out)

    schema = "field int, leaf int, i int, j int, side int, id string, vec binary" + (f", {extra}" if extra else "") + (", lower array<int>" if lower else "")
    placed = long.select("field", "id", "vec", *names).mapInPandas(run, schema)
    if total:
        placed = placed.repartition(max(8, -(-total * (4 * DIM + 64) // TASK_BYTES)), *BLOCK)
    return placed


def distinct_rows(vec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first row of each distinct blob, and for each row its blob's number."""
    codes, first = {}, []
    of = np.empty(len(vec), np.int64)
    for i, v in enumerate(vec):
        j = codes.setdefault(v, len(codes))
        if j == len(first):
            first.append(i)
        of[i] = j
    return np.array(first, np.int64), of


def row_chunks(rows: int, cells: int = 4 << 20) -> Iterator[slice]:
    """Slices of rows so that a block against all rows has about ``cells`` cells."""
    step = max(16, cells // max(1, rows))
    return (slice(i, min(i + step, rows)) for i in range(0, rows, step))
