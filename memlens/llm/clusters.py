"""Clusters of mutually similar vectors by density peaks.

The density of a record is the number of its neighbours within the threshold, summed over the blocks
of the k-means tree. Each record points to its nearest denser neighbour, found by a second join
within blocks; records without one are peaks, and pointers lead to them. A third join counts the
borders at which records of different peaks touch; peaks that touch are one cluster, so clusters
are whole groups joined through neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlens.llm.vectors import BLOCK, distinct_rows, exact_cosine, fit_trees, hot_leaves, matrix, place, row_chunks, split_hot, unpivot
from memlens.operators.hierarchy import resolve_roots
from memlens.runtime import cut, drop_table, skew_join, small

SCREEN = 1e-5
#: Cells of similarities, and pairs whose vectors are gathered, that a task holds at once.
PAIR_CELLS, PAIR_STEP = 1 << 20, 1 << 15


class Block:
    """One row of each distinct vector of a block and the pairs of them within the threshold.

    A pair that meets in several blocks counts in the first of them only: where no earlier leaf is visited by both
    (``lower`` lists each row's earlier leaves), and in a split leaf where the two sides meet.
    """

    def __init__(self, pdf: pd.DataFrame, least: float):
        pdf = pdf.sort_values("id", kind="stable")
        first, self.of = distinct_rows(pdf["vec"].to_numpy())
        self.all, self.rows, self.least = pdf, pdf.iloc[first], least
        self.x = matrix(self.rows["vec"])
        self.x4 = self.x.astype(np.float32)
        self.cross = bool(pdf["i"].iloc[0] != pdf["j"].iloc[0])
        self.side = self.rows["side"].to_numpy()
        if "lower" in pdf:
            size = max(1, self.rows["lower"].map(len).max())
            self.lower = np.full((len(self.x), size), -1)
            for r, own in enumerate(self.rows["lower"]):
                self.lower[r, : len(own)] = own

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, other) of all near pairs, in both directions and in bounded pieces."""
        for rows in row_chunks(len(self.x), PAIR_CELLS):
            s = self.x4[rows] @ self.x4.T
            hit = s >= self.least - SCREEN
            r, c = np.nonzero(hit)
            r += rows.start
            ok = r != c
            if self.cross:
                ok &= self.side[r] != self.side[c]
            r, c = r[ok], c[ok]
            near = s[r - rows.start, c]
            sure = near >= self.least + SCREEN
            sure[~sure] = self.cosine(r[~sure], c[~sure]) >= self.least
            yield r[sure], c[sure]

    def cosine(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Exact cosines of pairs. All pairs of a dense block may be near, so their vectors are gathered a step at a time."""
        out = np.empty(len(r))
        for i in range(0, len(r), PAIR_STEP):
            out[i : i + PAIR_STEP] = exact_cosine(self.x[r[i : i + PAIR_STEP]], self.x[c[i : i + PAIR_STEP]])
        return out

    def here(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Mask of the pairs that this block counts."""
        ok = np.ones(len(r), bool)
        for i in range(self.lower.shape[1]):
            for j in range(self.lower.shape[1]):
                a = self.lower[r, i]
                ok &= (a != self.lower[c, j]) | (a < 0)
        return ok


def block_density(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """(id, density): what this block adds to the density of its rows; copies of the own vector count where it is met first."""
    b = Block(pdf, least)
    weight = np.bincount(b.of, pdf.sort_values("id", kind="stable")["copies"], len(b.x)).astype(np.int64)
    own = (b.lower < 0).all(1) & (not b.cross)
    density = np.where(own, weight - 1, 0)
    for r, c in b.pairs():
        ok = b.here(r, c)
        np.add.at(density, r[ok], weight[c[ok]])
    out = pd.DataFrame({"id": b.all["id"].to_numpy(), "density": density[b.of]})
    return out[out["density"] > 0]


def block_pointers(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """(id, up, cosine): the nearest denser neighbour in this block; of equal densities the smaller id is the denser."""
    b = Block(pdf, least)
    rank = np.empty(len(b.all), np.int64)  # 0 is the densest
    rank[np.lexsort((np.arange(len(b.all)), -b.all["density"].to_numpy()))] = np.arange(len(b.all))
    lead = np.full(len(b.x), len(rank), np.int64)  # the densest copy of each distinct vector
    np.minimum.at(lead, b.of, rank)
    at = np.argsort(rank)
    best, up = np.full(len(b.x), -2.0), np.full(len(b.x), -1)
    for r, c in b.pairs():
        denser = lead[c] < lead[r]
        r, c = r[denser], c[denser]
        cos = b.cosine(r, c)
        by = np.lexsort((lead[c], -cos, r))
        r, c, cos = r[by], c[by], cos[by]
        new = np.concatenate([[True], r[1:] != r[:-1]]) if len(r) else np.zeros(0, bool)
        best[r[new]], up[r[new]] = cos[new], c[new]
    ids = b.all["id"].to_numpy()
    first = rank == lead[b.of]
    target = np.where(first, up[b.of], b.of)  # further copies point to the densest copy
    cosine = np.where(first, best[b.of], 1.0)
    ok = target >= 0
    return pd.DataFrame({"id": ids[ok], "up": ids[at[lead[target[ok]]]], "cosine": cosine[ok]})


def block_borders(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """(a, b, pairs): pairs of peaks, a < b, whose records touch in this block, and how many pairs of vectors do."""
    b = Block(pdf, least)
    peak = b.rows["peak"].to_numpy()
    found: list[pd.DataFrame] = []
    for r, c in b.pairs():
        ok = peak[r] < peak[c]
        if ok.any():
            found.append(pd.DataFrame({"a": peak[r[ok]], "b": peak[c[ok]]}).value_counts(["a", "b"]).rename("pairs").reset_index())
    # copies of a vector may have been given to different peaks
    same = pd.DataFrame({"a": peak[b.of], "b": b.all["peak"].to_numpy()}).query("a != b")
    if len(same):
        found.append(pd.DataFrame({"a": np.minimum(same["a"], same["b"]), "b": np.maximum(same["a"], same["b"]), "pairs": 1}))
    return pd.concat(found) if found else pd.DataFrame({"a": pd.Series(dtype=object), "b": pd.Series(dtype=object), "pairs": pd.Series(dtype="int64")})


def component_labels(pairs: DataFrame) -> DataFrame:
    """(node, label) for links (node, via): the smallest node each is joined with, directly or not.

    Smallest labels spread over both ends of the links and hop along labels, so rounds
    grow with the logarithm of a chain's length. Each round is cut.
    """
    state = cut(pairs.groupBy("node").agg(F.min("via").alias("label")).select("node", F.least("node", "label").alias("label")))
    links = cut(pairs.where("node <> via").distinct())
    while True:
        both = links.join(state, "node").select("via", "label")
        to_via = both.groupBy("via").agg(F.min("label").alias("label"))
        back = links.join(to_via, "via").select("node", "label")
        spread = back.unionByName(state).groupBy("node").agg(F.min("label").alias("label"))
        hop = state.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = cut(
            spread.join(hop, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"))
        )
        settled = new.join(state.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty()
        drop_table(state)
        state = new
        if settled:
            drop_table(links)
            return state


def clusters(df: DataFrame, column: str, least: float = 0.85, recall: float = 0.998, visits: int = 3, id_col: str = "id") -> DataFrame:
    """cluster_id, id, density, delta, peak: groups of at least two; cluster_id is the smallest id.

    Records belong together if the cosine of their vectors reaches ``least``, directly or through others. ``density``
    counts all records within the threshold, copies too; ``delta`` is the cosine distance to the nearest denser record
    within the threshold, null for a peak; ``peak`` is where the pointers of denser neighbours end. The row of the smallest id is
    included. Unusable blobs and null ids are in no cluster; an empty table gives an empty result.
    """
    tree, sample = fit_trees(df, [column], id_col=id_col)[column]
    v = tree.calibrate(sample, least, recall, visits)
    index, kept, rest = split_hot(unpivot(df, [column], id_col), 2)
    hot, total = hot_leaves(index, [tree], [v])
    if kept is None:
        index = index.withColumn("copies", F.lit(1).cast("long"))
    else:  # the first of the two kept copies stands for all others
        count = kept.select("id", F.when(F.col("rank") == 1, F.col("copies") - 1).otherwise(1).alias("copies"))
        index = index.join(small(count), "id", "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))

    def blocks(rows: DataFrame, extra: str, work, schema: str, lower: bool = False) -> DataFrame:
        placed = place(rows, [tree], [v], hot, total, extra, lower)
        return placed.groupBy(*BLOCK).applyInPandas(lambda pdf: work(pdf, least), schema)

    parts = blocks(index, "copies bigint", block_density, "id string, density bigint", lower=True)
    dense = cut(parts.groupBy("id").agg(F.sum("density").alias("density")))
    # only records with neighbours go on
    rows = cut(index.drop("copies").join(dense, "id"))
    ups = blocks(rows, "density bigint", block_pointers, "id string, up string, cosine double")
    nearest = F.min(F.struct((-F.col("cosine")).alias("far"), "up")).alias("best")
    pointers = cut(ups.groupBy("id").agg(nearest).select("id", F.col("best.up").alias("parent"), (1 + F.col("best.far")).alias("delta")))
    roots = resolve_roots(pointers.select("id", "parent")).select("id", F.col("root_id").alias("peak"))
    peaks = cut(rows.select("id").join(roots, "id", "left").select("id", F.coalesce("peak", "id").alias("peak")))
    borders = cut(blocks(rows.join(peaks, "id"), "peak string", block_borders, "a string, b string, pairs bigint").groupBy("a", "b").agg(F.sum("pairs").alias("pairs")))
    joined = component_labels(borders.select(F.col("a").alias("node"), F.col("b").alias("via")).unionByName(borders.select(F.col("b").alias("node"), F.col("a").alias("via"))))
    # a peak may not be the smallest id of what it leads
    of_peak = peaks.groupBy("peak").agg(F.min("id").alias("low")).join(joined.withColumnRenamed("node", "peak"), "peak", "left").select("peak", "low", F.coalesce("label", "peak").alias("label"))
    low = of_peak.join(of_peak.groupBy("label").agg(F.min("low").alias("cluster_id")), "label").select("peak", "cluster_id")
    out = skew_join(peaks, low, ["peak"]).join(dense, "id").join(pointers.select("id", "delta"), "id", "left").select("cluster_id", "id", "density", "delta", "peak")
    if rest is not None:  # further copies follow the kept ones
        lead = kept.where("rank = 1").select("h", F.col("id").alias("lead")).join(out.withColumnRenamed("id", "lead"), "lead").select("h", "cluster_id", "density", "peak", F.lit(0.0).alias("delta"))
        out = out.unionByName(skew_join(rest.select("h", "id"), lead, ["h"]).select("cluster_id", "id", "density", "delta", "peak"))
    return out


def describe(found: DataFrame, typical: int = 3) -> DataFrame:
    """cluster_id, size, typical: ids of the densest members (ties to the smaller id)."""
    rank = Window.partitionBy("cluster_id").orderBy(F.desc("density"), "id")
    top = found.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= typical)
    best = top.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda s: s["id"]).alias("typical"))
    return found.groupBy("cluster_id").agg(F.count("*").alias("size")).join(best, "cluster_id")
