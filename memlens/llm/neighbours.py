"""The most similar vectors for every vector, by a hierarchical k-means tree.

Every vector is put into the leaves that its best-bin-first walk visits; in each
leaf all members are compared exactly, in blocks where a leaf is large. Visits are widened until pairs of the
sample share a leaf at the wanted rate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlens.llm.vectors import BLOCK, distinct_rows, exact_cosine, fit_trees, hot_leaves, matrix, place, row_chunks, split_hot, unpivot
from memlens.runtime import skew_join

#: Slack of the float32 screen before the exact test in double precision.
SCREEN = 1e-5


def leaf_neighbours(pdf: pd.DataFrame, k: int, least: float) -> pd.DataFrame:
    """Best ``k`` others of every member of one leaf, as arrays."""
    pdf = pdf.sort_values("id", kind="stable")
    ids, vec, field = pdf["id"].to_numpy(), pdf["vec"].to_numpy(), pdf["field"].iloc[0]
    first, of = distinct_rows(vec)
    x = matrix(vec[first])
    x4 = x.astype(np.float32)
    order = np.argsort(of, kind="stable")  # members of each distinct vector, ids ascending
    start = np.searchsorted(of[order], np.arange(len(first) + 1))
    held = np.minimum(np.diff(start), k + 1)  # more copies of one vector can't enter a list
    left, right, cosines = [], [], []
    for rows in row_chunks(len(x)):
        s = x4[rows] @ x4.T
        near = s >= least - SCREEN
        many = np.flatnonzero(near.sum(1) > 4 * (k + 1))
        if len(many):  # the k + 1 best with slack for the screen's rounding
            edge = -np.partition(-s[many], k, axis=1)[:, k] - 2 * SCREEN
            near[many] &= s[many] >= edge[:, None]
        r, c = np.nonzero(near)
        left.append(r + rows.start)
        right.append(c)
        cosines.append(exact_cosine(x[left[-1]], x[c]))
    a, b, cos = np.concatenate(left), np.concatenate(right), np.concatenate(cosines)
    cos[a == b] = 1.0
    ok = (cos >= least) & ((a != b) | (held[a] > 1))
    a, b, cos = a[ok], b[ok], cos[ok]
    # expand distinct vectors to ids on the right, order, cut, then expand on the left
    times = held[b]
    a, cos = np.repeat(a, times), np.repeat(cos, times)
    within = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
    n = order[np.repeat(start[b], times) + within] if len(a) else np.zeros(0, np.int64)
    by = np.lexsort((n, -cos, a))
    a, cos, n = a[by], cos[by], n[by]
    begin = np.searchsorted(a, np.arange(len(first) + 1))
    out_id, out_n = [], []
    for j in range(len(first)):
        lo, hi = begin[j], min(begin[j + 1], begin[j] + k + 1)
        if lo == hi:
            continue
        for m in order[start[j] : start[j + 1]]:
            mine = n[lo:hi]
            keep = np.flatnonzero(mine != m)[:k]
            if len(keep):
                out_id.append(ids[m])
                out_n.append([{"c": -cos[lo + t], "n": ids[mine[t]]} for t in keep])
    return pd.DataFrame({"field": np.full(len(out_id), field, np.int32), "id": np.array(out_id, object), "near": pd.Series(out_n, dtype=object)})


def nearest(
    df: DataFrame, columns: dict[str, str], k: int = 5, least: float = 0.85, recall: float = 0.998, min_visits: int = 3, id_col: str = "id"
) -> DataFrame:
    """field_name, id, neighbour_id: for each vector its ``k`` most similar others of the field.

    ``columns`` maps field names to blob columns. Cosines are in double
    precision, ties go to the smaller id, pairs under ``least`` are left out.
    Unusable blobs and null ids are neither queries nor neighbours; an empty table gives an
    empty result. Ids must be unique. Every row is indexed; only the tree is fitted on a sample.
    """
    names, blobs = list(columns), list(columns.values())
    fitted = fit_trees(df, blobs, id_col=id_col)
    trees = [fitted[c][0] for c in blobs]
    visits = [fitted[c][0].calibrate(fitted[c][1], least, recall, min_visits) for c in blobs]
    index, kept, rest = split_hot(unpivot(df, blobs, id_col), k + 1)

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        return leaf_neighbours(pdf, k, least)

    schema = "field int, id string, near array<struct<c:double,n:string>>"
    lists = place(index, trees, visits, *hot_leaves(index, trees, visits)).groupBy(*BLOCK).applyInPandas(leaf, schema)
    merged = lists.groupBy("field", "id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    found = merged.select("field", "id", F.explode("near.n").alias("neighbour_id"))
    if rest is not None:  # the other copies of a frequent vector: its smallest ids, cosine 1
        first = index.join(kept.where("rank = 1").select("field", "id", "h"), ["field", "id"]).select("field", F.col("h").cast("string").alias("id"), "vec")
        usable_hot = place(first, trees, [1] * len(trees)).select("field", F.col("id").cast("long").alias("h"))
        best = kept.where(F.col("rank") <= k).join(usable_hot, ["field", "h"], "left_semi").groupBy("field", "h").agg(F.collect_list("id").alias("best"))
        more = skew_join(rest, best, ["field", "h"]).select("field", "id", F.explode("best").alias("neighbour_id"))
        found = found.unionByName(more)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("field") + 1)
    return found.select(label.alias("field_name"), "id", "neighbour_id")
