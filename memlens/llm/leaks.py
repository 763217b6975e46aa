"""Evaluation texts leaking into training text, by greedy string tiling.

Seeds are runs of ``shortest`` shared words found by a running (Karp-Rabin) hash. For each
document and item that share a seed, the longest matches that overlap nothing marked before
are marked again and again, so reordered passages count too.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlens.runtime import skew_join

WORD = regex.compile(r"[\p{L}\p{N}]+")
DROPPED = regex.compile(r"[\p{M}\p{Cf}]+")
#: Seeds of items that are broadcast as sorted arrays; more are joined, behind a broadcast bitmap of so many bits.
BROADCAST_SEEDS, BITMAP = 1_000_000, 1 << 26
_BASE = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1


def words(text: str | None) -> list[str]:
    """Runs of letters and digits after NFKD without combining marks and format characters, in lower case."""
    if not text:
        return []
    if not text.isascii():
        text = DROPPED.sub("", unicodedata.normalize("NFKD", text)).lower()
        text = DROPPED.sub("", unicodedata.normalize("NFKD", text))
    else:
        text = text.lower()
    return WORD.findall(text)


def codes(tokens: list[str], cache: dict[str, int]) -> np.ndarray:
    if len(cache) > 500_000:
        cache.clear()
    out = [cache.get(w) or cache.setdefault(w, xxhash.xxh64_intdigest(w) | 1) for w in tokens]
    return np.array(out, np.uint64)


def running(code: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` codes."""
    n = len(code) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(length):
        h = h * np.uint64(_BASE) + code[j : j + n]
    return h


def seeds_of(doc: np.ndarray, sorted_: np.ndarray, at_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc position, number in ``at_of``) of all equal hashes; ``sorted_`` holds the items' hashes ascending."""
    lo, hi = np.searchsorted(sorted_, doc), np.searchsorted(sorted_, doc, side="right")
    times = hi - lo
    d = np.repeat(np.arange(len(doc)), times)
    within = np.arange(len(d)) - np.repeat(np.cumsum(times) - times, times)
    return d, at_of[np.repeat(lo, times) + within]


def tile(doc: np.ndarray, item: np.ndarray, at: tuple[np.ndarray, np.ndarray], shortest: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in doc, start in item, length), longest first, ties to the earliest.

    ``at`` are the seeds' positions. Seeds that follow one another on a diagonal, their words unmarked, are a match; each round
    marks the longest one. An item's words are marked once, so there are at most as many rounds as tiles fit into it.
    """
    d, i = at
    true = np.ones(len(d), bool)
    for j in range(shortest):  # no trust in the hash alone
        true &= doc[d + j] == item[i + j]
    d, i = d[true], i[true]
    by = np.lexsort((d, d - i))
    d, i = d[by], i[by]
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles = []
    while len(d):
        runs_d, runs_i = np.concatenate([[0], np.cumsum(free_d)]), np.concatenate([[0], np.cumsum(free_i)])
        open_ = (runs_d[d + shortest] - runs_d[d] == shortest) & (runs_i[i + shortest] - runs_i[i] == shortest)
        d, i = d[open_], i[open_]
        if not len(d):
            break
        first = np.concatenate([[0], np.flatnonzero((np.diff(d) != 1) | (np.diff(i) != 1)) + 1])
        length = np.diff(np.concatenate([first, [len(d)]])) + shortest - 1
        best = np.lexsort((i[first], d[first], -length))[0]
        a, b, n = int(d[first[best]]), int(i[first[best]]), int(length[best])
        tiles.append((a, b, n))
        free_d[a : a + n] = False
        free_i[b : b + n] = False
    return tiles


def _tiled(doc: np.ndarray, item: np.ndarray, at: tuple[np.ndarray, np.ndarray], shortest: int) -> tuple[int, float]:
    tiles = tile(doc, item, at, shortest)
    return max((t[2] for t in tiles), default=0), sum(t[2] for t in tiles) / max(1, len(item))


FOUND = "longest int, coverage double"


def _by_block(docs: DataFrame, key: str, text: str, items: list[tuple[str, np.ndarray]], shortest: int) -> DataFrame:
    seeds = [running(c, shortest) for _, c in items]
    flat = np.concatenate([np.zeros(0, np.uint64), *seeds])
    which = np.repeat(np.arange(len(items)), [len(s) for s in seeds])
    offset = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(s)) for s in seeds]])
    by = np.argsort(flat, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((flat[by], which[by], offset[by], items))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sorted_, item_of, at_of, parts = shared.value
        cache: dict[str, int] = {}
        places = np.arange(len(sorted_))
        for pdf in frames:
            out = []
            for doc_id, t in zip(pdf["_key"], pdf["_text"]):
                code = codes(words(t), cache)
                d, at = seeds_of(running(code, shortest), sorted_, places)
                for i in np.unique(item_of[at]):
                    own = item_of[at] == i
                    longest, coverage = _tiled(code, parts[i][1], (d[own], at_of[at[own]]), shortest)
                    if longest:
                        out.append((doc_id, parts[i][0], longest, coverage))
            yield pd.DataFrame(out, columns=["_key", "item_id", "longest", "coverage"])

    kind = dict(docs.select(F.col(key).alias("_key")).dtypes)["_key"]
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInPandas(run, f"_key {kind}, item_id string, {FOUND}")


def _by_join(docs: DataFrame, key: str, text: str, items: DataFrame, shortest: int) -> DataFrame:
    """Seeds of both sides joined by their hash; whole texts are fetched for pairs that share one.

    A document gives only seeds that the items' bitmap may hold, so what moves is about what leaks; a stock phrase of many documents is
    spread over many keys.
    """
    kind = dict(docs.select(F.col(key).alias("_key")).dtypes)["_key"]

    def seeds_with(bits):
        def seeds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cache: dict[str, int] = {}
            for pdf in frames:
                keys, found = [], []
                for k, t in zip(pdf["_key"], pdf["_text"]):
                    h = np.unique(running(codes(words(t), cache), shortest))
                    if bits is not None:
                        at = (h & np.uint64(BITMAP - 1)).astype(np.int64)
                        h = h[(bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                    keys += [k] * len(h)
                    found.append(h.view(np.int64))
                yield pd.DataFrame({"_key": pd.Series(keys, dtype=pdf["_key"].dtype), "h": np.concatenate([np.zeros(0, np.int64), *found])})

        return seeds

    d = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    i = items.select(F.col("item_id").alias("_key"), F.col("passage").alias("_text"))
    is_ = i.mapInPandas(seeds_with(None), "_key string, h bigint").withColumnRenamed("_key", "item_id")
    place = F.col("h").bitwiseAND(BITMAP - 1) + 1  # the bitmap functions number positions from 1
    parts = is_.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bitmap = np.zeros(BITMAP // 8, np.uint8)
    for b, raw in parts.toPandas().itertuples(index=False):
        part = np.frombuffer(raw, np.uint8)
        bitmap[(b - 1) * len(part) : b * len(part)] |= part
    ds = d.mapInPandas(seeds_with(docs.sparkSession.sparkContext.broadcast(bitmap)), f"_key {kind}, h bigint")
    pairs = skew_join(ds, is_, ["h"], 16).select("_key", "item_id").distinct()

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for pdf in frames:
            out = []
            for k, item_id, t, p in zip(pdf["_key"], pdf["item_id"], pdf["_text"], pdf["_passage"]):
                a, b = codes(words(t), cache), codes(words(p), cache)
                h = running(b, shortest)
                by = np.argsort(h, kind="stable")
                longest, coverage = _tiled(a, b, seeds_of(running(a, shortest), h[by], by), shortest)
                if longest:
                    out.append((k, item_id, longest, coverage))
            yield pd.DataFrame(out, columns=["_key", "item_id", "longest", "coverage"])

    full = pairs.withColumnRenamed("_key", "_k").join(d, F.col("_k").eqNullSafe(F.col("_key"))).drop("_k").join(i.select(F.col("_key").alias("item_id"), F.col("_text").alias("_passage")), "item_id")
    return full.mapInPandas(check, f"_key {kind}, item_id string, {FOUND}")


def leaks(docs: DataFrame, items: DataFrame, shortest: int = 12, key: str = "doc_id", text: str = "text", coverage: float = 0.0, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(key, item_id, longest, coverage) of each document that holds ``shortest`` words in a row of an item.

    ``coverage`` is the share of the item's words in tiles, wherever they stand; pairs under the ``coverage`` asked for are left out.
    Null and empty texts and items under ``shortest`` words are in no pair; whole texts are compared, copies and ties alike.
    Items are the query set: the corpus is read once, against their broadcast seeds where these are proven few, else by a join.
    """
    known = items.where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "passage")
    # at least two characters a word, so this bounds the seeds from above before anything is collected
    bound = known.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0] // 2
    if bound > broadcast_seeds:
        out = _by_join(docs, key, text, known, shortest)
    else:
        cache: dict[str, int] = {}
        coded = [(r["item_id"], codes(words(r["passage"]), cache)) for r in known.toLocalIterator()]
        out = _by_block(docs, key, text, [c for c in coded if len(c[1]) >= shortest], shortest)
    return out.where(F.col("coverage") >= coverage).withColumnRenamed("_key", key)


def report(found: DataFrame) -> DataFrame:
    """Per item: documents that hold it, longest tile and best coverage."""
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("longest").alias("longest"), F.max("coverage").alias("coverage"))
