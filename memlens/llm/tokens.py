"""Encoding of a corpus with a byte-level BPE vocabulary kept outside the repository.

A word is merged in a contiguous rank array: part boundaries stand beside the
rank of the pair that starts there; the smallest rank is scanned for, its
boundary deleted, and the two ranks beside it are looked up again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are, and the split pattern of byte_bpe_50k (its README states it).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of which a worker remembers the ids, and bytes up to which a word is scanned linearly.
REMEMBERED, SHORT = 200_000, 256
NO_PAIR = 1 << 60


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > SHORT:
        return _merge_long(word, ranks)
    starts = list(range(len(word) + 1))
    rank = [ranks.get(word[i : i + 2], NO_PAIR) for i in range(len(word) - 1)] + [NO_PAIR, NO_PAIR]

    def pair(i: int) -> int:
        """Rank of the pair that starts at part i."""
        return ranks.get(word[starts[i] : starts[i + 2]], NO_PAIR) if i + 2 < len(starts) else NO_PAIR

    while (low := min(rank)) < NO_PAIR:
        i = rank.index(low)
        del starts[i + 1], rank[i + 1]
        rank[i] = pair(i)
        if i:
            rank[i - 1] = pair(i - 1)
    return [ranks[word[a:b]] for a, b in zip(starts, starts[1:])]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for long words: a heap finds the minimum, linked boundaries are deleted."""
    import heapq

    end = len(word)
    after = list(range(1, end + 2))
    before = list(range(-1, end))
    heap = [(r, i, i + 1, i + 2) for i in range(end - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * (end + 1)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not (alive[i] and alive[mid] and after[i] == mid and after[mid] == stop):
            continue
        alive[mid] = False
        after[i] = stop
        if stop <= end:
            before[stop] = i
        for a in (i, before[i]):
            if a >= 0 and after[a] < end and (r := ranks.get(word[a : after[after[a]]])) is not None:
                heapq.heappush(heap, (r, a, after[a], after[after[a]]))
    out, i = [], 0
    while i < end:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``keep`` columns and ids (array<int>) of each text, without special tokens.

    Strings of special tokens are ordinary text; an empty and a null text give the empty
    list. Texts of any length are encoded whole. No row is moved: each task
    reads its own texts, and remembers the ids of frequent words.
    """
    source = df.select(*keep, F.col(text).alias("_text"))
    kept = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, split, known = load_ranks(vocabulary), regex.compile(pattern), {}
        for batch in batches:
            ids: list[int] = []
            ends = np.zeros(batch.num_rows + 1, np.int32)
            for k, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for w in split.findall(t) if t else ():
                    got = known.get(w)
                    if got is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        got = known[w] = merge_word(w.encode("utf-8", "surrogatepass"), ranks)
                    ids += got
                ends[k + 1] = len(ids)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*kept.fieldNames(), "ids"])

    from pyspark.sql.types import ArrayType, IntegerType, StructType

    return source.mapInArrow(run, StructType([*kept.fields]).add("ids", ArrayType(IntegerType())))
