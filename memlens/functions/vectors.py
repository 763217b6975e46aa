"""Vector functions: blobs, cosine, deterministic embedding and hashes."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def decode(blob: bytes | None) -> np.ndarray | None:
    """Little-endian float32 of a blob; null if the length is no multiple of four."""
    return None if blob is None or len(blob) % 4 else np.frombuffer(blob, "<f4")


def encode(vector) -> bytes:
    return struct.pack(f"<{len(vector)}f", *vector)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def blob_to_vector(blob: pd.Series) -> pd.Series:
    return blob.map(decode)


def usable_vector(blob: Column, dim: int) -> Column:
    """The vector of a blob of exactly ``dim`` finite float32 that are not all zero, else null."""

    def run(blobs: pd.Series) -> pd.Series:
        ok = blobs.map(lambda b: b is not None and len(b) == 4 * dim).to_numpy(bool)
        out = pd.Series([None] * len(blobs), dtype=object)
        if ok.any():
            v = np.frombuffer(b"".join(blobs[ok]), "<f4").reshape(-1, dim)
            good = np.isfinite(v).all(1) & (v != 0).any(1)
            at = np.flatnonzero(ok)[good]
            out.iloc[at] = pd.Series(list(v[good]), index=at, dtype=object)
        return out

    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(blob)


@F.pandas_udf(T.BinaryType())
def vector_to_blob(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 with a zero vector, null if lengths differ or a side is null."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    norm = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.when(norm == 0, 0.0).otherwise(dot / norm))


def deterministic_embedding(dim: int):
    """A pandas UDF: byte i adds byte/255 to component i mod ``dim``; the vector is then normalised."""

    def embed(text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode(), np.uint8).astype(np.float32) / np.float32(255)
        v = np.zeros(dim, np.float32)
        np.add.at(v, np.arange(len(raw)) % dim, raw)
        return v / np.float32(max(float(np.sqrt((v * v).sum())), 1e-10))

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(text: pd.Series) -> pd.Series:
        return text.map(embed)

    return run


def fnv1a(texts: list[bytes]) -> np.ndarray:
    """FNV-1a of each text, a byte of all texts at a time, so steps are as many as the longest has bytes."""
    h = np.full(len(texts), FNV_OFFSET, np.uint64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join(texts), np.uint8)
    start = np.cumsum(size) - size
    by = np.argsort(-size, kind="stable")
    for i in range(int(size.max(initial=0))):
        by = by[size[by] > i]
        h[by] = (h[by] ^ flat[start[by] + i]) * np.uint64(FNV_PRIME)
    return h


@F.pandas_udf(T.LongType())
def fnv1a_64(text: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-8 bytes, as the signed integer of the same bits."""
    have = text.notna().to_numpy()
    out = pd.array(np.zeros(len(text), np.int64), "Int64")
    out[have] = fnv1a([t.encode() for t in text[have]]).view(np.int64)
    out[~have] = pd.NA
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def hash_uniform(h: pd.Series) -> pd.Series:
    """A number in [0, 1) from a 64-bit hash."""
    bits = h.fillna(0).astype("int64").to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return pd.Series((bits >> np.uint64(11)) / float(1 << 53)).where(h.notna())


def hash_collisions(rows: DataFrame, column: str = "id") -> DataFrame:
    """(hash, ids): hashes that several different ids share; none in practice, and an insert that would make one has to be refused."""
    by = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("id"), fnv1a_64(F.col(column)).alias("hash"))
    return by.groupBy("hash").agg(F.count_distinct("id").alias("ids")).where("ids > 1")


def resolve_hashes(hashes: DataFrame, rows: DataFrame) -> DataFrame:
    """``hashes`` (hash) with the id of the row that has it; hashes of no row are left out."""
    return hashes.join(rows.select("id", fnv1a_64(F.col("id")).alias("hash")), "hash")
