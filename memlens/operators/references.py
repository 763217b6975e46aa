"""References to records that do not exist, by compressed bitmaps.

Keys are dictionary-encoded as integers, the codes of each key range and period
are packed into bitmaps, parent bitmaps are subtracted (AND-NOT), and the bits
that survive are decoded to keys.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlens.functions.packed import split_packed
from memlens.functions.timeutil import instant, month_utc
from memlens.runtime import clean_key, cut

#: Codes of one bitmap container, and keys a range is planned for.
CONTAINER, RANGE_KEYS = 1 << 16, 1 << 14


@F.pandas_udf(T.BinaryType())
def pack_bits(lows: pd.Series) -> pd.Series:
    """Compressed bitmap of positions under ``CONTAINER``."""

    def pack(values) -> bytes:
        bits = np.zeros(CONTAINER, np.uint8)
        bits[np.asarray(values, np.int64)] = 1
        return zlib.compress(np.packbits(bits).tobytes(), 1)

    return lows.map(pack)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def and_not(have: pd.Series, parents: pd.Series) -> pd.Series:
    """Positions set in ``have`` and not in ``parents`` (null: no parents)."""

    def left(a: bytes, b: bytes | None) -> np.ndarray:
        bits = np.frombuffer(zlib.decompress(a), np.uint8)
        if b is not None:
            bits = bits & ~np.frombuffer(zlib.decompress(b), np.uint8)
        return np.flatnonzero(np.unpackbits(bits)).astype(np.int32)

    return pd.Series([left(a, b) for a, b in zip(have, parents)])


def missing_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """``references`` (ref_field, key, ref_month) without a row of ``parents`` (key).

    Returns ref_field, missing_id, ref_month, each combination once. Null keys
    are no references; a reference of unreadable time keeps a null month. Hot
    keys are collapsed before anything is shuffled by key, and a key range
    holds a bounded number of distinct keys, so no task holds an unbounded group.
    """
    refs = cut(references.where(F.col("key").isNotNull()).select("ref_field", "key", "ref_month").distinct())
    known = parents.where(F.col("key").isNotNull()).select("key").distinct()
    keys = refs.select("key").union(known).distinct()
    ranges = max(1, -(-keys.agg(F.approx_count_distinct("key", 0.02)).first()[0] // RANGE_KEYS))
    width = F.lit(1 << 30)
    by_range = Window.partitionBy("key_range").orderBy("key")
    codes = cut(
        keys.withColumn("key_range", F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("long")).withColumn(
            "code", F.col("key_range") * width + F.row_number().over(by_range) - 1
        )
    ).select("key", "code")

    def packed(df: DataFrame, *by: str) -> DataFrame:
        coded = df.join(codes, "key").select(F.expr(f"code div {CONTAINER}").alias("box"), (F.col("code") % CONTAINER).cast("int").alias("low"), *by)
        return coded.groupBy("box", *by).agg(F.collect_set("low").alias("lows"))

    have = packed(refs, "ref_field", "ref_month").select("box", "ref_field", "ref_month", pack_bits("lows").alias("have"))
    full = packed(known, ).select("box", pack_bits("lows").alias("parents"))
    bits = have.join(full, "box", "left").select("box", "ref_field", "ref_month", F.explode(and_not("have", "parents")).alias("low"))
    found = bits.select("ref_field", "ref_month", (F.col("box") * CONTAINER + F.col("low")).alias("code"))
    return found.join(codes, "code").select("ref_field", F.col("key").alias("missing_id"), "ref_month")


def memory_references(memories: DataFrame, feedback: DataFrame) -> DataFrame:
    """All references of the store: ref_field, key (clean), ref_month."""
    month = month_utc(instant(F.col("created_at")))
    links = F.array(
        *[
            F.struct(F.lit(f"memories.{c}").alias("ref_field"), keys.alias("keys"))
            for c, keys in (
                ("parent_id", F.array("parent_id")),
                ("superseded_by", F.array("superseded_by")),
                ("source_ids", split_packed(F.col("source_ids"), "id")),
            )
        ]
    )
    own = memories.select(month.alias("ref_month"), F.explode(links).alias("l")).select(
        "l.ref_field", F.explode("l.keys").alias("key"), "ref_month"
    )
    shown = feedback.select(
        F.lit("feedback_tracking.memory_id").alias("ref_field"), F.col("memory_id").alias("key"), month_utc(instant(F.col("searched_at"))).alias("ref_month")
    )
    return own.unionByName(shown).withColumn("key", clean_key(F.col("key")))


def parent_keys(memories: DataFrame, column: Column | None = None) -> DataFrame:
    return memories.select(clean_key(F.col("id") if column is None else column).alias("key"))
