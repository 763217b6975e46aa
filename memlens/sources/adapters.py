"""The store's tables as the operators and their SQL take them: vectors of the usable blobs, search queries, a bandit's rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlens.functions.vectors import usable_vector
from memlens.runtime import table

#: Width of the store's vectors.
DIM = 64
FIELDS = ("context", "action", "result")


def number(id_: Column) -> Column:
    """The number that the hex digits of an id are."""
    return F.conv(F.substring(id_, 5, 12), 16, 10).cast("long")


def asked(memories: DataFrame) -> DataFrame:
    """The stated query set: every row whose number 20 divides."""
    return memories.where(number(F.col("id")) % 20 == 0)


def searchable(memories: DataFrame) -> DataFrame:
    return memories.where("indexed and superseded_by is null")


def field_vectors(memories: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field, id, vec): the usable vectors of the rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"embedding_{f}").alias("blob")) for f in fields])).alias("c")
    long = memories.select("id", cells).select("c.field", "id", usable_vector(F.col("c.blob"), DIM).alias("vec"))
    return long.where("vec is not null")


def wide_vectors(memories: DataFrame) -> DataFrame:
    """(id, context, action, result): rows with three usable vectors."""
    return memories.select("id", *[usable_vector(F.col(f"embedding_{f}"), DIM).alias(f) for f in FIELDS]).dropna()


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, vec) of the stated query set: a row asks with its whole action and its context vector."""
    return asked(table(spark, sf_dir, "memories")).select(F.col("id").alias("query_id"), F.col("action").alias("query"), usable_vector(F.col("embedding_context"), DIM).alias("vec"))


def _decoded(blob: str) -> str:
    """A blob of little-endian float32 as an array of doubles in SQL, null if it is not usable."""
    word = f"('0x' || substr(hex({blob}), 8 * i + 7, 2) || substr(hex({blob}), 8 * i + 5, 2) || substr(hex({blob}), 8 * i + 3, 2) || substr(hex({blob}), 8 * i + 1, 2))::BIGINT"
    exponent, mantissa = "((x >> 23) & 255)", "(x & 8388607)"
    value = f"(CASE WHEN x >= 2147483648 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * CASE WHEN {exponent} = 255 THEN NULL WHEN {exponent} = 0 THEN {mantissa} * pow(2.0::DOUBLE, -149) ELSE ({mantissa} + 8388608) * pow(2.0::DOUBLE, {exponent} - 150) END"
    return f"CASE WHEN octet_length({blob}) = {4 * DIM} THEN list_transform(list_transform(range({DIM}), lambda i: {word}), lambda x: {value}) END"


#: Usable vectors in SQL: ``dv`` (field, id, vec) of the searchable rows, ``av`` of all rows.
DV_SQL = f"""av AS MATERIALIZED (SELECT field, id, live, vec FROM (
    SELECT 'context' AS field, id, indexed AND superseded_by IS NULL AS live, {_decoded('embedding_context')} AS vec FROM memories
    UNION ALL SELECT 'action', id, indexed AND superseded_by IS NULL, {_decoded('embedding_action')} FROM memories
    UNION ALL SELECT 'result', id, indexed AND superseded_by IS NULL, {_decoded('embedding_result')} FROM memories)
    WHERE len(list_filter(vec, lambda x: x IS NULL)) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
dv AS (SELECT field, id, vec FROM av WHERE live)"""
NUMBER_SQL = "('0x' || substr({}, 5))::BIGINT"
ASKED_SQL = f"{NUMBER_SQL.format('id')} % 20 = 0"


def reward_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(router_level, state, action, reward, seq) of the events table."""
    e = table(spark, sf_dir, "events")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))
    modes, actions = ("debug", "architecture", "coding", "review", "plan", "routine"), ("high_threshold", "medium_threshold", "low_threshold")
    return e.select(
        F.lit("search").alias("router_level"),
        pick(modes, F.col("user_id") % 6).alias("state"),
        pick(actions, F.col("event_id") % 3).alias("action"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("reward"),
        F.col("event_id").alias("seq"),
    )


REWARDS_SQL = """rw AS (SELECT 'search' AS router_level, ['debug', 'architecture', 'coding', 'review', 'plan', 'routine'][user_id % 6 + 1] AS state,
    ['high_threshold', 'medium_threshold', 'low_threshold'][event_id % 3 + 1] AS action, least(value / 100, 1.0) AS reward, event_id AS seq FROM events)"""
