"""Reads and snapshot-to-snapshot changes of the store.

Plain parquet has no UPDATE or MERGE: every change is a function from a snapshot
to the next one, to be written once to a fresh folder.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlens.functions.text import normalize_tags, tag_form
from memlens.runtime import cut, small
from memlens.schemas import INSIGHT_TYPES, MEMORY, MEMORY_TYPES, PORTABLE, STATUSES


class NotFound(LookupError):
    """A row that a change names does not exist."""


class Conflict(ValueError):
    """A row with the same key is there already."""


# -- reads

def active(memories: DataFrame) -> DataFrame:
    return memories.where("superseded_by is null")


def by_id(memories: DataFrame, id_: str) -> DataFrame:
    return memories.where(F.col("id") == id_).limit(1)


def unindexed(memories: DataFrame, limit: int) -> DataFrame:
    """Rows to index, superseded ones too; smallest ids first so that the batch is defined."""
    return memories.where(~F.col("indexed")).orderBy("id").limit(limit)


def indexed_ids(memories: DataFrame) -> DataFrame:
    return active(memories).where("indexed").select("id")


def reindex_candidates(memories: DataFrame, limit: int = 100) -> DataFrame:
    return memories.where(~F.col("indexed") & F.col("embedding_context").isNotNull()).orderBy("id").select("id").limit(limit)


def insights(memories: DataFrame) -> DataFrame:
    return active(memories).where("memory_type = 'insight'")


def ordered_ids(memories: DataFrame) -> DataFrame:
    """(place, id): active ids without insights by created_at and id, numbered from 1.

    Rows are sorted by range partitions and counted in each; only the counts go to the driver, as many as there are partitions.
    """
    own = active(memories).where("memory_type <> 'insight'").select("created_at", "id")
    sorted_ = cut(own.orderBy("created_at", "id").withColumn("_n", F.monotonically_increasing_id()))
    part, within = F.shiftright("_n", 33), F.col("_n").bitwiseAND((1 << 33) - 1)
    before, offsets = 0, []
    for r in sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["n"]
    start = memories.sparkSession.createDataFrame(offsets, "part long, before long")
    return sorted_.withColumn("part", part).join(F.broadcast(start), "part").select((F.col("before") + within + 1).alias("place"), "id")


def contains(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (id) with whether the index has vectors of them."""
    have = vectors.select("id").distinct().withColumn("_have", F.lit(True))
    return ids.select("id").join(have, "id", "left").select("id", F.coalesce("_have", F.lit(False)).alias("indexed"))


def training_rows(memories: DataFrame, types: Iterable[str] | None = None) -> DataFrame:
    """Without types: active rows that are no insights; with types: all rows of them."""
    if types is None:
        return active(memories).where("memory_type <> 'insight'")
    return memories.where(F.col("memory_type").isin(*types))


def embedded(memories: DataFrame) -> DataFrame:
    return memories.where(F.col("embedding_context").isNotNull())


def above(memories: DataFrame, score: float) -> DataFrame:
    """Rows of a score above ``score``, as doubles."""
    return memories.where(F.col("score").cast("double") > score)


def listed(memories: DataFrame, memory_type: str | None = None, text: str | None = None) -> DataFrame:
    """Rows of the type whose context holds the text, case aside."""
    out = memories if memory_type is None else memories.where(F.col("memory_type") == memory_type)
    return out if not text else out.where(F.lower("context").contains(text.lower()))


def counts(memories: DataFrame) -> DataFrame:
    """One row: memories, indexed, and avg_score, 0 for none; NaN scores don't count."""
    score = F.col("score").cast("double")
    return memories.agg(F.count("*").alias("memories"), F.count_if("indexed").alias("indexed"), F.coalesce(F.avg(F.when(~F.isnan(score), score)), F.lit(0.0)).alias("avg_score"))


def distribution(memories: DataFrame, column: str, none: str | None = None) -> DataFrame:
    """(column, n), most frequent first; null is a value of its own and shows as ``none``."""
    by = memories.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("n"))
    return by.select((F.col("_v") if none is None else F.coalesce("_v", F.lit(none))).alias(column), "n").orderBy(F.desc("n"), column)


def kinds(memories: DataFrame) -> DataFrame:
    """The memory types there are, in order."""
    return memories.select("memory_type").distinct().orderBy("memory_type")


def q_value(q_table: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (router_level, state, action) with their value, 0 where there is none."""
    on = ["router_level", "state", "action"]
    return keys.join(q_table.select(*on, "value"), on, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def recent(memories: DataFrame, n: int) -> DataFrame:
    return memories.orderBy(F.desc("created_at"), F.asc("id")).limit(n)


def audit_log(log: DataFrame, n: int = 50) -> DataFrame:
    return log.orderBy(F.desc("performed_at"), F.desc("id")).limit(n)


# -- checks

def violations(memories: DataFrame) -> DataFrame:
    """(id, problem): rows that the store's constraints refuse."""
    checks = {
        "id": F.col("id").isNull() | (F.length("id") == 0) | (F.length("id") > 100),
        "memory_type": ~F.coalesce(F.col("memory_type").isin(*MEMORY_TYPES), F.lit(False)),
        "insight_type": F.col("insight_type").isNotNull() & ~F.col("insight_type").isin(*INSIGHT_TYPES),
        "field_bytes": F.greatest(*[F.octet_length(F.coalesce(F.col(c), F.lit(""))) for c in ("context", "action", "result")]) > 10_000,
        "null_text": F.col("context").isNull() | F.col("action").isNull() | F.col("result").isNull(),
    }
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return memories.select("id", F.explode(named).alias("problem"))


def check_query(query: str, limit: int | None = None) -> None:
    if len(query.encode()) > 5000:
        raise ValueError("query is longer than 5000 bytes")
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")


def check_unit(name: str, value: float) -> None:
    if not 0 <= value <= 1:  # NaN fails too
        raise ValueError(f"{name} must lie in [0, 1]")


def check_id(id_: str) -> None:
    if not id_ or len(id_) > 100:
        raise ValueError("an id has 1 to 100 characters")


def check_days(days: int) -> None:
    if not 0 <= days <= 3650:
        raise ValueError("stale days must lie in [0, 3650]")


def check_status(status: Column) -> Column:
    return status.isin(*STATUSES)


# -- inserts and deletes

def insert(memories: DataFrame, rows: DataFrame) -> DataFrame:
    """All rows or none: a repeated id, in the store or among the rows, is a conflict."""
    again = rows.groupBy("id").count().where("count > 1").select("id").unionByName(rows.join(memories.select("id"), "id", "left_semi").select("id"))
    if (first := again.first()) is not None:
        raise Conflict(f"id {first['id']} exists")
    return memories.unionByName(rows)


def replace_insights(memories: DataFrame, new: DataFrame) -> DataFrame:
    """All insights make way for the new ones; no new ones, no change."""
    if new.isEmpty():
        return memories
    return memories.where("memory_type <> 'insight'").unionByName(new)


def delete(memories: DataFrame, feedback: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the rows of ``ids`` (id)."""
    gone = ids.select("id").distinct()
    return memories.join(gone, "id", "left_anti"), feedback.join(gone.withColumnRenamed("id", "memory_id"), "memory_id", "left_anti")


def delete_insights(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the insights of ``ids``; other rows are refused."""
    other = memories.where("memory_type <> 'insight'").join(ids, "id", "left_semi")
    if (first := other.select("id").first()) is not None:
        raise ValueError(f"{first['id']} is no insight")
    return memories.join(ids.select("id"), "id", "left_anti")


def insight_rows(new: DataFrame, now: str) -> DataFrame:
    """Insights as rows of memories: score 0, not indexed, times now, no vectors."""
    given = {"memory_type": F.lit("insight"), "score": F.lit(0.0), "indexed": F.lit(False), "created_at": F.lit(now), "updated_at": F.lit(now), "used_count": F.lit(0)}
    return new.select(*[(F.col(f.name) if f.name in new.columns else given.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in MEMORY])


# -- updates

def set_fields(memories: DataFrame, updates: DataFrame, strict: bool = True) -> DataFrame:
    """Columns of ``updates`` (id, ...) overwrite those of the same rows. Unknown ids raise if ``strict``.

    A null in ``updates`` sets null; the last of repeated ids by its other columns' order holds.
    """
    changed = [c for c in updates.columns if c != "id"]
    one = updates.groupBy("id").agg(F.max(F.struct(*changed)).alias("_new"))
    if strict and (first := one.join(memories.select("id"), "id", "left_anti").first()) is not None:
        raise NotFound(first["id"])
    joined = memories.join(one, "id", "left")
    value = {f.name: F.when(F.col("_new").isNotNull(), F.col(f"_new.{f.name}")).otherwise(F.col(f.name)).cast(f.dataType) for f in memories.schema if f.name in changed}
    return joined.select(*[value.get(c, F.col(c)).alias(c) for c in memories.columns])


def touch(memories: DataFrame, touches: DataFrame) -> DataFrame:
    """``touches`` (id, at): used_count grows by the touches of a row, last_used_at is the last of them."""
    by = touches.groupBy("id").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    out = memories.join(by, "id", "left")
    new = {"used_count": F.coalesce("used_count", F.lit(0)) + F.coalesce("_n", F.lit(0)), "last_used_at": F.coalesce("_at", "last_used_at")}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in memories.columns])


def upsert_q(q_table: DataFrame, updates: DataFrame) -> DataFrame:
    """``updates`` (router_level, state, action, value, seq, updated_at): the last value holds, counts add up."""
    key = ["router_level", "state", "action"]
    new = updates.groupBy(*key).agg(F.max_by("value", "seq").alias("_v"), F.count("*").alias("_n"), F.max_by("updated_at", "seq").alias("_at"))
    both = q_table.join(new, key, "full")
    return both.select(
        *key,
        F.coalesce("_v", "value").alias("value"),
        (F.coalesce("update_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("update_count"),
        F.coalesce("_at", "updated_at").alias("updated_at"),
    )


def upsert_meta(meta: DataFrame, updates: DataFrame) -> DataFrame:
    """(key, value): values of ``updates`` win."""
    return updates.unionByName(meta.join(updates.select("key"), "key", "left_anti"))


def mark_judged(feedback: DataFrame, judged: DataFrame) -> DataFrame:
    """``judged`` (memory_id, at): all unjudged rows of those memories become judged at that time."""
    by = judged.groupBy("memory_id").agg(F.max("at").alias("_at"))
    out = feedback.join(small(cut(by)), "memory_id", "left")
    hit = F.col("_at").isNotNull() & ~F.coalesce("judged", F.lit(False))
    return out.select("memory_id", "query_id", "searched_at", (F.col("judged") | hit).alias("judged"), F.when(hit, F.col("_at")).otherwise(F.col("judged_at")).alias("judged_at"))


def feedback_rows(hits: DataFrame, at: str) -> DataFrame:
    """One unjudged feedback row for each shown hit (query_id, id)."""
    return hits.select(F.col("id").alias("memory_id"), "query_id", F.lit(at).alias("searched_at"), F.lit(False).alias("judged"), F.lit(None).cast("string").alias("judged_at"))


def consolidation_row(action: Column, ids: Column, reason: Column, id_: Column, at: Column, by: Column) -> list[Column]:
    return [id_.alias("id"), action.alias("action"), F.to_json(ids).alias("memory_ids"), reason.alias("reason"), at.alias("performed_at"), by.alias("performed_by")]


# -- import, export, migration

def portable(memories: DataFrame) -> DataFrame:
    """Active rows in the portable columns."""
    return active(memories).select(*PORTABLE)


def envelope(memories: DataFrame, at: str) -> DataFrame:
    """(version, count, exported_at) of an export."""
    return portable(memories).agg(F.lit(1).alias("version"), F.count("*").alias("count"), F.lit(at).alias("exported_at"))


def merge_import(memories: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows an import adds, and (imported, skipped).

    Ids of the store are skipped; of rows with the same id the first by ``created_at`` and content is taken.
    Tags are normalised, vectors and supersession are null, nothing is indexed.
    """
    order = Window.partitionBy("id").orderBy("created_at", F.to_json(F.struct(*[c for c in PORTABLE if c != "id"])))
    first = rows.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    fresh = first.join(memories.select("id"), "id", "left_anti")
    given = {"tags": normalize_tags(F.col("tags")), "indexed": F.lit(False)}
    added = fresh.select(*[(given[f.name] if f.name in given else F.col(f.name) if f.name in PORTABLE else F.lit(None)).cast(f.dataType).alias(f.name) for f in MEMORY])
    counts = rows.select(F.lit(1).alias("r"), F.lit(0).alias("a")).unionByName(added.select(F.lit(0).alias("r"), F.lit(1).alias("a")))
    totals = counts.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("imported"), (F.coalesce(F.sum("r"), F.lit(0)) - F.coalesce(F.sum("a"), F.lit(0))).alias("skipped"))
    return added, totals


def classify_migration(rows: DataFrame, project: str | None, all_projects: bool = False) -> DataFrame:
    """Each row with ``_class``: matched, skipped_null or skipped_other."""
    if all_projects or project is None:
        kind = F.lit("matched")
    else:
        kind = F.when(F.col("project").isNull(), "skipped_null").when(F.col("project") == project, "matched").otherwise("skipped_other")
    return rows.withColumn("_class", kind)


def migrate(target: DataFrame, source: DataFrame, project: str | None, all_projects: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows to copy (never indexed) and stats (read, matched, migrated, skipped_existing, skipped_null, skipped_other)."""
    rows = classify_migration(source, project, all_projects)
    have = target.select("id").distinct().withColumn("_have", F.lit(True))
    seen = rows.join(have, "id", "left")
    new = (F.col("_class") == "matched") & F.col("_have").isNull()
    stats = seen.agg(
        F.count("*").alias("read"),
        F.count_if(F.col("_class") == "matched").alias("matched"),
        F.count_if(new).alias("migrated"),
        F.count_if((F.col("_class") == "matched") & F.col("_have").isNotNull()).alias("skipped_existing"),
        F.count_if(F.col("_class") == "skipped_null").alias("skipped_null"),
        F.count_if(F.col("_class") == "skipped_other").alias("skipped_other"),
    )
    return seen.where(new).drop("_class", "_have").withColumn("indexed", F.lit(False)), stats


def comma_suspects(memories: DataFrame) -> DataFrame:
    return memories.where("tags NOT LIKE '[%' AND tags LIKE '%,%'").select("id", "tags")


def migrate_tags(memories: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Memories with canonical tags, and the counts of each form met."""
    if strict and not comma_suspects(memories).isEmpty():
        raise ValueError("tags with commas that are no JSON")
    form = tag_form(F.col("tags"))
    stats = memories.select(form.alias("f")).agg(F.count("f").alias("scanned"), *[F.count_if(F.col("f") == n).alias(n) for n in ("already_json", "rewritten_csv", "rewritten_naked")])
    return memories.withColumn("tags", F.when(form.isNotNull(), normalize_tags(F.col("tags"))).otherwise(F.col("tags"))), stats


def add_column(df: DataFrame, name: str, kind: str = "string") -> DataFrame:
    """``df`` with a null column of that name unless it has one."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))
