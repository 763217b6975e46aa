"""Jobs of several stages: insight generation, startup migrations, judging, previews."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlens.functions.prompts import judge_prompt, judge_reply, merge_prompt
from memlens.functions.text import merge_verdict, strip_thinking
from memlens.operators import consolidation as con
from memlens.operators import mining, ranking, routing, store
from memlens.runtime import cut
from memlens.sources.portable import message

#: A text generator: a column of prompts to a column of replies, null where it fails.
Generator = Callable[[Column], Column]
#: What the store's rows look like to prompts.
TEXTS = ("id", "context", "action", "result")


# -- insight generation

@dataclass
class Run:
    """What a run made: messages (value) as JSON lines in order, and the insights."""

    messages: DataFrame
    insights: DataFrame
    failed: list[str] = field(default_factory=list)


def _medium(memories: DataFrame, q_table: DataFrame | None, feedback: DataFrame) -> list[tuple[str, int, Callable[[], list[DataFrame]]]]:
    """(stage, percent, work): each stage gives insight frames and message frames (value)."""
    rows = mining.training_rows(memories)
    least = mining.CLUSTER_SIMILARITY

    def clustering() -> list[DataFrame]:
        own = rows.where("embedding_context is not null")
        vectors = own.select("id", mining.blob_to_vector("embedding_context").alias("vec"))
        return [mining.cluster_insights(mining.average_linkage_clusters(own, ranking.near_links(vectors, least)), memories)]

    def models() -> list[DataFrame]:
        told = []
        for name, fitted, data in (
            ("classifier", mining.classifier(memories), lambda: mining.training_texts(memories)), ("ranker", mining.ranker(memories, feedback), lambda: mining.labelled(memories, feedback)),
        ):
            if fitted is not None:
                accuracy = mining.accuracy(fitted.transform(data()))
                told.append(accuracy.select(message("metric", name=F.lit(f"{name}_accuracy"), value=F.col("accuracy")).alias("value")))
        return told

    def meta() -> list[DataFrame]:
        told = mining.metrics(memories, q_table).select(message("metric", name=F.col("name"), value=F.col("value")).alias("value"))
        advice = mining.low_scores(memories).select(message("recommendation", target_id=F.col("target_id"), action=F.col("action"), reasoning=F.col("reasoning")).alias("value"))
        return [told, advice]

    return [
        ("clustering", 20, clustering),
        ("temporal", 40, lambda: [mining.temporal_insights(mining.recurrence(memories))]),
        ("causal", 60, lambda: [mining.chain_insights(mining.chains(memories), memories)]),
        ("training", 70, models),
        ("meta", 90, meta),
    ]


def run_medium(memories: DataFrame, feedback: DataFrame, q_table: DataFrame | None = None) -> Run:
    """Clusters, recurrences, chains, models and metrics. A stage that fails is reported and the others go on."""
    return _run(_medium(memories, q_table, feedback), memories)


def run_deep(memories: DataFrame, feedback: DataFrame, q_table: DataFrame | None = None, generated: DataFrame | None = None) -> Run:
    """As :func:`run_medium`, with the texts for a language model and the check of what one ``generated`` (id, generated, reference)."""
    stages = _medium(memories, q_table, feedback)

    def texts() -> list[DataFrame]:
        count = mining.training_lines(memories).agg(F.count("*").cast("double").alias("n"))
        return [count.select(message("metric", name=F.lit("training_texts"), value=F.col("n")).alias("value"))]

    def quality() -> list[DataFrame]:
        if generated is None:
            return []
        return [mining.quality_gate(generated).select(message("metric", name=F.lit("text_quality_rouge_l"), value=F.col("score")).alias("value"))]

    return _run([*stages[:-1], ("text", 75, texts), ("quality_gate", 90, quality), stages[-1]], memories)


def _run(stages: list[tuple[str, int, Callable[[], list[DataFrame]]]], memories: DataFrame) -> Run:
    spark, began = memories.sparkSession, time.monotonic()
    line = lambda kind, **f: spark.range(1).select(message(kind, **{k: F.lit(v) for k, v in f.items()}).alias("value"))
    parts, made, failed = [line("progress", stage="loading", percent=0.0)], [], []
    for name, percent, work in stages:
        parts.append(line("progress", stage=name, percent=float(percent)))
        try:
            for df in [cut(d) for d in work()]:
                if "insight_type" in df.columns:
                    made.append(df)
                    df = df.select(message("insight", **{c: F.col(c) for c in ("id", "context", "action", "result", "insight_type", "source_ids", "tags")}).alias("value"))
                parts.append(df)
        except Exception as error:  # a stage stands alone
            failed.append(name)
            parts.append(line("progress", stage=f"{name}_failed: {str(error)[:200]}", percent=float(percent)))
    empty = spark.createDataFrame([], "id string, context string, action string, result string, insight_type string, source_ids string, tags string")
    insights = empty
    for df in made:
        insights = insights.unionByName(df)
    count = insights.count()
    parts.append(line("complete", insights_generated=count, duration_ms=int(1000 * (time.monotonic() - began))))
    out = None
    for k, df in enumerate(parts):
        df = df.select(F.lit(k).alias("part"), "value")
        out = df if out is None else out.unionByName(df)
    return Run(out, insights, failed)


# -- consolidation

def preview(groups: DataFrame, stale_ids: DataFrame, orphan_ids: DataFrame) -> DataFrame:
    """One row: duplicates (groups), stale, garbage."""
    count = lambda df, name, what="*": df.agg((F.count("*") if what == "*" else F.count_distinct(what)).alias(name))
    return count(groups, "duplicates", "primary_id").crossJoin(F.broadcast(count(stale_ids, "stale"))).crossJoin(F.broadcast(count(orphan_ids, "garbage")))


def load_groups(groups: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(primary_id, id, and the texts) of groups (primary_id, id) that are whole, and (primary_id, missing, error) of the others.

    A group that lacks a member is not analysed at all; its error names the smallest missing id.
    """
    full = cut(groups.select("primary_id", "id").join(memories.select(*TEXTS, F.lit(True).alias("_have")), "id", "left"))
    gone = full.where("_have is null").groupBy("primary_id").agg(F.count("*").alias("missing"), F.min("id").alias("first"))
    errors = gone.select("primary_id", "missing", F.concat(F.lit("memory not found: "), "first").alias("error"))
    return full.join(gone.select("primary_id"), "primary_id", "left_anti").select("primary_id", *TEXTS), errors


def merge_prompts(groups: DataFrame, memories: DataFrame) -> DataFrame:
    """(primary_id, id, survivor_id, prompt) for every member that is not its group's survivor."""
    members = con.survivors(groups, memories).where("id <> survivor_id")
    text = F.struct(*TEXTS)
    a = memories.select(F.col("id").alias("survivor_id"), text.alias("a"))
    b = memories.select("id", text.alias("b"))
    return members.join(a, "survivor_id").join(b, "id").select("primary_id", "id", "survivor_id", merge_prompt(F.col("a"), F.col("b")).alias("prompt"))


def verdicts(groups: DataFrame, memories: DataFrame, generate: Generator) -> DataFrame:
    """(id, verdict) by a text generator: merge if the reply's first word is MERGE. A reply that fails keeps both."""
    reply = strip_thinking(generate(F.col("prompt")))
    return merge_prompts(groups, memories).select("id", F.coalesce(merge_verdict(reply), F.lit("keep")).alias("verdict"))


# -- judging

def judge_rows(asked: DataFrame, memories: DataFrame, now: Column, generate: Generator | None = None) -> DataFrame:
    """(memory_id, score, reason, degraded) for ``asked`` (memory_id, query, score).

    A given score holds as it is. Else the generator's reply is taken where it can be read, and the heuristic where not, which
    counts as degraded if there is a generator. Ids that are not in the store give no row.
    """
    rows = asked.select("memory_id", "query", F.col("score").alias("given")).join(memories.select(F.col("id").alias("memory_id"), "context", "action", "result", "updated_at", "used_count"), "memory_id")
    plain, why = routing.judge(F.coalesce("query", F.lit("")), F.concat_ws(" ", "context", "action", "result"), routing.days_since(F.col("updated_at"), now), F.col("used_count"))
    rows = rows.withColumn("plain", plain).withColumn("why", why)
    told = F.lit(None).cast("struct<score:double,reason:string>")
    if generate is not None:
        prompt = judge_prompt(F.col("query"), F.col("context"), F.col("action"), F.col("result"))
        rows = rows.withColumn("reply", generate(F.when(F.col("given").isNull(), prompt)))
        told = judge_reply(strip_thinking(F.col("reply")))
    rows = rows.withColumn("told", told)
    explicit = F.col("given").isNotNull()
    score, fell_back = routing.combined(F.col("told.score"), F.col("plain"))
    return rows.select(
        "memory_id",
        F.when(explicit, F.col("given").cast("double")).otherwise(score).alias("score"),
        F.when(explicit, "explicit score").otherwise(F.coalesce("told.reason", "why")).alias("reason"),
        (~explicit & fell_back & F.lit(generate is not None)).alias("degraded"),
    )


def judge(asked: DataFrame, memories: DataFrame, feedback: DataFrame, now: str, generate: Generator | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memories with the new scores, feedback with their rows judged, and what :func:`judge_rows` says."""
    told = cut(judge_rows(asked, memories, F.lit(now).cast("timestamp"), generate))
    scored = store.set_fields(memories, told.select(F.col("memory_id").alias("id"), F.col("score").cast("float").alias("score")))
    return scored, store.mark_judged(feedback, told.select("memory_id", F.lit(now).alias("at"))), told


# -- startup migrations

#: Keys of the metadata that say what has run, and the value that says so.
DONE = {"tags_format": "json_array_v1", "feedback_query_id": "v1", "text_index": "porter unicode61 v1"}


def pending_migrations(meta: DataFrame) -> list[str]:
    known = {r["key"]: r["value"] for r in meta.where(F.col("key").isin(*DONE)).collect()}
    return [k for k, v in DONE.items() if known.get(k) != v]


def run_migrations(memories: DataFrame, feedback: DataFrame, meta: DataFrame, strict: bool = False, dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """Memories, feedback and metadata after all migrations that have not run yet, and a report. Running again changes nothing.

    Tags become canonical, feedback gets its query id, and a text index of another analyser is to be built anew. A dry run only reports.
    """
    todo, report = pending_migrations(meta), {}
    out, told = memories, feedback
    if "tags_format" in todo:
        out, counts = store.migrate_tags(memories, strict)
        report["tags_format"] = counts.first().asDict()
    if "feedback_query_id" in todo:
        told = store.add_column(feedback, "query_id")
        report["feedback_query_id"] = "query_id" not in feedback.columns
    if "text_index" in todo:
        report["text_index"] = True
    if dry_run or not todo:
        return memories, feedback, meta, report
    new = meta.sparkSession.createDataFrame([(k, DONE[k]) for k in todo], "key string, value string")
    return out, told, store.upsert_meta(meta, new), report
