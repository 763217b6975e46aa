"""Duplicates, stale and orphan rows, the plan to consolidate them, and its application."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlens.functions.text import probe_text
from memlens.functions.timeutil import days_between, instant
from memlens.operators.ranking import bm25, query_tokens
from memlens.operators.store import set_fields
from memlens.runtime import clean_key, cut, drop_table, estimated_bytes

PROBE_HITS = 5
#: Bytes of open links from which one task takes them in order; more are decided in rounds by all tasks.
TAIL_BYTES = 32 << 20
# Confidences of the recommendations.
CONFIDENCE = {"merge_model": 0.8, "keep": 0.7, "merge": 0.6, "archive": 0.9, "delete": 0.95}
TEXTS = ("context", "action", "result")


def candidates(memories: DataFrame) -> DataFrame:
    return memories.where("superseded_by is null and memory_type <> 'insight'")


def exact_groups(memories: DataFrame) -> DataFrame:
    """(primary_id, size, created_at): rows of equal texts; the smallest id is primary.

    Members come from :func:`exact_members`; a group may be of any size, so ids are never collected.
    """
    own = candidates(memories).groupBy(*TEXTS).agg(F.min("id").alias("primary_id"), F.count("*").alias("size"), F.min("created_at").alias("created_at"))
    return own.where("size > 1").select("primary_id", "size", "created_at")


def exact_members(memories: DataFrame) -> DataFrame:
    """(primary_id, id, similarity) of every member of an exact group."""
    key = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit("\0")).alias(c) for c in TEXTS])), 256)
    own = candidates(memories).select("id", key.alias("k"))
    groups = own.groupBy("k").agg(F.min("id").alias("primary_id"), F.count("*").alias("n")).where("n > 1")
    return own.join(groups, "k").select("primary_id", "id", F.lit(1.0).alias("similarity"))


def text_probes(memories: DataFrame, k: int = PROBE_HITS, stem: bool = True) -> DataFrame:
    """(probe_id, id, rank, pos): best ``k`` rows for each row's own context, then without the probe, insights and superseded rows.

    The cut comes first, so a probe may have fewer hits than ``k``.
    """
    probes = candidates(memories).select(F.col("id").alias("query_id"), probe_text(F.col("context")).alias("query"))
    hits = bm25(memories, query_tokens(probes, stem), k, stem)
    keep = candidates(memories).select("id")
    return hits.where("query_id <> id").join(keep, "id", "left_semi").select(F.col("query_id").alias("probe_id"), "id", "rank", "pos")


def text_groups(memories: DataFrame, probes: DataFrame, floor: float = 0.0) -> DataFrame:
    """(primary_id, id, similarity): groups taken greedily in order of creation from probe hits.

    A row joins the first group that meets it; rows of exact groups are taken already. Similarity is the mean of the
    absolute ranks of the group; groups under ``floor`` are not made and take nothing. The order is kept without
    running through it: in each round every open probe that no earlier open probe shares a row with is decided, so
    the rows it meets are settled, and the result is that of the sequential pass. Rounds are as many as the longest run of
    probes that wait for one another; once the open links are under TAIL_BYTES one task goes through the rest in order.
    """
    taken = cut(exact_members(memories).select("id").distinct())
    order = F.struct("created_at", F.col("id").alias("probe"))
    rows = candidates(memories).select("id", "created_at")
    links = rows.select(F.col("id").alias("probe_id"), order.alias("at")).join(probes.select("probe_id", "id", F.abs("rank").alias("rank")), "probe_id")
    open_ = cut(links.join(taken.withColumnRenamed("id", "probe_id"), "probe_id", "left_anti").join(taken, "id", "left_anti"))
    made: list[DataFrame] = []
    while not open_.isEmpty():
        if estimated_bytes(open_) <= TAIL_BYTES:
            made.append(cut(_in_order(open_, floor)))
            break
        # a probe meets itself and its free hits
        meets = open_.select("at", "id").unionByName(open_.select("at", F.col("probe_id").alias("id"))).distinct()
        first = meets.groupBy("id").agg(F.min("at").alias("first"))
        waits = meets.join(first, "id").groupBy("at").agg(F.bool_and(F.col("at") == F.col("first")).alias("ready"))
        ready = cut(open_.join(waits.where("ready").select("at"), "at", "left_semi").groupBy("at", "probe_id").agg(F.avg("rank").alias("similarity")))
        good = ready.where(F.col("similarity") >= floor)
        group = cut(
            open_.join(good.select("at", "similarity"), "at").select(F.col("probe_id").alias("primary_id"), "id", "similarity").unionByName(
                good.select(F.col("probe_id").alias("primary_id"), F.col("probe_id").alias("id"), "similarity")
            )
        )
        made.append(group)
        used = group.select("id").distinct()
        rest = open_.join(ready.select("at"), "at", "left_anti")
        before, open_ = open_, cut(rest.join(used, "id", "left_anti").join(used.withColumnRenamed("id", "probe_id"), "probe_id", "left_anti"))
        drop_table(before)
    if not made:
        return rows.select(F.col("id").alias("primary_id"), "id", F.lit(0.0).alias("similarity")).limit(0)
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def _in_order(links: DataFrame, floor: float) -> DataFrame:
    """(primary_id, id, similarity): the groups of open links (at, probe_id, id, rank), taken by one task in the order of ``at``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used: set[str] = set()
        held: list[pd.DataFrame] = []
        for pdf in frames:
            # the last probe of a frame may go on in the next
            pdf = pd.concat([*held, pdf]) if held else pdf
            last = pdf["probe_id"] == pdf["probe_id"].iloc[-1] if len(pdf) else slice(0)
            held = [pdf[last]]
            yield _take(pdf[~last] if len(pdf) else pdf, used, floor)
        for pdf in held:
            yield _take(pdf, used, floor)

    ordered = links.select("at.created_at", "probe_id", "id", "rank").coalesce(1).sortWithinPartitions("created_at", "probe_id", "id")
    return ordered.select("probe_id", "id", "rank").mapInPandas(run, "primary_id string, id string, similarity double")


def _take(links: pd.DataFrame, used: set[str], floor: float) -> pd.DataFrame:
    """The groups of whole probes (probe_id, id, rank) in order; what they take is added to ``used``."""
    probes, hits, ranks = (links[c].tolist() for c in ("probe_id", "id", "rank"))
    out: list[tuple[str, str, float]] = []
    start = 0
    while start < len(probes):
        probe, end = probes[start], start
        while end < len(probes) and probes[end] == probe:
            end += 1
        free = [i for i in range(start, end) if hits[i] not in used] if probe not in used else []
        start = end
        if free and (similarity := sum(ranks[i] for i in free) / len(free)) >= floor:
            group = [probe, *(hits[i] for i in free)]
            used.update(group)
            out += [(probe, i, similarity) for i in group]
    return pd.DataFrame(out, columns=["primary_id", "id", "similarity"]).astype({"similarity": float})


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id each end of the links (a, b) is connected with.

    Labels spread to neighbours and hop along labels, so long chains take few rounds; each round is cut.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(state.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        spread = state.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        hop = state.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = cut(spread.join(hop, "component", "left").select("id", F.least("component", F.coalesce("next", "component")).alias("component"), "old"))
        state = new.select("id", "component")
        if new.where("component <> old").isEmpty():
            return state


def stale(memories: DataFrame, now: Column, days: int = 90, min_score: float = 0.3, active_only: bool = False) -> DataFrame:
    """(id): unused rows of low score last changed over ``days`` days ago; unreadable times are left out."""
    age = days_between(instant(F.col("created_at")), now)
    own = memories.where((F.col("score") < F.lit(min_score)) & (F.coalesce("used_count", F.lit(0)) == 0) & (age > days))
    return (own.where("superseded_by is null") if active_only else own).select("id")


def orphans(memories: DataFrame) -> DataFrame:
    """(id, parent_id) of rows whose parent is not in the store, blanks and case aside."""
    known = memories.select(clean_key(F.col("id")).alias("k"))
    return memories.select("id", "parent_id", clean_key(F.col("parent_id")).alias("k")).where("k is not null").join(known, "k", "left_anti").select("id", "parent_id")


def survivors(groups: DataFrame, memories: DataFrame) -> DataFrame:
    """(primary_id, id, survivor_id) for groups (primary_id, id).

    The survivor is no insight if possible, then has the best score, most uses, earliest creation, smallest id. A max over a
    struct combines map-side, so a group of any size is no bottleneck.
    """
    full = groups.select("primary_id", "id").join(memories.select("id", "memory_type", "score", "used_count", "created_at"), "id")
    order = F.struct((F.col("memory_type") == "insight").alias("i"), (-F.coalesce("score", F.lit(0.0))).alias("s"), (-F.coalesce("used_count", F.lit(0))).alias("u"), "created_at", "id")
    best = full.groupBy("primary_id").agg(F.min(order)["id"].alias("survivor_id"))
    return full.select("primary_id", "id").join(best, "primary_id")


def plan(groups: DataFrame, stale_ids: DataFrame, orphan_ids: DataFrame, memories: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(ordinal, action, id, survivor_id, confidence): merges, then archives, then deletes.

    ``verdicts`` (id, verdict) of a model turn members into merge or keep; without them all members merge.
    """
    members = survivors(groups, memories).where("id <> survivor_id")
    if verdicts is None:
        merge = members.select(F.lit(0).alias("ordinal"), F.lit("merge").alias("action"), "id", "survivor_id", F.lit(CONFIDENCE["merge"]).alias("confidence"))
    else:
        said = members.join(verdicts, "id")
        yes = F.col("verdict") == "merge"
        merge = said.select(
            F.lit(0).alias("ordinal"), F.col("verdict").alias("action"), "id", F.when(yes, F.col("survivor_id")).alias("survivor_id"),
            F.when(yes, CONFIDENCE["merge_model"]).otherwise(CONFIDENCE["keep"]).alias("confidence"),
        )
    none = F.lit(None).cast("string").alias("survivor_id")
    archive = stale_ids.select(F.lit(1).alias("ordinal"), F.lit("archive").alias("action"), "id", none, F.lit(CONFIDENCE["archive"]).alias("confidence"))
    remove = orphan_ids.select(F.lit(2).alias("ordinal"), F.lit("delete").alias("action"), "id", none, F.lit(CONFIDENCE["delete"]).alias("confidence"))
    return merge.unionByName(archive).unionByName(remove)


def action_json(plan_: DataFrame) -> Column:
    """Polymorphic form of a step: its type and the ids that type has."""
    return F.to_json(
        F.struct(
            F.col("action").alias("type"),
            F.when(F.col("action") == "merge", F.col("survivor_id")).alias("source_id"),
            F.when(F.col("action") == "merge", F.col("id")).alias("target_id"),
            F.when(F.col("action") != "merge", F.col("id")).alias("memory_id"),
        )
    )


def gate(plan_: DataFrame, min_confidence: float) -> DataFrame:
    return plan_.where(F.col("confidence") >= min_confidence)


def apply_plan(memories: DataFrame, feedback: DataFrame, plan_: DataFrame, at: str, by: str = "agent") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Memories, feedback and audit rows after a plan, and counts by action.

    Merged rows point to their survivor, archived ones leave the index, deleted ones go with their feedback. Steps
    for rows that are gone count as errors and change nothing else.
    """
    known = plan_.join(memories.select("id"), "id", "left_semi")
    merged = known.where("action = 'merge'").select("id", F.col("survivor_id").alias("superseded_by"))
    archived = known.where("action = 'archive'").select("id", F.lit(False).alias("indexed"))
    deleted = known.where("action = 'delete'").select("id").distinct()
    out = set_fields(set_fields(memories, merged, strict=False), archived, strict=False).join(deleted, "id", "left_anti").select(*memories.columns)
    told = feedback.join(deleted.withColumnRenamed("id", "memory_id"), "memory_id", "left_anti").select(*feedback.columns)
    changes = known.where("action <> 'keep'")
    audit = changes.select(
        F.concat(F.lit(f"consol-{at}-"), F.sha2(F.concat_ws("|", "ordinal", "action", "id"), 256).substr(1, 16)).alias("id"),
        "action",
        F.to_json(F.when(F.col("action") == "merge", F.array("survivor_id", "id")).otherwise(F.array("id"))).alias("memory_ids"),
        F.lit(None).cast("string").alias("reason"),
        F.lit(at).alias("performed_at"),
        F.lit(by).alias("performed_by"),
    )
    lost = plan_.join(memories.select("id"), "id", "left_anti").select(F.lit("error").alias("action"))
    counts = known.select("action").unionByName(lost).groupBy("action").agg(F.count("*").alias("steps"))
    return out, told, audit, counts


def prune(vectors: DataFrame, plan_: DataFrame) -> DataFrame:
    """Vectors without those of rows that the plan takes out of the index."""
    return vectors.join(plan_.where("action <> 'keep'").select("id"), "id", "left_anti")
