"""Embedding of rows and the write path: store with deduplication, re-embedding, the model guard, status."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlens.functions.prompts import hypothesis_prompt
from memlens.functions.text import normalize_tags, strip_thinking, word_count
from memlens.functions.vectors import vector_to_blob
from memlens.operators import ranking, store
from memlens.runtime import cut, drop_table
from memlens.schemas import MEMORY

FIELDS = ("context", "action", "result")
DEDUP = 0.95
MODEL_KEY = "embedding_model"


def embed_texts(texts: DataFrame, provider: Callable[[Column], Column]) -> DataFrame:
    """``texts`` (text, ...) with ``vec``; every distinct text is embedded once and joined back. Nulls get null."""
    known = cut(texts.where("text is not null").select("text").distinct().withColumn("vec", provider(F.col("text"))))
    return texts.join(known, "text", "left")


def embed_fields(rows: DataFrame, provider: Callable[[Column], Column]) -> DataFrame:
    """(field, id, vec) of the three fields of each row."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])).alias("c")
    return embed_texts(rows.select("id", cells).select("id", "c.field", "c.text"), provider).select("field", "id", "vec")


def hyde_text(query: Column, hypothesis: Column, threshold: int) -> Column:
    """What to embed for a query: the generated hypothesis if the query has fewer words than ``threshold``, else the query."""
    n = word_count(query)
    return F.when((F.lit(threshold) > 0) & (n > 0) & (n < threshold), F.coalesce(hypothesis, query)).otherwise(query)


def embed_queries(queries: DataFrame, provider: Callable[[Column], Column], generate: Callable[[Column], Column] | None = None, threshold: int = 0) -> DataFrame:
    """``queries`` (query_id, query) with ``vec``; every distinct query is embedded once, and by its hypothesis where it is short.

    What is remembered goes by the query itself, not by the hypothesis. A hypothesis that fails leaves the query as it is.
    """
    known = queries.where("query is not null").select("query").distinct()
    text = F.col("query")
    if generate is not None:
        known = known.withColumn("hypothesis", generate(F.when(hyde_text(text, F.lit("\0"), threshold) == "\0", hypothesis_prompt(text))))
        text = hyde_text(text, strip_thinking(F.col("hypothesis")), threshold)
    known = cut(known.select("query", text.alias("text")).select("query", provider(F.col("text")).alias("vec")))
    return queries.join(known, "query", "left")


def first_wins(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(n, into): ``into`` is null where the row stays, else the smallest kept earlier row it is near to.

    ``edges`` (n, near) lead to earlier rows. A row falls to any kept row before it; in each round the rows all of whose
    earlier neighbours are settled, or one of whose is kept, are decided, as one by one in order.
    """
    state = cut(rows.select("n").join(edges.select("n").distinct().withColumn("open", F.lit(True)), "n", "left").select("n", F.coalesce("open", F.lit(False)).alias("open"), F.lit(None).cast("long").alias("into")))
    while not state.where("open").isEmpty():
        near = state.select(F.col("n").alias("near"), "open", (~F.col("open") & F.col("into").isNull()).alias("kept"))
        told = edges.join(state.where("open").select("n"), "n").join(near, "near").groupBy("n").agg(
            F.max("open").alias("waits"), F.min(F.when(F.col("kept"), F.col("near"))).alias("to"), F.min(F.when(F.col("open"), F.col("near"))).alias("unsure")
        )
        # a kept neighbour settles the case; which one it falls to is known once no smaller one is open
        known = told.where("(to is not null and (unsure is null or unsure > to)) or not waits")
        new = cut(state.join(known.select("n", "to", F.lit(True).alias("now")), "n", "left").select("n", (F.col("open") & F.col("now").isNull()).alias("open"), F.coalesce("into", "to").alias("into")))
        drop_table(state)
        state = new
    return state.select("n", "into")


#: Rows that are decided at once.
LEAD_ROWS = 1 << 13


def _units(pdf: pd.DataFrame) -> dict[tuple[int, ...], tuple[np.ndarray, list[np.ndarray]]]:
    """(n, unit rows of each field) of the rows by the widths of their vectors; rows with a null or empty vector are near to none."""
    pdf = pdf.dropna()
    width = pd.Series(list(zip(*[pdf[f].map(len) for f in FIELDS])), pdf.index, dtype=object)
    return {key: (own["n"].to_numpy(), [ranking._unit(np.array(own[f].tolist(), np.float64)) for f in FIELDS]) for key, own in pdf.groupby(width) if all(key)}


def _first_near(mine: list[np.ndarray], lead: list[np.ndarray], threshold: float) -> np.ndarray:
    """Number of the first row of ``lead`` that is above ``threshold`` in all fields for each row of ``mine``, -1 without one."""
    out = np.full(len(mine[0]), -1)
    step = max(1, ranking.NEAR_CELLS // max(1, len(lead[0])))
    for i in range(0, len(out) if len(lead[0]) else 0, step):
        s = np.minimum.reduce([a[i : i + step] @ b.T for a, b in zip(mine, lead)])
        near = s > threshold
        r, c = np.nonzero(np.abs(s - threshold) < ranking.SCREEN)
        near[r, c] = np.minimum.reduce([(a[i + r] * b[c]).sum(1) for a, b in zip(mine, lead)]) > threshold
        out[i : i + step] = np.where(near.any(1), near.argmax(1), -1)
    return out


def _leaders(n: np.ndarray, x: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that stay, and for each row the place of the row it falls to (-1: stays), one by one in the order of ``n``."""
    into, kept = np.full(len(n), -1), np.zeros(0, np.int64)
    for i in range(0, len(n), 256):
        block = [a[i : i + 256] for a in x]
        at = _first_near(block, [a[kept] for a in x], threshold)
        into[i : i + 256] = np.where(at >= 0, kept[at] if len(kept) else -1, -1)
        new: list[int] = []
        for j in np.flatnonzero(at < 0):
            hit = _first_near([a[j : j + 1] for a in block], [a[new] for a in block], threshold)[0] if new else -1
            if hit < 0:
                new.append(j)
            else:
                into[i + j] = i + new[hit]
        kept = np.concatenate([kept, np.array(new, np.int64) + i])
    return kept, into


def within_batch(rows: DataFrame, threshold: float) -> DataFrame:
    """(n, into) as :func:`first_wins` for ``rows`` (n, the three vectors): all earlier near rows count.

    The first open rows are decided one by one, those that stay are broadcast, and what is near to one of them falls to the first such
    row, so pairs are never written: most rows of a batch may be near to most others. The rest goes on, in order.
    """
    spark = rows.sparkSession
    open_, made = cut(rows.select("n", *FIELDS)), []
    while not open_.isEmpty():
        head = open_.orderBy("n").limit(LEAD_ROWS).toPandas()
        last = int(head["n"].max())
        leads, told = {}, dict.fromkeys(head["n"].tolist())
        for key, (n, x) in _units(head).items():
            kept, into = _leaders(n, x, threshold)
            leads[key] = (n[kept], [a[kept] for a in x])
            told |= {int(n[i]): int(n[into[i]]) for i in np.flatnonzero(into >= 0)}
        made.append(spark.createDataFrame([(int(n), to) for n, to in told.items()], "n long, into long"))
        shared = spark.sparkContext.broadcast(leads)

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                pdf = pdf.reset_index(drop=True)
                to = pd.Series(pd.NA, pdf["n"].to_numpy(), dtype="Int64")
                for key, (n, x) in _units(pdf).items():
                    if key in shared.value:
                        names, lead = shared.value[key]
                        at = _first_near(x, lead, threshold)
                        to.loc[n[at >= 0]] = names[at[at >= 0]]
                yield pdf.assign(into=to.to_numpy())

        schema = open_.select("n", *FIELDS).withColumn("into", F.lit(None).cast("long")).schema
        done = cut(open_.where(F.col("n") > last).mapInPandas(run, schema))
        made.append(cut(done.where("into is not null").select("n", "into")))
        before, open_ = open_, cut(done.where("into is null").drop("into"))
        drop_table(before)
        drop_table(done)
    if not made:
        return rows.select("n", F.lit(None).cast("long").alias("into"))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return cut(out)


def store_batch(
    memories: DataFrame, vectors: DataFrame, batch: DataFrame, provider: Callable[[Column], Column], at: str, threshold: float = DEDUP
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Store ``batch`` (n, id, memory_type, context, action, result[, tags, project, parent_id]) in the order of n.

    A row whose three vectors are all nearer than ``threshold`` to those of one searchable row, stored or earlier in the batch, only
    touches that row: the nearest of all stored rows, else the first of the batch. Returns the new snapshot, the new vectors (field, id,
    vec) and (n, id, merged_into). Fields over 10,000 bytes are refused.
    """
    if (bad := store.violations(batch.select("id", "memory_type", *FIELDS, F.lit(None).cast("string").alias("insight_type"))).first()) is not None:
        raise ValueError(f"{bad['id']}: {bad['problem']}")
    fresh = cut(embed_fields(batch, provider))
    number = batch.select("id", "n")
    by_id = lambda v: cut(v.groupBy("id").pivot("field", list(FIELDS)).agg(F.first("vec")))
    wide, known = by_id(fresh), by_id(vectors)
    best = ranking.best_in_all(known, wide.join(number, "id").select(F.col("n").alias("query_id"), *FIELDS), FIELDS, threshold)
    hits = cut(best.select(F.col("query_id").cast("long").alias("n"), F.col("id").alias("hit")))
    rest = cut(number.join(hits.select("n"), "n", "left_anti"))
    into = within_batch(cut(wide.join(rest, "id").select("n", *FIELDS)), threshold)
    inside = rest.join(into, "n").join(rest.select(F.col("n").alias("into"), F.col("id").alias("mate")), "into", "left")
    outcome = cut(hits.join(number, "n").select("n", "id", F.col("hit").alias("merged_into")).unionByName(inside.select("n", "id", F.col("mate").alias("merged_into"))))
    kept = outcome.where("merged_into is null").select("id")
    blobs = wide.select("id", *[vector_to_blob(f).alias(f"embedding_{f}") for f in FIELDS])
    given = {"score": F.lit(0.0), "indexed": F.lit(True), "created_at": F.lit(at), "updated_at": F.lit(at), "used_count": F.lit(0)}
    have = set(batch.columns) | {f"embedding_{f}" for f in FIELDS}
    full = batch.join(kept, "id", "left_semi").join(blobs, "id")
    value = lambda c: normalize_tags(F.col(c)) if c == "tags" and c in have else given.get(c, F.col(c) if c in have else F.lit(None))
    rows = full.select(*[value(f.name).cast(f.dataType).alias(f.name) for f in MEMORY])
    touches = outcome.where("merged_into is not null").select(F.col("merged_into").alias("id"), F.lit(at).alias("at"))
    return store.touch(store.insert(memories, rows), touches), fresh.join(kept, "id", "left_semi"), outcome


def reembed(memories: DataFrame, provider: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """The snapshot with new vectors of active rows, and (embedded, failed). Rows with a field that could not be embedded leave the index."""
    done = embed_fields(store.active(memories), provider).groupBy("id").pivot("field", list(FIELDS)).agg(F.first("vec"))
    whole = F.col("context").isNotNull() & F.col("action").isNotNull() & F.col("result").isNotNull()
    done = cut(done.select("id", whole.alias("indexed"), *[F.when(whole, vector_to_blob(f)).alias(f"embedding_{f}") for f in FIELDS]))
    failed = done.where("not indexed").select("id", "indexed")
    out = store.set_fields(memories, done.where("indexed"), strict=False)
    stats = done.agg(F.count_if("indexed").alias("embedded"), F.count_if(~F.col("indexed")).alias("failed"))
    return store.set_fields(out, failed, strict=False), stats


def guard_model(meta: DataFrame, model: str) -> DataFrame:
    """The metadata with the model recorded if none was; another model than the recorded one is refused."""
    known = meta.where(F.col("key") == MODEL_KEY).first()
    if known is None:
        return store.upsert_meta(meta, meta.sparkSession.createDataFrame([(MODEL_KEY, model)], "key string, value string"))
    if known["value"] != model:
        raise ValueError(f"vectors are of model {known['value']}, not {model}")
    return meta


def status(memories: DataFrame, feedback: DataFrame, few: int = 20, many_pending: int = 10) -> DataFrame:
    """One row: memories, indexed, pending, and hints for what to do next."""
    pending = feedback.groupBy("memory_id").agg(F.max(F.coalesce("judged", F.lit(False))).alias("j")).agg(F.count_if(~F.col("j")).alias("pending"))
    counts = memories.agg(F.count("*").alias("memories"), F.count_if("indexed").alias("indexed")).crossJoin(F.broadcast(pending))
    hints = F.array_compact(F.array(F.when(F.col("memories") >= few, F.lit("train")), F.when(F.col("pending") > many_pending, F.lit("judge")), F.when(F.col("indexed") < F.col("memories"), F.lit("reindex"))))
    return counts.withColumn("hints", hints)


def routing_rows(decisions: DataFrame, rewards: DataFrame, at: str) -> DataFrame:
    """Rows for the routing log: decisions with their shadow rewards (query_id, shadow_rewards)."""
    columns = ["query_id", "mode", "search_strategy", "llm_selection", "contextualization", "proactivity", "top_k"]
    return decisions.select(*columns).join(rewards, "query_id", "left").withColumn("created_at", F.lit(at))


def saved_search(found: DataFrame, query: str) -> DataFrame:
    """(context, action, result) of a memory that remembers a search (place, context)."""
    top = F.coalesce(F.min_by("context", "place"), F.lit("none"))
    return found.agg(F.lit(f"Searched for: {query}").alias("context"), F.format_string("Found %d results", F.count("*")).alias("action"), F.concat(F.lit("Top result: "), top).alias("result"))
