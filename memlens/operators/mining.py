"""Insights: recurrence, chains, clusters, metrics and models."""

from __future__ import annotations

from itertools import takewhile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlens.functions.prompts import training_text
from memlens.functions.timeutil import days_between, hours_between, instant
from memlens.functions.vectors import blob_to_vector, cosine
from memlens.operators.consolidation import components
from memlens.operators.ranking import _unit
from memlens.operators.store import training_rows
from memlens.runtime import cut, drop_table, small

# Windows and thresholds of the insights; their wording stands with the builders below.
WINDOW_HOURS, LEAST_RECURRING = 168, 3
CHAIN_HOURS, CHAIN_SIMILARITY, CLUSTER_SIMILARITY = 6, 0.7, 0.85


def recurrence(memories: DataFrame, window_hours: int = WINDOW_HOURS, least: int = LEAST_RECURRING) -> DataFrame:
    """(memory_type, occurrences, interval_hours): types with ``least`` rows in the window before their latest row.

    The mean gap telescopes to (last - first) / (n - 1), so no ids are gathered.
    """
    rows = training_rows(memories).select("memory_type", instant(F.col("created_at")).alias("ts")).where("ts is not null")
    latest = rows.groupBy("memory_type").agg(F.max("ts").alias("latest"), F.count("*").alias("all"))
    inside = rows.join(small(latest), "memory_type").where(hours_between(F.col("ts"), F.col("latest")) <= window_hours)
    found = inside.groupBy("memory_type").agg(F.count("*").alias("occurrences"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return found.where(F.col("occurrences") >= least).select(
        "memory_type", "occurrences", (hours_between(F.col("a"), F.col("b")) / (F.col("occurrences") - 1)).alias("interval_hours")
    )


def explicit_chains(memories: DataFrame) -> DataFrame:
    """(root_id, place, id): from each parentless row with children along its first child (earliest, then smallest id), and so on.

    Steps double: after round r every link knows the row 2^r links on.
    """
    rows = training_rows(memories).select("id", "parent_id", "created_at")
    first = rows.where("parent_id is not null").groupBy("parent_id").agg(F.min(F.struct("created_at", "id"))["id"].alias("next"))
    roots = rows.where("parent_id is null").select("id").join(first.select(F.col("parent_id").alias("id")), "id", "left_semi")
    # follow the chosen child; a link is a row's next, and walks backwards from ends are trees, so roots resolve by doubling
    steps = cut(first.join(rows.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select(F.col("parent_id").alias("id"), "next"))
    parts = [cut(roots.select(F.col("id").alias("root_id"), F.lit(0).cast("long").alias("place"), "id"))]
    reach, jump = 1, steps
    while True:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        more = cut(out.join(jump, "id").select("root_id", (F.col("place") + reach).alias("place"), F.col("next").alias("id")))
        if more.isEmpty():
            return out
        parts.append(more)
        jump = cut(jump.join(jump.select(F.col("id").alias("next"), F.col("next").alias("far")), "next").select("id", F.col("far").alias("next")))
        reach *= 2


def implicit_edges(memories: DataFrame, hours: int = CHAIN_HOURS, least: float = CHAIN_SIMILARITY) -> DataFrame:
    """(a, b, gap_hours, similarity, ta): later row b within ``hours`` of a and of cosine ``least``.

    Rows are dealt in order of time into blocks of at most TIME_BLOCK rows, and only pairs of blocks that lie within ``hours`` of each other are
    compared, each in a task of its own: every pair within the window is screened by a product of the blocks and decided in double precision.
    """
    rows = training_rows(memories).select("id", instant(F.col("created_at")).alias("ts"), F.col("embedding_context").alias("vec"))
    rows = cut(rows.where("ts is not null and octet_length(vec) > 0 and octet_length(vec) % 4 = 0").withColumn("us", F.unix_micros("ts")))
    total = rows.count()
    blocks = max(1, min(-(-total // TIME_BLOCK_LEAST), TIME_BLOCKS), -(-total // TIME_BLOCK))
    dealt = cut(rows.repartitionByRange(blocks, "us", "id").withColumn("block", F.spark_partition_id()))
    drop_table(rows)
    bounds = [tuple(r) for r in dealt.groupBy("block").agg(F.min("us"), F.max("us")).orderBy("block").collect()]
    pairs = [(i, j) for n, (i, _, last) in enumerate(bounds) for j in _near_blocks(bounds[n:], last, hours)]
    # a block is the earlier side of its pairs, and the later one of those with an earlier block
    sides = [(i, 0, i, j) for i, j in pairs] + [(j, 1, i, j) for i, j in pairs if i < j]
    placed = dealt.join(F.broadcast(dealt.sparkSession.createDataFrame(sides, "block int, side int, i int, j int")), "block").drop("block", "ts")
    found = placed.groupBy("i", "j").applyInPandas(lambda pdf: _edges_of_block(pdf, hours, least), "a string, b string, gap_hours double, similarity double, ta bigint")
    return found.withColumn("ta", F.timestamp_micros("ta"))


#: Rows of a time block at most and, where there would be fewer than TIME_BLOCKS blocks, at least.
TIME_BLOCK, TIME_BLOCK_LEAST, TIME_BLOCKS = 1 << 15, 1 << 10, 24
#: Cells of similarities that a task holds at once, pairs decided at once, slack of single precision.
EDGE_CELLS, EDGE_STEP, EDGE_SCREEN = 1 << 20, 1 << 15, 1e-5


def _near_blocks(bounds: list[tuple[int, int, int]], last: int, hours: float) -> list[int]:
    """The blocks of ``bounds`` (block, first, last), in order of time, that begin within ``hours`` after ``last``."""
    return [j for j, first, _ in takewhile(lambda b: (b[1] - last) / 3.6e9 <= hours, bounds)]


def _edges_of_block(pdf: pd.DataFrame, hours: float, least: float) -> pd.DataFrame:
    """Edges from rows of side 0 to those of side 1, or among the rows of side 0 where there are no others; vectors of other widths don't meet."""
    out = []
    across = bool((pdf["side"] == 1).any())
    for _, own in pdf.sort_values("us", kind="stable").groupby(pdf["vec"].map(len)):
        x = _unit(np.frombuffer(b"".join(own["vec"]), "<f4").reshape(len(own), -1).astype(np.float64))
        us, ids, side = own["us"].to_numpy(), own["id"].to_numpy(), own["side"].to_numpy()
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if across else left
        if not len(left) or not len(right):
            continue
        fast = x.astype(np.float32)
        lead, later = fast[left], us[right]
        other = fast[right]
        step = max(16, min(1024, EDGE_CELLS // len(right)))
        for k in range(0, len(left), step):
            mine = left[k : k + step]
            lo = int(np.searchsorted(later, us[mine[0]]))
            hi = int(np.searchsorted(later, us[mine[-1]] + hours * 3.6e9 + 1, side="right"))
            if hi <= lo:
                continue
            r, c = np.nonzero(lead[k : k + step] @ other[lo:hi].T >= least - EDGE_SCREEN)
            r, c = mine[r], right[lo + c]
            gap = (us[c] - us[r]) / 3.6e9
            ok = (gap >= 0) & (gap <= hours) & (r != c)
            r, c, gap = r[ok], c[ok], gap[ok]
            tie = np.flatnonzero(gap == 0)
            ok = np.ones(len(r), bool)
            ok[tie] = [a is not None and b is not None and b > a for a, b in zip(ids[r[tie]], ids[c[tie]])]
            r, c, gap = r[ok], c[ok], gap[ok]
            sim = np.concatenate([(x[r[n : n + EDGE_STEP]] * x[c[n : n + EDGE_STEP]]).sum(1) for n in range(0, len(r), EDGE_STEP)] or [np.zeros(0)])
            ok = sim >= least
            out.append(pd.DataFrame({"a": ids[r[ok]], "b": ids[c[ok]], "gap_hours": gap[ok], "similarity": sim[ok], "ta": us[r[ok]]}))
    empty = {"a": pd.Series(dtype=object), "b": pd.Series(dtype=object), "gap_hours": pd.Series(dtype=float), "similarity": pd.Series(dtype=float), "ta": pd.Series(dtype="int64")}
    return pd.concat(out) if out else pd.DataFrame(empty)


def implicit_chains(memories: DataFrame, hours: int = CHAIN_HOURS, least: float = CHAIN_SIMILARITY, told: DataFrame | None = None) -> DataFrame:
    """(root_id, place, id): rows outside explicit chains grown greedily in time from edges; a row is in one chain.

    Chains never cross components of the edges, and components run in parallel. The explicit chains may be given as ``told``.
    """
    taken = (explicit_chains(memories) if told is None else told).select("id").distinct()
    rows = memories.join(taken, "id", "left_anti")
    edges = cut(implicit_edges(rows, hours, least))
    comp = components(edges.select("a", "b"))
    at = edges.join(comp.withColumnRenamed("id", "a"), "a")
    times = rows.select(F.col("id").alias("b"), instant(F.col("created_at")).alias("tb"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        when = dict(zip(pdf["a"], pdf["ta"])) | dict(zip(pdf["b"], pdf["tb"]))
        names = sorted(when, key=lambda i: (when[i], i))
        number = {i: n for n, i in enumerate(names)}  # in order of time
        a, b = pdf["a"].map(number).to_numpy(np.int64), pdf["b"].map(number).to_numpy(np.int64)
        by = np.lexsort((b, a))
        begin, after = np.searchsorted(a[by], np.arange(len(names) + 1)).tolist(), b[by].tolist()
        used, out = bytearray(len(names)), []
        for start in range(len(names)):
            if used[start]:
                continue
            chain = [start]
            while (step := next((x for x in after[begin[chain[-1]] : begin[chain[-1] + 1]] if not used[x]), None)) is not None:
                chain.append(step)
            if len(chain) > 1:
                for x in chain:
                    used[x] = 1
                out += [(names[start], p, names[x]) for p, x in enumerate(chain)]
        return pd.DataFrame(out, columns=["root_id", "place", "id"])

    return at.join(times, "b").groupBy("component").applyInPandas(grow, "root_id string, place bigint, id string")


def chains(memories: DataFrame, hours: int = CHAIN_HOURS, least: float = CHAIN_SIMILARITY) -> DataFrame:
    """(kind, root_id, place, id): the explicit chains and, of the rows in none of them, the implicit ones."""
    own = cut(explicit_chains(memories))
    told = own.select(F.lit("explicit").alias("kind"), "root_id", "place", "id")
    return told.unionByName(implicit_chains(memories, hours, least, own).select(F.lit("implicit").alias("kind"), "root_id", "place", "id"))


def average_linkage(vectors: np.ndarray, limit: float, copies: np.ndarray | None = None) -> np.ndarray:
    """Labels of average-linkage clusters by cosine distance, merged while the least distance is under ``limit``.

    A vector may stand for several ``copies``.
    """
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    x = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    d = np.clip(1 - x @ x.T, 0, None)
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(len(x)) if copies is None else copies.astype(float), np.arange(len(x)), np.ones(len(x), bool)
    while alive.sum() > 1:
        i, j = divmod(int(d.argmin()), len(x))
        if d[i, j] >= limit:
            break
        i, j = min(i, j), max(i, j)
        joined = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = joined, joined
        d[i, i], d[j], d[:, j] = np.inf, np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return label


def average_linkage_clusters(memories: DataFrame, pairs: DataFrame, least: float = CLUSTER_SIMILARITY) -> DataFrame:
    """(cluster_id, id): average-linkage clusters of at least two rows within the components of ``pairs`` (a, b).

    A merge under the limit needs a pair under it, so clusters never cross components; give the pairs of at least ``least``
    cosine. The smallest id names a cluster.
    """
    comp = components(pairs)
    rows = memories.select("id", blob_to_vector("embedding_context").alias("vec")).join(comp, "id")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, ids = np.array(pdf["vec"].tolist(), np.float64), pdf["id"].to_numpy()
        of, _ = pd.factorize(np.array([v.tobytes() for v in x], object))  # equal vectors are merged before all others
        _, first, copies = np.unique(of, return_index=True, return_counts=True)
        label = average_linkage(x[first], 1 - least, copies)
        out = pd.DataFrame({"cluster_id": ids[first[label[of]]], "id": ids})
        return out[out.groupby("cluster_id")["id"].transform("size") > 1]

    return rows.groupBy("component").applyInPandas(link, "cluster_id string, id string")


# -- insight texts (fixed values: the wording)

def _insight(kind: str, context: Column, action: Column, result: Column, sources: Column) -> list[Column]:
    id_ = F.sha2(F.concat_ws("|", F.lit(kind), context, action, result, F.concat_ws(",", sources)), 256)
    fields = {"id": id_, "context": context, "action": action, "result": result, "insight_type": F.lit(kind), "source_ids": F.concat_ws(",", sources)}
    return [*[c.alias(n) for n, c in fields.items()], F.lit(None).cast("string").alias("tags")]


def temporal_insights(found: DataFrame) -> DataFrame:
    kind = F.col("memory_type")
    return found.select(
        *_insight(
            "temporal",
            F.format_string("Recurring %s pattern detected", kind),
            F.format_string("%d occurrences with ~%.1fh interval", "occurrences", "interval_hours"),
            F.format_string("Temporal pattern in %s memories", kind),
            F.array().cast("array<string>"),
        )
    )


def chain_insights(chains: DataFrame, memories: DataFrame) -> DataFrame:
    """An insight for each chain (root_id, place, id)."""
    whole = chains.groupBy("root_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda s: s["id"]).alias("ids"))
    full = whole.join(memories.select(F.col("id").alias("root_id"), "memory_type"), "root_id")
    ids = F.col("ids")
    return full.select(
        *_insight(
            "causal",
            F.format_string("Causal chain of %d memories", F.size(ids)),
            F.concat(F.lit("Root type: "), "memory_type"),
            F.concat(F.lit("Chain: "), F.array_join(ids, " -> ")),
            ids,
        )
    )


def cluster_insights(found: DataFrame, memories: DataFrame) -> DataFrame:
    """An insight for each cluster (cluster_id, id): the texts of its first row, all members as sources."""
    whole = found.groupBy("cluster_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    full = whole.join(memories.select(F.col("id").alias("cluster_id"), "context", "action", "result"), "cluster_id")
    return full.select(*_insight("cluster", F.col("context"), F.col("action"), F.col("result"), F.col("ids")))


# -- metrics and reports

def metrics(memories: DataFrame, q_table: DataFrame | None = None) -> DataFrame:
    """(name, value): count, mean score, share of each type, and convergence of a non-empty Q table; nothing for no rows."""
    rows = training_rows(memories)
    by = rows.groupBy("memory_type").agg(F.count("*").alias("n"), F.sum(F.col("score").cast("double")).alias("s"))
    total = by.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > 0")
    out = total.select(F.explode(F.array(F.struct(F.lit("memory_count").alias("name"), F.col("n").cast("double").alias("value")), F.struct(F.lit("avg_score").alias("name"), (F.col("s") / F.col("n")).alias("value")))).alias("m")).select("m.*")
    share = by.crossJoin(F.broadcast(total.select(F.col("n").alias("all")))).select(F.concat(F.lit("type_fraction_"), "memory_type").alias("name"), (F.col("n") / F.col("all")).alias("value"))
    out = out.unionByName(share)
    if q_table is not None:
        q = q_table.agg(F.avg("update_count").alias("m")).where("m is not null")
        out = out.unionByName(q.select(F.lit("q_table_convergence").alias("name"), F.least(F.col("m") / 100.0, F.lit(1.0)).alias("value")))
    return out


def low_scores(memories: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(target_id, action, reasoning) for rows under the threshold."""
    own = training_rows(memories).where(F.col("score").cast("double") < threshold)
    return own.select(F.col("id").alias("target_id"), F.lit("archive").alias("action"), F.format_string(f"Score %.2f below threshold {threshold}", F.col("score").cast("double")).alias("reasoning"))


def recency_days() -> Column:
    last = F.coalesce(instant(F.col("last_used_at")), instant(F.col("updated_at")))
    return F.greatest(F.coalesce(days_between(instant(F.col("created_at")), last), F.lit(0.0)), F.lit(0.0))


def ranker_features(memories: DataFrame) -> DataFrame:
    """id and five features: score, uses, recency, text length, has tags."""
    return memories.select(
        "id",
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        F.coalesce(F.col("used_count"), F.lit(0)).cast("double").alias("used_count"),
        recency_days().alias("recency_days"),
        (F.length("context") + F.length("action")).cast("double").alias("text_length"),
        F.when(F.coalesce(F.col("tags"), F.lit("")) != "", 1.0).otherwise(0.0).alias("has_tags"),
    )


def feedback_counts(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.count("*").alias("searched"), F.count_if("judged").alias("judged")).withColumn("pending", F.greatest(F.col("searched") - F.col("judged"), F.lit(0)))


def pending(feedback: DataFrame) -> DataFrame:
    """(memory_id, shown): never judged; one judgement settles all rows of an id."""
    by = feedback.groupBy("memory_id").agg(F.max(F.coalesce("judged", F.lit(False))).alias("j"), F.count("*").alias("shown"))
    return by.where("not j").select("memory_id", "shown")


def routing_outcomes(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """(mode, search_strategy, shown, judged): what became of the hits of each decision."""
    r = log.select("query_id", F.lower(F.trim("mode")).alias("mode"), "search_strategy")
    shown = feedback.where("query_id is not null").groupBy("query_id").agg(F.count("*").alias("s"), F.count_if("judged").alias("j"))
    return r.join(shown, "query_id").groupBy("mode", "search_strategy").agg(F.sum("s").alias("shown"), F.sum("j").alias("judged"))


def score_histogram(memories: DataFrame) -> DataFrame:
    """(bucket, rows) for ten buckets, empty ones too; negatives fall into the first, null and NaN scores into none."""
    score = F.col("score").cast("double")
    b = F.least(F.greatest(F.floor(score * 10), F.lit(0)), F.lit(9)).cast("int")
    have = memories.where(score.isNotNull() & ~F.isnan(score)).groupBy(b.alias("bucket")).count()
    return memories.sparkSession.range(10).select(F.col("id").cast("int").alias("bucket")).join(have, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("rows"))


def bars(counts: DataFrame, count: str = "rows", width: int = 40) -> DataFrame:
    """``counts`` with ``bar``: the length that its share of the largest count has in ``width``, at least 1 for a count that is not 0."""
    most = counts.agg(F.max(count).alias("_most"))
    length = F.floor(F.col(count) * width / F.col("_most")).cast("int")
    return counts.crossJoin(F.broadcast(most)).withColumn("bar", F.when(F.col(count) > 0, F.greatest(length, F.lit(1))).otherwise(0)).drop("_most")


# -- models

def classifier(memories: DataFrame, features: int = 500):
    """Fitted pipeline from context and action to the memory type (TF-IDF and logistic regression), or None under ten rows, two types or without any word."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, RegexTokenizer, StringIndexer

    rows = training_texts(memories)
    if rows.limit(10).count() < 10 or rows.select("memory_type").distinct().limit(2).count() < 2 or rows.where(F.col("text").rlike(r"\w\w")).isEmpty():
        return None
    stages = [
        StringIndexer(inputCol="memory_type", outputCol="label", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\w\w+", gaps=False),
        CountVectorizer(inputCol="words", outputCol="tf", vocabSize=features),
        IDF(inputCol="tf", outputCol="tfidf"),
        Normalizer(inputCol="tfidf", outputCol="features"),
        LogisticRegression(maxIter=200),
    ]
    return Pipeline(stages=stages).fit(rows)


def training_texts(memories: DataFrame) -> DataFrame:
    return training_rows(memories).select("id", F.concat_ws(" ", "context", "action").alias("text"), "memory_type")


def training_lines(memories: DataFrame, above: float = 0.5) -> DataFrame:
    """(id, text): rows of a score above ``above`` as texts for a language model."""
    good = training_rows(memories).where(F.col("score").cast("double") > above)
    return good.select("id", training_text(F.col("context"), F.col("action"), F.col("result")).alias("text"))


def ranker(memories: DataFrame, feedback: DataFrame):
    """Fitted boosted trees from the five features to ever judged, or None under ten rows or for one label."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = labelled(memories, feedback)
    if rows.limit(10).count() < 10 or rows.select("label").distinct().count() < 2:
        return None
    names = [c for c in rows.columns if c not in ("id", "label")]
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), GBTClassifier(maxIter=50, maxDepth=3, stepSize=0.1, seed=1)]).fit(rows)


def labelled(memories: DataFrame, feedback: DataFrame) -> DataFrame:
    judged = feedback.where("judged").select(F.col("memory_id").alias("id")).distinct().withColumn("label", F.lit(1.0))
    return ranker_features(training_rows(memories)).join(judged, "id", "left").withColumn("label", F.coalesce("label", F.lit(0.0)))


def accuracy(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@F.pandas_udf(T.DoubleType())
def rouge_l(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    """F-measure of the longest common subsequence of words; 0 without words."""

    def score(c: str | None, r: str | None) -> float:
        c, r = (c or "").split(), (r or "").split()
        n = lcs(c, r)
        return 2 * n / (len(c) + len(r)) if n else 0.0

    return pd.Series([score(c, r) for c, r in zip(candidate, reference)])


def quality_gate(generated: DataFrame, sample: int = 10, pass_mark: float = 0.1) -> DataFrame:
    """(score, passed) of at most ``sample`` rows (id, generated, reference) drawn by hash; mean rounded to 4 places."""
    drawn = generated.orderBy(F.xxhash64("id"), "id").limit(sample)
    mean = drawn.agg(F.round(F.avg(rouge_l("generated", "reference")), 4).alias("score"))
    return mean.select("score", (F.col("score") > pass_mark).alias("passed"))
