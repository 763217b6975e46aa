"""Query modes, the contextual bandit over four levels, and relevance scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlens.functions.text import judge_tokens
from memlens.functions.timeutil import strict_instant
from memlens.runtime import cut, small

# Keywords of each mode, in order of priority.
MODE_WORDS = {
    "debug": ("bug", "error", "stack", "trace", "crash", "fix", "issue", "debug", "exception", "panic"),
    "plan": ("plan", "estimate", "risk", "assess", "schedule", "timeline", "scope", "roadmap"),
    "architecture": ("design", "choose", "structure", "technology", "framework", "library", "pattern", "architect", "component"),
    "review": ("review", "refactor", "improve", "clean", "lint", "optimize", "quality"),
    "coding": ("implement", "code", "function", "method", "class", "feature", "module", "write", "create", "add"),
    "routine": ("update", "version", "config", "dependency", "setup", "init", "bump"),
}
# Mode, search strategy, model, contextualization, proactivity, type priority, similarity threshold, least and most hits.
MODE_DEFAULTS = (
    ("debug", "high_threshold", "cheap", "raw", "passive", ["bugfix", "pattern", "context"], 0.8, 3, 5),
    ("architecture", "low_threshold", "expensive", "summarize", "proactive", ["decision", "context", "pattern"], 0.5, 5, 10),
    ("coding", "medium_threshold", "cheap", "raw", "passive", ["pattern", "context", "bugfix"], 0.7, 3, 5),
    ("review", "medium_threshold", "expensive", "raw", "passive", ["pattern", "decision", "bugfix"], 0.7, 5, 7),
    ("plan", "low_threshold", "expensive", "summarize", "proactive", ["decision", "bugfix", "context", "pattern"], 0.5, 7, 10),
    ("routine", "high_threshold", "cheap", "raw", "passive", ["context"], 0.8, 1, 3),
)
# Levels of a decision and their actions; on equal values the first wins.
ACTIONS = {
    "search": ("high_threshold", "medium_threshold", "low_threshold"),
    "llm": ("cheap", "balanced", "expensive"),
    "context": ("raw", "summarize"),
    "proactivity": ("passive", "proactive"),
}
LEVEL_COLUMNS = {"search": "search_strategy", "llm": "llm_selection", "context": "contextualization", "proactivity": "proactivity"}
ALPHA, EPSILON, MOST_KEYS = 0.1, 0.15, 100_000
#: What a Q value belongs to, and ranges of ``seq`` that a key's events are numbered in.
KEY, RANGES = ["router_level", "state", "action"], 64


def detect_mode(text: Column) -> Column:
    """First mode in priority order one of whose keywords is a whole word of the text; routine otherwise."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")
    out = F.lit("routine")
    for mode in reversed(MODE_WORDS):
        out = F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in MODE_WORDS[mode]])), mode).otherwise(out)
    return out


def parse_mode(text: Column) -> Column:
    """Canonical mode name in any case; null if unknown."""
    lower = F.lower(F.trim(text))
    return F.when(lower.isin(*MODE_WORDS), lower)


def mode_defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(MODE_DEFAULTS),
        "mode string, search_strategy string, llm_selection string, contextualization string, proactivity string, "
        "memory_type_priority array<string>, similarity_threshold double, top_k_min int, top_k_max int",
    )


def action_table(spark: SparkSession) -> DataFrame:
    rows = [(level, a, i) for level, actions in ACTIONS.items() for i, a in enumerate(actions)]
    return spark.createDataFrame(rows, "router_level string, action string, ordinal int")


def fold_rewards(events: DataFrame, alpha: float = ALPHA, start: DataFrame | None = None, most: int = MOST_KEYS) -> DataFrame:
    """(router_level, state, action, value, update_count) after q <- q + alpha (reward - q) over each key's events by ``seq``.

    The fold has a closed form: event i of n adds alpha (1 - alpha)^(n - i) times its reward, so it is a sum that combines map-side. A key's
    events are numbered within ranges of ``seq``, and ranges carry over their counts, so a hot key is sorted by many tasks.
    Null rewards don't count. ``start`` gives earlier values and counts; once it holds ``most`` keys no new ones are
    taken, those that appear first come first, and known ones still change.
    """
    own = events.where("reward is not null")
    span = own.groupBy(*KEY).agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    if start is not None:
        span = span.join(start.select(*KEY, F.lit(True).alias("known")), KEY, "left").withColumn("known", F.coalesce("known", F.lit(False)))
        room = most - start.count()
    else:
        span, room = span.withColumn("known", F.lit(False)), most
    span = cut(span)
    new = span.where("not known").orderBy("lo", *KEY).limit(max(0, room))
    span = cut(span.where("known").unionByName(new))
    place = F.floor((F.col("seq") - F.col("lo")) * (RANGES - 1) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))).cast("int")
    ranged = own.join(small(span), KEY).select(*KEY, "seq", "reward", place.alias("range"))
    later = ranged.groupBy(*KEY, "range").agg(F.count("*").alias("n"))
    later = later.withColumn("after", F.coalesce(F.sum("n").over(Window.partitionBy(*KEY).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = ranged.withColumn("r", F.row_number().over(Window.partitionBy(*KEY, "range").orderBy(F.desc("seq"))))
    back = inside.join(small(later.select(*KEY, "range", "after")), [*KEY, "range"]).withColumn("back", F.col("r") - 1 + F.col("after"))
    folded = back.groupBy(*KEY).agg(
        F.sum(F.lit(alpha) * F.pow(F.lit(1 - alpha), F.col("back").cast("double")) * F.col("reward")).alias("value"), F.count("*").alias("update_count")
    )
    if start is None:
        return folded
    old = start.select(*KEY, F.col("value").alias("v0"), F.col("update_count").alias("c0"))
    both = folded.join(old, KEY, "full")
    n = F.coalesce("update_count", F.lit(0))
    value = F.coalesce("value", F.lit(0.0)) + F.coalesce("v0", F.lit(0.0)) * F.pow(F.lit(1 - alpha), n.cast("double"))
    return both.select(*KEY, value.alias("value"), (n + F.coalesce("c0", F.lit(0))).alias("update_count"))


def actions_for_state(q_table: DataFrame, state: str) -> DataFrame:
    """(router_level, action, value, update_count) known of a state, ordered."""
    return q_table.where(F.col("state") == state).select("router_level", "action", "value", "update_count").orderBy("router_level", "action")


def q_rows(q_table: DataFrame) -> DataFrame:
    """The table ordered by level, state and action."""
    return q_table.orderBy(*KEY)


def spread_rewards(rewards: DataFrame) -> DataFrame:
    """A reward of a decision row as one event for each of its four levels."""
    levels = F.array(*[F.struct(F.lit(level).alias("router_level"), F.col(c).alias("action")) for level, c in LEVEL_COLUMNS.items()])
    return rewards.select(F.explode(levels).alias("l"), F.col("mode").alias("state"), "reward", "seq").select("l.router_level", "state", "l.action", "reward", "seq")


def best_actions(q_table: DataFrame) -> DataFrame:
    """(router_level, state, action, value): highest value among tried actions; ties to the first in order."""
    ranked = q_table.where("update_count > 0").join(F.broadcast(action_table(q_table.sparkSession)), ["router_level", "action"])
    w = Window.partitionBy("router_level", "state").orderBy(F.desc("value"), "ordinal")
    return ranked.withColumn("r", F.row_number().over(w)).where("r = 1").select("router_level", "state", "action", "value")


def decide(queries: DataFrame, q_table: DataFrame, rng: float = 0.5, epsilon: float = EPSILON) -> DataFrame:
    """Decisions for (query_id, mode[, top_k]): the learnt action of each level, else the mode's default.

    With ``rng`` under ``epsilon`` the action is explored: number floor(rng / epsilon * n) of its level.
    An explicit top_k wins over the mode's least number of hits.
    """
    out = queries.join(F.broadcast(mode_defaults(queries.sparkSession)), "mode")
    best = best_actions(q_table)
    for level, column in LEVEL_COLUMNS.items():
        if rng < epsilon:
            actions = ACTIONS[level]
            out = out.withColumn(column, F.lit(actions[min(int(rng / epsilon * len(actions)), len(actions) - 1)]))
        else:
            own = best.where(F.col("router_level") == level).select(F.col("state").alias("mode"), F.col("action").alias("_a"))
            out = out.join(own, "mode", "left").withColumn(column, F.coalesce("_a", column)).drop("_a")
    limit = F.coalesce("top_k", "top_k_min") if "top_k" in queries.columns else F.col("top_k_min")
    return out.select("query_id", "mode", *LEVEL_COLUMNS.values(), limit.alias("top_k"), "similarity_threshold", "memory_type_priority")


def q_panel(q_table: DataFrame) -> DataFrame:
    """Values of each level and state with an action a column, 0 where there is none, and the updates of the level."""
    names = [a for actions in ACTIONS.values() for a in actions]
    wide = q_table.groupBy("router_level", "state").pivot("action", names).agg(F.first("value"))
    totals = q_table.groupBy("router_level").agg(F.sum("update_count").alias("updates"))
    return wide.na.fill(0.0, names).join(totals, "router_level")


# -- relevance

W_KEYWORD, W_RECENCY, W_FREQUENCY, DECAY_DAYS, SATURATION = 0.4, 0.3, 0.3, 30.0, 10.0


def days_since(at: Column, now: Column) -> Column:
    """Days from a canonical time to ``now`` in whole seconds, never negative; 0 if unreadable."""
    seconds = F.greatest(F.unix_seconds(now) - F.unix_seconds(strict_instant(at)), F.lit(0))
    return F.coalesce(seconds / 86400.0, F.lit(0.0))


def judge(query: Column, text: Column, days: Column, used: Column) -> tuple[Column, Column]:
    """Heuristic relevance in [0, 1] and its reason text: shared words, recency and use."""
    words, stored = judge_tokens(query), judge_tokens(text)
    hits = F.size(F.filter(words, lambda w: F.array_contains(stored, w)))
    keyword = F.when(F.size(words) == 0, 0.0).otherwise(hits / F.size(words))
    recency = F.exp(-days / DECAY_DAYS)
    frequency = F.least(F.coalesce(used, F.lit(0)) / SATURATION, F.lit(1.0))
    score = keyword * W_KEYWORD + recency * W_RECENCY + frequency * W_FREQUENCY
    reason = F.format_string("keyword:%.2f recency:%.2f frequency:%.2f", keyword, recency, frequency)
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), reason


def combined(model: Column, heuristic: Column) -> tuple[Column, Column]:
    """The model's score where it has one, else the heuristic's, and whether that was needed."""
    return F.coalesce(model, heuristic), model.isNull()
