"""Prompts for a text generator, and the parts of its replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording of the prompts.
JUDGE = (
    "Rate the relevance of this memory to the query on a scale of 0.0 to 1.0.\n\nQuery: {query}\n\nMemory:\n- Context: {context}\n- Action: {action}\n- Result: {result}\n\n"
    'Respond with ONLY a JSON object: {"score": <float>, "reason": "<string>"}'
)
MERGE = (
    "Compare these two memories and decide: MERGE or KEEP_BOTH.\n\nMemory A (id={a_id}):\n  context: {a_context}\n  action: {a_action}\n  result: {a_result}\n\n"
    "Memory B (id={b_id}):\n  context: {b_context}\n  action: {b_action}\n  result: {b_result}\n\nRespond with exactly one word: MERGE or KEEP_BOTH"
)
HYPOTHESIS = "Given this short query, generate a detailed hypothetical document that would be a perfect search result. Query: {query}"
TRAINING = "Context: {context}\nAction: {action}\n{result}"


def fill(template: str, **values: Column) -> Column:
    """``template`` with {name} replaced by the values; nulls count as empty, and braces within values stay as they are."""
    parts, rest = [], template
    while rest:
        at, name = min(((rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest), default=(-1, ""))
        if at < 0:
            break
        parts += [F.lit(rest[:at]), F.coalesce(values[name], F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts, F.lit(rest))


def judge_prompt(query: Column, context: Column, action: Column, result: Column) -> Column:
    return fill(JUDGE, query=query, context=context, action=action, result=result)


def merge_prompt(a: Column, b: Column) -> Column:
    """For two struct columns (id, context, action, result)."""
    return fill(MERGE, **{f"{n}_{f}": c[f] for n, c in (("a", a), ("b", b)) for f in ("id", "context", "action", "result")})


def hypothesis_prompt(query: Column) -> Column:
    return fill(HYPOTHESIS, query=query)


def training_text(context: Column, action: Column, result: Column) -> Column:
    """A memory as a text to train a language model on."""
    return fill(TRAINING, context=context, action=action, result=result)


def judge_reply(reply: Column) -> Column:
    """(score, reason) of a JSON reply {score, reason}: the score clamped to [0, 1], a missing reason empty; null if there is no score."""
    r = F.from_json(reply, "score double, reason string", {"mode": "PERMISSIVE"})
    score = F.greatest(F.least(r["score"], F.lit(1.0)), F.lit(0.0))
    return F.when(r["score"].isNotNull(), F.struct(score.alias("score"), F.coalesce(r["reason"], F.lit("")).alias("reason")))
