"""Queries of the store's services: judging, groups, messages, migrations, prompts, the write path and listings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlens.functions import prompts
from memlens.functions.text import audit_ids, split_csv
from memlens.functions.timeutil import instant, iso
from memlens.functions.vectors import deterministic_embedding, fnv1a_64, hash_collisions, hash_uniform, resolve_hashes
from memlens.operators import consolidation as con
from memlens.operators import ingest, mining, pipeline, ranking, routing, store
from memlens.operators.hierarchy import descendants, linked, resolve_roots
from memlens.plans.core_problems import ORACLE as CORE_SQL
from memlens.plans.core_problems import ts_sql
from memlens.plans.store_queries import ORACLE as STORE_SQL
from memlens.plans.store_queries import QUERIES as STORE
from memlens.runtime import cut, table
from memlens.sources import portable
from memlens.sources.adapters import NUMBER_SQL, REWARDS_SQL, field_vectors, number, reward_events, searchable

NOW = "2026-01-01T00:00:00Z"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def _m(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "memories")


def _n(column: str = "id"):
    return number(F.col(column))


_NUM = NUMBER_SQL.format("id")
_ACTIVE = "superseded_by IS NULL AND memory_type <> 'insight'"


# -- trees of problem 7 in full

@query("p7_descendants", """WITH RECURSIVE n AS (SELECT id, lower(regexp_replace(id, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS k, lower(regexp_replace(parent_id, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS p FROM memories),
e AS (SELECT a.id, b.id AS up FROM n a JOIN n b ON a.p = b.k),
roots AS (SELECT DISTINCT up AS id FROM e WHERE up NOT IN (SELECT id FROM e)),
walk AS (SELECT id, [id] AS above FROM roots UNION ALL SELECT e.id, list_prepend(e.id, w.above) FROM walk w JOIN e ON e.up = w.id)
SELECT above[i + 1] AS ancestor_id, id, i AS distance FROM (SELECT id, above, unnest(range(1, len(above))) AS i FROM walk)""")
def p7_descendants(s, d):
    return descendants(linked(_m(s, d), "parent_id"))


@query("p7_paths", ORACLE["p7_descendants"].split("SELECT above[i + 1]")[0] + "SELECT e.id, array_to_string(w.above, '>') AS path FROM e LEFT JOIN walk w ON w.id = e.id")
def p7_paths(s, d):
    return resolve_roots(linked(_m(s, d), "parent_id"), with_path=True).select("id", F.array_join("path", ">").alias("path"))


# -- prompts and judging

@query("judge_prompts", f"""SELECT id, 'Rate the relevance of this memory to the query on a scale of 0.0 to 1.0.' || chr(10) || chr(10) || 'Query: ' || coalesce(project, '') || chr(10) || chr(10) || 'Memory:' || chr(10) || '- Context: ' || coalesce(context, '') || chr(10)
    || '- Action: ' || coalesce(action, '') || chr(10) || '- Result: ' || coalesce(result, '') || chr(10) || chr(10) || 'Respond with ONLY a JSON object: {{"score": <float>, "reason": "<string>"}}' AS prompt FROM memories""")
def judge_prompts(s, d):
    return _m(s, d).select("id", prompts.judge_prompt(F.col("project"), F.col("context"), F.col("action"), F.col("result")).alias("prompt"))


_GROUPS = STORE_SQL["survivor_choice"].split(" SELECT primary_id, id, survivor_id FROM s")[0]


@query("merge_prompts", f"""{_GROUPS} SELECT s.id, 'Compare these two memories and decide: MERGE or KEEP_BOTH.' || chr(10) || chr(10) || 'Memory A (id=' || a.id || '):' || chr(10) || '  context: ' || coalesce(a.context, '') || chr(10) || '  action: ' || coalesce(a.action, '') || chr(10)
    || '  result: ' || coalesce(a.result, '') || chr(10) || chr(10) || 'Memory B (id=' || b.id || '):' || chr(10) || '  context: ' || coalesce(b.context, '') || chr(10) || '  action: ' || coalesce(b.action, '') || chr(10) || '  result: ' || coalesce(b.result, '') || chr(10) || chr(10)
    || 'Respond with exactly one word: MERGE or KEEP_BOTH' AS prompt FROM s JOIN memories a ON a.id = s.survivor_id JOIN memories b ON b.id = s.id WHERE s.id <> s.survivor_id""")
def merge_prompts(s, d):
    return pipeline.merge_prompts(con.exact_members(_m(s, d)), _m(s, d)).select("id", "prompt")


def _odd(prompt):
    """A generator for the queries: it says MERGE where the prompt has an odd number of characters."""
    return F.when(F.length(prompt) % 2 == 1, "<think>KEEP</think> MERGE").otherwise("KEEP_BOTH")


@query("model_plan", f"""WITH pr AS ({ORACLE['merge_prompts']}), v AS (SELECT id, CASE WHEN length(prompt) % 2 = 1 THEN 'merge' ELSE 'keep' END AS action FROM pr)
SELECT id, action, CAST(CASE WHEN action = 'merge' THEN 0.8 ELSE 0.7 END AS DOUBLE) AS confidence FROM v""")
def model_plan(s, d):
    m = _m(s, d)
    groups = con.exact_members(m)
    none = m.select("id").limit(0)
    return con.plan(groups, none, none, m, pipeline.verdicts(groups, m, _odd)).select("id", "action", "confidence")


@query("hypothesis_prompts", """SELECT query_id, 'Given this short query, generate a detailed hypothetical document that would be a perfect search result. Query: ' || coalesce(mode, '') AS prompt FROM routing_log""")
def hypothesis_prompts(s, d):
    return table(s, d, "routing_log").select("query_id", prompts.hypothesis_prompt(F.col("mode")).alias("prompt"))


_BEFORE = f"CAST(replace(replace(updated_at, 'T', ' '), 'Z', '') AS TIMESTAMP)"
_PLAIN = f"""least(greatest(0.4::DOUBLE * CASE WHEN len(q) = 0 THEN 0 ELSE len(list_filter(q, lambda x: list_contains(w, x))) / len(q) END
    + 0.3::DOUBLE * exp(-coalesce(CASE WHEN regexp_full_match(updated_at, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ') THEN greatest(epoch(TIMESTAMP '2026-01-01' - {_BEFORE}), 0) / 86400.0 END, 0) / 30.0) + 0.3::DOUBLE * least(coalesce(used_count, 0) / 10.0, 1.0), 0), 1)"""
_ASKS = """t AS (SELECT *, regexp_extract_all(lower(coalesce(tags, '')), '[\\p{L}\\p{N}]+') AS q, regexp_extract_all(lower(concat_ws(' ', context, action, result)), '[\\p{L}\\p{N}]+') AS w FROM memories)"""


def _judged(s, d, generate=None):
    m = _m(s, d)
    given = F.when(_n() % 5 == 0, (_n() % 7) / 4.0)
    return pipeline.judge_rows(m.select(F.col("id").alias("memory_id"), F.col("tags").alias("query"), given.alias("score")), m, F.lit(NOW).cast("timestamp"), generate)


@query("judge_explicit", f"""WITH {_ASKS} SELECT id AS memory_id, round(CASE WHEN {_NUM} % 5 = 0 THEN ({_NUM} % 7) / 4.0 ELSE {_PLAIN} END, 6) AS score, {_NUM} % 5 = 0 AS explicit, false AS degraded FROM t""")
def judge_explicit(s, d):
    """Given scores hold, above 1 too; the others are computed."""
    return _judged(s, d).select("memory_id", F.round("score", 6).alias("score"), (F.col("reason") == "explicit score").alias("explicit"), "degraded")


@query("judge_combined", f"""WITH {_ASKS}, r AS (SELECT *, {_NUM} AS n FROM t)
SELECT id AS memory_id, round(CASE WHEN n % 5 = 0 THEN (n % 7) / 4.0 WHEN length(coalesce(tags, '')) % 3 = 0 THEN least((length(coalesce(tags, '')) % 10) / 6.0, 1.0) ELSE {_PLAIN} END, 6) AS score,
    CASE WHEN n % 5 = 0 THEN 'explicit score' WHEN length(coalesce(tags, '')) % 3 = 0 THEN 'said so' ELSE 'heuristic' END AS reason, n % 5 <> 0 AND length(coalesce(tags, '')) % 3 <> 0 AS degraded FROM r""")
def judge_combined(s, d):
    """A generator that can be read for a third of the prompts, told from the length of the query in them."""

    def generate(prompt):
        asked = F.length(F.regexp_extract(prompt, r"(?s)^[^\n]*\n\nQuery: (.*?)\n\nMemory:\n- Context: ", 1))
        reply = F.concat(F.lit('{"score": '), ((asked % 10) / 6.0).cast("string"), F.lit(', "reason": "said so"}'))
        return F.when(prompt.isNotNull() & (asked % 3 == 0), reply).when(prompt.isNotNull(), "no JSON at all")

    reason = F.when(F.col("reason").startswith("keyword:"), "heuristic").otherwise(F.col("reason"))
    return _judged(s, d, generate).select("memory_id", F.round("score", 6).alias("score"), reason.alias("reason"), "degraded")


@query("judge_apply", f"""SELECT (SELECT round(sum(CASE WHEN {_NUM} % 5 = 0 THEN CAST(0.75 AS FLOAT) ELSE CASE WHEN isnan(score) THEN 0 ELSE score END END), 2) FROM memories) AS scores,
    (SELECT count(*) FROM feedback_tracking WHERE judged OR memory_id IN (SELECT id FROM memories WHERE {_NUM} % 5 = 0)) AS judged""")
def judge_apply(s, d):
    m = _m(s, d).select("id", "context", "action", "result", "score", "updated_at", "used_count")
    asked = m.where(_n() % 5 == 0).select(F.col("id").alias("memory_id"), F.lit("").alias("query"), F.lit(0.75).alias("score"))
    scored, told, _ = pipeline.judge(asked, m, table(s, d, "feedback_tracking"), NOW)
    total = F.sum(F.when(~F.isnan("score"), F.col("score")).otherwise(0).cast("double"))
    return scored.agg(F.round(total, 2).alias("scores")).crossJoin(F.broadcast(told.agg(F.count_if("judged").alias("judged"))))


# -- groups, previews, chains

@query("preview_counts", f"""SELECT (SELECT count(*) FROM ({STORE_SQL['exact_dup_groups']})) AS duplicates, (SELECT count(*) FROM ({STORE_SQL['stale_scan']})) AS stale, (SELECT count(*) FROM ({STORE_SQL['orphan_antijoin']})) AS garbage""")
def preview_counts(s, d):
    return pipeline.preview(STORE["exact_dup_members"](s, d), STORE["stale_scan"](s, d), STORE["orphan_antijoin"](s, d))


_LOOSE = "g AS (SELECT DISTINCT coalesce(project, '') AS primary_id, parent_id AS id FROM memories WHERE parent_id IS NOT NULL)"


def _loose(s, d):
    """Groups whose members may be missing: the parents that a project's rows name, as they are spelt."""
    return _m(s, d).where("parent_id is not null").select(F.coalesce("project", F.lit("")).alias("primary_id"), F.col("parent_id").alias("id")).distinct()


@query("group_errors", f"""WITH {_LOOSE} SELECT primary_id, count(*) AS missing, 'memory not found: ' || min(g.id) AS error FROM g LEFT JOIN memories m ON m.id = g.id WHERE m.id IS NULL GROUP BY 1""")
def group_errors(s, d):
    return pipeline.load_groups(_loose(s, d), _m(s, d))[1]


@query("group_members", f"""WITH {_LOOSE}, b AS (SELECT primary_id FROM g LEFT JOIN memories m ON m.id = g.id WHERE m.id IS NULL)
SELECT primary_id, m.id, m.context FROM g JOIN memories m ON m.id = g.id WHERE primary_id NOT IN (SELECT primary_id FROM b)""")
def group_members(s, d):
    return pipeline.load_groups(_loose(s, d), _m(s, d))[0].select("primary_id", "id", "context")


@query("audit_rows", f"""WITH pl AS ({STORE_SQL['consolidation_plan']}) SELECT action, CASE WHEN action = 'merge' THEN '["' || survivor_id || '","' || id || '"]' ELSE '["' || id || '"]' END AS memory_ids, '{NOW}' AS performed_at, 'agent' AS performed_by FROM pl""")
def audit_rows(s, d):
    m = _m(s, d)
    return con.apply_plan(m, table(s, d, "feedback_tracking"), STORE["consolidation_plan"](s, d), NOW)[2].select("action", "memory_ids", "performed_at", "performed_by")


@query("audit_members", """SELECT DISTINCT l.id, unnest(CASE WHEN memory_ids LIKE '["%"]' AND json_valid(memory_ids) THEN from_json(memory_ids, '["varchar"]') ELSE [memory_ids] END) AS memory_id FROM consolidation_log l WHERE memory_ids IS NOT NULL AND NOT regexp_matches(memory_ids, '^\\s*\\[') OR memory_ids LIKE '["%"]' AND json_valid(memory_ids)""")
def audit_members(s, d):
    log = table(s, d, "consolidation_log")
    fit = ~F.col("memory_ids").rlike(r"^\s*\[") | (F.col("memory_ids").like('["%"]') & F.expr("try_parse_json(memory_ids) is not null"))
    return log.where("memory_ids is not null").where(fit).select("id", F.explode(audit_ids(F.col("memory_ids"))).alias("memory_id")).distinct()


@query("prune_index", f"""WITH pl AS ({STORE_SQL['consolidation_plan']}) SELECT id FROM memories WHERE indexed AND superseded_by IS NULL AND octet_length(embedding_context) = 256 AND id NOT IN (SELECT id FROM pl)""")
def prune_index(s, d):
    vectors = searchable(_m(s, d)).where(F.octet_length("embedding_context") == 256).select("id", F.col("embedding_context").alias("vec"))
    return con.prune(vectors, STORE["consolidation_plan"](s, d)).select("id")


@query("index_contains", """SELECT DISTINCT memory_id AS id, coalesce(memory_id IN (SELECT id FROM memories WHERE indexed AND superseded_by IS NULL AND octet_length(embedding_context) = 256), false) AS indexed FROM feedback_tracking""")
def index_contains(s, d):
    vectors = searchable(_m(s, d)).where(F.octet_length("embedding_context") == 256).select("id")
    return store.contains(vectors, table(s, d, "feedback_tracking").select(F.col("memory_id").alias("id")).distinct())


# -- the store's reads, writes and listings

@query("ordered_ids", f"SELECT row_number() OVER (ORDER BY created_at, id) AS place, id FROM memories WHERE {_ACTIVE}")
def ordered_ids(s, d):
    return store.ordered_ids(_m(s, d))


@query("unindexed_batch", "SELECT id FROM memories WHERE NOT indexed ORDER BY id LIMIT 100")
def unindexed_batch(s, d):
    return store.unindexed(_m(s, d), 100).select("id")


@query("reindex_batch", "SELECT id FROM memories WHERE NOT indexed AND embedding_context IS NOT NULL ORDER BY id LIMIT 100")
def reindex_batch(s, d):
    return store.reindex_candidates(_m(s, d))


@query("insert_rows", f"SELECT count(*) AS rows, count(DISTINCT id) AS ids FROM (SELECT id FROM memories UNION ALL SELECT id || '-new' FROM memories WHERE {_NUM} % 3 = 0)")
def insert_rows(s, d):
    m = _m(s, d)
    more = m.where(_n() % 3 == 0).withColumn("id", F.concat("id", F.lit("-new")))
    return store.insert(m, more).agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))


@query("replace_insights", f"SELECT memory_type, count(*) AS n FROM (SELECT memory_type FROM memories WHERE memory_type <> 'insight' UNION ALL SELECT 'insight' FROM memories WHERE {_NUM} % 9 = 0) GROUP BY 1")
def replace_insights(s, d):
    m = _m(s, d)
    new = store.insight_rows(m.where(_n() % 9 == 0).select(F.concat(F.lit("i-"), "id").alias("id"), "context", "action", "result", F.lit("cluster").alias("insight_type"), F.col("id").alias("source_ids"), "tags"), NOW)
    return store.replace_insights(m, new).groupBy("memory_type").agg(F.count("*").alias("n"))


@query("insight_defaults", f"SELECT 'i-' || id AS id, 'insight' AS memory_type, 0.0::FLOAT AS score, false AS indexed, '{NOW}' AS created_at, '{NOW}' AS updated_at, 0 AS used_count, embedding IS NULL AS bare FROM (SELECT id, NULL AS embedding FROM memories WHERE {_NUM} % 9 = 0)")
def insight_defaults(s, d):
    new = _m(s, d).where(_n() % 9 == 0).select(F.concat(F.lit("i-"), "id").alias("id"), "context", "action", "result", F.lit("cluster").alias("insight_type"))
    return store.insight_rows(new, NOW).select("id", "memory_type", "score", "indexed", "created_at", "updated_at", "used_count", F.col("embedding_context").isNull().alias("bare"))


@query("delete_insights", f"SELECT id FROM memories WHERE NOT (memory_type = 'insight' AND {_NUM} % 2 = 0)")
def delete_insights(s, d):
    m = _m(s, d)
    return store.delete_insights(m, m.where("memory_type = 'insight'").where(_n() % 2 == 0).select("id")).select("id")


@query("set_scores", f"SELECT id, CASE WHEN {_NUM} % 4 = 0 THEN CAST(0.5 AS FLOAT) ELSE score END AS score FROM memories WHERE NOT isnan(score) OR score IS NULL")
def set_scores(s, d):
    m = _m(s, d).select("id", "score").where("not isnan(score) or score is null")
    return store.set_fields(m, m.where(_n() % 4 == 0).select("id", F.lit(0.5).cast("float").alias("score")))


@query("track_search", f"SELECT memory_id, query_id, searched_at, judged FROM feedback_tracking UNION ALL SELECT id, 'q-new', '{NOW}', false FROM memories WHERE {_NUM} % 20 = 0")
def track_search(s, d):
    f = table(s, d, "feedback_tracking")
    hits = _m(s, d).where(_n() % 20 == 0).select("id", F.lit("q-new").alias("query_id"))
    return f.unionByName(store.feedback_rows(hits, NOW)).select("memory_id", "query_id", "searched_at", "judged")


@query("violations_found", f"""WITH b AS (SELECT CASE WHEN {_NUM} % 5 = 0 THEN '' ELSE id END AS id, CASE WHEN {_NUM} % 7 = 0 THEN 'odd' ELSE memory_type END AS memory_type, CASE WHEN {_NUM} % 11 = 0 THEN NULL ELSE context END AS context,
    CASE WHEN {_NUM} % 13 = 0 THEN repeat('é', 5001) ELSE action END AS action, result, CASE WHEN {_NUM} % 17 = 0 THEN 'causal' WHEN {_NUM} % 19 = 0 THEN 'none' ELSE insight_type END AS insight_type FROM memories)
{STORE_SQL['violations'].replace('FROM memories)', 'FROM b)')}""")
def violations_found(s, d):
    """Rows that break every constraint somewhere."""
    n = _n()
    m = _m(s, d)
    broken = m.select(
        F.when(n % 5 == 0, "").otherwise(F.col("id")).alias("id"), F.when(n % 7 == 0, "odd").otherwise(F.col("memory_type")).alias("memory_type"), F.when(n % 11 != 0, F.col("context")).alias("context"),
        F.when(n % 13 == 0, F.repeat(F.lit("é"), 5001)).otherwise(F.col("action")).alias("action"), "result", F.when(n % 17 == 0, "causal").when(n % 19 == 0, "none").otherwise(F.col("insight_type")).alias("insight_type"),
    )
    return store.violations(broken)


@query("comma_suspects", "SELECT id, tags FROM memories WHERE tags NOT LIKE '[%' AND tags LIKE '%,%'")
def comma_suspects(s, d):
    return store.comma_suspects(_m(s, d))


@query("csv_sources", "SELECT id, pos, item FROM (SELECT id, generate_subscripts(v, 1) AS pos, unnest(v) AS item FROM (SELECT id, list_filter(list_transform(str_split(source_ids, ','), lambda x: trim(x)), lambda x: x <> '') AS v FROM memories))")
def csv_sources(s, d):
    return _m(s, d).select("id", F.posexplode(split_csv(F.col("source_ids"))).alias("pos", "item")).select("id", (F.col("pos") + 1).cast("long").alias("pos"), "item")


@query("canonical_times", f"SELECT id, strftime({ts_sql('created_at')}, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM memories")
def canonical_times(s, d):
    return _m(s, d).select("id", iso(instant(F.col("created_at"))).alias("created_at"))


@query("q_upsert", f"""WITH {REWARDS_SQL}, o AS (SELECT router_level, state, action, 0.25::DOUBLE AS value, 3 AS n FROM rw WHERE action <> 'low_threshold' GROUP BY ALL), u AS (SELECT router_level, state, action, max_by(reward, seq) AS value, count(*) AS n FROM rw WHERE state <> 'plan' GROUP BY ALL)
SELECT router_level, state, action, coalesce(u.value, o.value) AS value, coalesce(o.n, 0) + coalesce(u.n, 0) AS update_count FROM o FULL JOIN u USING (router_level, state, action)""")
def q_upsert(s, d):
    e = reward_events(s, d)
    old = e.where("action <> 'low_threshold'").select("router_level", "state", "action").distinct().select("*", F.lit(0.25).alias("value"), F.lit(3).cast("long").alias("update_count"), F.lit("t").alias("updated_at"))
    new = e.where("state <> 'plan'").select("router_level", "state", "action", F.col("reward").alias("value"), "seq", F.lit("u").alias("updated_at"))
    return store.upsert_q(old, new).select("router_level", "state", "action", "value", "update_count")


def _q(s, d):
    return routing.fold_rewards(reward_events(s, d))


_FOLD = f"""WITH {REWARDS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY router_level, state, action ORDER BY seq DESC) - 1 AS back FROM rw WHERE reward IS NOT NULL),
q AS (SELECT router_level, state, action, sum(0.1::DOUBLE * pow(0.9::DOUBLE, back) * reward) AS value, count(*) AS update_count FROM b GROUP BY 1, 2, 3)"""


@query("q_value_lookup", f"""{_FOLD}, k AS (SELECT DISTINCT 'search' AS router_level, lower(trim(mode)) AS state, search_strategy AS action FROM routing_log)
SELECT router_level, state, action, round(coalesce(value, 0), 6) AS value FROM k LEFT JOIN q USING (router_level, state, action)""")
def q_value_lookup(s, d):
    keys = table(s, d, "routing_log").select(F.lit("search").alias("router_level"), F.lower(F.trim("mode")).alias("state"), F.col("search_strategy").alias("action")).distinct()
    return store.q_value(_q(s, d), keys).withColumn("value", F.round("value", 6))


@query("q_actions", f"{_FOLD} SELECT router_level, action, round(value, 6) AS value, update_count FROM q WHERE state = 'debug'")
def q_actions(s, d):
    return routing.actions_for_state(_q(s, d), "debug").withColumn("value", F.round("value", 6))


@query("q_listing", f"{_FOLD} SELECT router_level, state, action, round(value, 6) AS value FROM q ORDER BY 1, 2, 3")
def q_listing(s, d):
    return routing.q_rows(_q(s, d)).select("router_level", "state", "action", F.round("value", 6).alias("value"))


@query("q_key_cap", f"""{_FOLD}, known AS (SELECT router_level, state, action FROM q WHERE action = 'high_threshold'), f AS (SELECT router_level, state, action, min(seq) AS first FROM b WHERE action <> 'high_threshold' GROUP BY ALL),
new AS (SELECT router_level, state, action FROM f ORDER BY first, router_level, state, action LIMIT 4)
SELECT router_level, state, action, update_count + CASE WHEN action = 'high_threshold' THEN 1 ELSE 0 END AS update_count FROM q JOIN (SELECT * FROM known UNION ALL SELECT * FROM new) USING (router_level, state, action)""")
def q_key_cap(s, d):
    """A table of six keys that may hold ten: four of the twelve new keys are taken, the first that appear."""
    start = reward_events(s, d).where("action = 'high_threshold' and reward is not null").select("router_level", "state", "action").distinct().select("*", F.lit(0.5).alias("value"), F.lit(1).cast("long").alias("update_count"))
    start = cut(start)
    return routing.fold_rewards(reward_events(s, d), start=start, most=start.count() + 4).select("router_level", "state", "action", "update_count")


@query("explore_decisions", """SELECT query_id, 'medium_threshold' AS search_strategy, 'balanced' AS llm_selection, 'summarize' AS contextualization, 'proactive' AS proactivity FROM routing_log WHERE lower(trim(mode)) IN ('debug', 'architecture', 'coding', 'review', 'plan', 'routine')""")
def explore_decisions(s, d):
    """A draw under epsilon: number floor(0.08 / 0.15 * n) of each level."""
    q = table(s, d, "routing_log").select("query_id", routing.parse_mode(F.col("mode")).alias("mode")).where("mode is not null")
    return routing.decide(q, _q(s, d), rng=0.08).select("query_id", "search_strategy", "llm_selection", "contextualization", "proactivity")


@query("routing_rows", f"""SELECT query_id, lower(trim(mode)) AS mode, search_strategy, top_k, CASE WHEN json_valid(shadow_rewards) THEN shadow_rewards END AS shadow_rewards, '{NOW}' AS created_at FROM routing_log""")
def routing_rows(s, d):
    r = table(s, d, "routing_log")
    decisions = r.withColumn("mode", F.lower(F.trim("mode")))
    rewards = r.where("try_parse_json(shadow_rewards) is not null").select("query_id", "shadow_rewards")
    return ingest.routing_rows(decisions, rewards, NOW).select("query_id", "mode", "search_strategy", "top_k", "shadow_rewards", "created_at")


@query("histogram_bars", f"""WITH h AS ({STORE_SQL['score_histogram']}) SELECT bucket, rows, CAST(CASE WHEN rows > 0 THEN greatest(floor(rows * 40 / max(rows) OVER ()), 1) ELSE 0 END AS INTEGER) AS bar FROM h""")
def histogram_bars(s, d):
    return mining.bars(mining.score_histogram(_m(s, d)))


@query("lag_percentiles", f"""WITH t AS (SELECT epoch({ts_sql('judged_at')} - {ts_sql('searched_at')}) * 1000 AS ms FROM feedback_tracking WHERE judged)
SELECT quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99, quantile_disc(ms, 0.999) AS p99_9 FROM t""")
def lag_percentiles(s, d):
    """How long judgements take."""
    f = table(s, d, "feedback_tracking").where("judged")
    ms = (F.unix_micros(instant(F.col("judged_at"))) - F.unix_micros(instant(F.col("searched_at")))) / 1000.0
    return ranking.percentiles(f.select(ms.alias("ms")))


# -- files, messages, envelopes

@query("portable_lines", "SELECT id, score, tags FROM memories WHERE superseded_by IS NULL AND (score IS NULL OR NOT isnan(score))")
def portable_lines(s, d):
    """An export written as JSON lines and read again."""
    from memlens.runtime import new_table

    path = new_table(s)
    portable.write_export(_m(s, d).where("score is null or not isnan(score)"), path)
    return portable.read_lines(s, path).select("id", "score", "tags")


@query("insight_messages", f"""WITH c AS ({STORE_SQL['chain_insights']}), t AS ({STORE_SQL['temporal_insights']}) SELECT id, context, insight_type, source_ids FROM c UNION ALL SELECT id, context, insight_type, source_ids FROM t""")
def insight_messages(s, d):
    """Insights told as message lines and taken from them again, among other messages."""
    from memlens.runtime import new_table

    both = STORE["chain_insights"](s, d).unionByName(STORE["temporal_insights"](s, d))
    told = both.select(portable.message("insight", **{c: F.col(c) for c in both.columns}).alias("value"))
    other = _m(s, d).select(portable.message("progress", stage=F.col("id"), percent=F.lit(1.0)).alias("value"))
    path = new_table(s)
    told.unionByName(other).unionByName(_m(s, d).select(F.lit("").alias("value"))).write.text(path)
    return portable.insights_of(portable.read_messages(s, path)).select("id", "context", "insight_type", "source_ids")


@query("responses", """SELECT id, CASE WHEN score IS NULL OR isnan(score) THEN '{"id":"' || id || '","ok":false,"error":{"code":1002,"message":"no score"}}' ELSE '{"id":"' || id || '","ok":true,"data":{"indexed":' || indexed || '}}' END AS response FROM memories""")
def responses(s, d):
    bad = F.when(F.col("score").isNull() | F.isnan("score"), 1002)
    return _m(s, d).select("id", portable.response(F.col("id"), F.struct("indexed"), bad, F.lit("no score")).alias("response"))


@query("training_lines", f"""SELECT id, 'Context: ' || coalesce(context, '') || chr(10) || 'Action: ' || coalesce(action, '') || chr(10) || coalesce(result, '') AS text FROM memories WHERE {_ACTIVE} AND CAST(score AS DOUBLE) > 0.5""")
def training_lines(s, d):
    return mining.training_lines(_m(s, d))


@query("medium_run")
def medium_run(s, d):
    """Kinds of messages of a whole run, with how many there are."""
    from memlens.plans.search_queries import _usable

    own = _m(s, d).drop("embedding_context").join(_usable(s, d).select("id", "embedding_context"), "id").where("score is null or not isnan(score)")
    run = pipeline.run_deep(own, table(s, d, "feedback_tracking"), _q(s, d), own.select("id", F.col("context").alias("generated"), F.col("action").alias("reference")))
    kind = F.get_json_object("value", "$.type")
    return run.messages.groupBy(kind.alias("kind")).agg(F.count("*").alias("messages"))


@query("startup_migrations", """SELECT count(*) AS memories, count(*) FILTER (NOT (tags IS NULL OR tags = '' OR tags LIKE '["%"]')) AS odd, 3 AS done, 0 AS again FROM memories""".replace("count(*) FILTER (NOT (tags IS NULL OR tags = '' OR tags LIKE '[\"%\"]')) AS odd", "0 AS odd"))
def startup_migrations(s, d):
    """All migrations at once; afterwards no tags are odd and nothing is left to do."""
    meta = s.createDataFrame([("text_index", "simple")], "key string, value string")
    m, _, done, _ = pipeline.run_migrations(_m(s, d), table(s, d, "feedback_tracking").drop("query_id"), meta)
    odd = F.count_if(~(F.col("tags").isNull() | (F.col("tags") == "") | F.col("tags").like('["%"]')))
    again = len(pipeline.pending_migrations(done))
    return m.agg(F.count("*").alias("memories"), odd.alias("odd")).crossJoin(F.broadcast(done.agg(F.count("*").alias("done")))).withColumn("again", F.lit(again))


# -- embedding, hashes and the write path

def _embed(column):
    return deterministic_embedding(16)(column)


_BYTES = """list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)"""


@query("embedded_actions", f"""WITH t AS (SELECT id, {_BYTES} AS b FROM (SELECT id, hex(encode(action)) AS h FROM memories WHERE action IS NOT NULL AND action <> '')),
v AS (SELECT id, list_transform(range(16), lambda k: list_sum(list_transform(list_filter(list_zip(b, range(len(b))), lambda x: x[2] % 16 = k), lambda x: x[1] / 255.0::DOUBLE))) AS v FROM t),
u AS (SELECT id, list_transform(v, lambda x: coalesce(x, 0)) AS v FROM v)
SELECT id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 3) AS first, round(v[16] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 3) AS last FROM u""")
def embedded_actions(s, d):
    own = _m(s, d).where("action is not null and action <> ''").select("id", F.col("action").alias("text"))
    v = ingest.embed_texts(own, _embed)
    cell = lambda i: F.round(F.element_at("vec", i).cast("double"), 3)
    return v.select("id", cell(1).alias("first"), cell(16).alias("last"))


@query("hash_ids", """WITH RECURSIVE t AS (SELECT id, hex(encode(id)) AS h FROM memories),
f AS (SELECT id, h, 0 AS i, 14695981039346656037::HUGEINT AS x FROM t
      UNION ALL SELECT id, h, i + 1, (xor(x::UBIGINT, ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)::HUGEINT * 435::HUGEINT + ((xor(x::UBIGINT, ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT) & 16777215::UBIGINT)::HUGEINT << 40)) % 18446744073709551616::HUGEINT FROM f WHERE i < len(h) // 2)
SELECT id, CASE WHEN x >= 9223372036854775808::HUGEINT THEN x - 18446744073709551616::HUGEINT ELSE x END::BIGINT AS hash FROM f WHERE i = len(h) // 2""")
def hash_ids(s, d):
    return _m(s, d).select("id", fnv1a_64(F.col("id")).alias("hash"))


@query("hash_collisions", f"SELECT hash, count(DISTINCT id) AS ids FROM ({ORACLE['hash_ids']}) GROUP BY 1 HAVING count(DISTINCT id) > 1")
def collisions(s, d):
    return hash_collisions(_m(s, d))


@query("resolve_hashes", f"SELECT hash, id FROM ({ORACLE['hash_ids']}) WHERE hash % 3 = 0")
def resolved(s, d):
    known = QUERIES["hash_ids"](s, d).where("hash % 3 = 0").select("hash")
    return resolve_hashes(known, _m(s, d))


@query("hash_levels", f"""WITH h AS ({ORACLE['hash_ids']}), u AS (SELECT id, (CASE WHEN hash < 0 THEN hash::HUGEINT + 18446744073709551616::HUGEINT ELSE hash::HUGEINT END) AS x FROM h),
lo AS (SELECT id, x % 4294967296 AS l, x // 4294967296 AS u FROM u),
p AS (SELECT id, ((l * 2135587861) + (((l * 2654435769) % 4294967296 + (u * 2135587861) % 4294967296) % 4294967296) * 4294967296) % 18446744073709551616 AS y FROM lo)
SELECT id, round((y // 2048)::DOUBLE / 9007199254740992, 9) AS u FROM p""")
def hash_levels(s, d):
    return _m(s, d).select("id", F.round(hash_uniform(fnv1a_64(F.col("id"))), 9).alias("u"))


@query("store_intake")
def store_intake(s, d):
    """The pending rows embedded and stored one after the other: what is kept and what falls to which row. The tests have the sequential pass."""
    rows = table(s, d, "memory_intake").where("context is not null and action is not null and result is not null and id is not null")
    once = rows.groupBy("id").agg(F.min(F.struct("batch_no", "arrival_no", "memory_type", "context", "action", "result"))["arrival_no"].alias("arrival_no"))
    fresh = rows.join(once, ["id", "arrival_no"]).join(_m(s, d).select("id"), "id", "left_anti")
    batch = fresh.select(F.col("arrival_no").alias("n"), "id", "memory_type", "context", "action", "result", "tags")
    have = searchable(_m(s, d)).select("id", *ingest.FIELDS)
    return ingest.store_batch(_m(s, d), ingest.embed_fields(have, _embed), batch, _embed, NOW)[2]


@query("reembed_stats", f"SELECT count(*) FILTER (context IS NOT NULL AND action IS NOT NULL AND result IS NOT NULL) AS embedded, count(*) FILTER (context IS NULL OR action IS NULL OR result IS NULL) AS failed FROM memories WHERE superseded_by IS NULL")
def reembed_stats(s, d):
    return ingest.reembed(_m(s, d), _embed)[1]


@query("status_hints", """WITH p AS (SELECT count(*) AS pending FROM (SELECT memory_id FROM feedback_tracking GROUP BY 1 HAVING NOT max(coalesce(judged, false)))), m AS (SELECT count(*) AS memories, count(*) FILTER (indexed) AS indexed FROM memories)
SELECT memories, indexed, pending, concat_ws(',', CASE WHEN memories >= 20 THEN 'train' END, CASE WHEN pending > 10 THEN 'judge' END, CASE WHEN indexed < memories THEN 'reindex' END) AS hints FROM m, p""")
def status_hints(s, d):
    return ingest.status(_m(s, d), table(s, d, "feedback_tracking")).withColumn("hints", F.array_join("hints", ","))


@query("saved_search", f"""WITH f AS (SELECT context, row_number() OVER (ORDER BY created_at, id) AS place FROM memories WHERE {_NUM} % 20 = 0)
SELECT 'Searched for: owner' AS context, 'Found ' || count(*) || ' results' AS action, 'Top result: ' || max(context) FILTER (place = 1) AS result FROM f""")
def saved_search(s, d):
    hits = store.ordered_ids(_m(s, d).withColumn("superseded_by", F.lit(None).cast("string")).withColumn("memory_type", F.lit("bugfix")).where(_n() % 20 == 0))
    return ingest.saved_search(hits.join(_m(s, d), "id").select("place", "context"), "owner")


@query("query_words", """SELECT query_id, CASE WHEN n > 0 AND n < 2 THEN 'hypothesis' ELSE 'query' END AS used FROM (SELECT query_id, len(str_split_regex(trim(mode), '\\s+')) * CAST(trim(mode) <> '' AS INTEGER) AS n FROM routing_log WHERE mode IS NOT NULL)""")
def query_words(s, d):
    r = table(s, d, "routing_log").where("mode is not null")
    return r.select("query_id", F.when(ingest.hyde_text(F.col("mode"), F.lit("\0"), 2) == "\0", "hypothesis").otherwise("query").alias("used"))
