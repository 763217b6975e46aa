"""Queries over the store: scans, filters, reports, duplicates, plans, imports and migrations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlens.functions.text import normalize_tags, preview
from memlens.functions.timeutil import month_utc, instant
from memlens.operators import consolidation as con
from memlens.operators import mining, store
from memlens.plans.core_problems import ts_sql
from memlens.runtime import table

NOW = "2026-01-01T00:00:00Z"


def _m(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "memories")


def _now():
    return F.lit(NOW).cast("timestamp")


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


# -- scans

_SCAN = "SELECT id, memory_type, created_at FROM memories WHERE "
_BRIEF = ("id", "memory_type", "created_at")


@query("scan_active", _SCAN + "superseded_by IS NULL")
def scan_active(s, d):
    return store.active(_m(s, d)).select(*_BRIEF)


@query("scan_indexed", "SELECT id FROM memories WHERE indexed AND superseded_by IS NULL")
def scan_indexed(s, d):
    return store.indexed_ids(_m(s, d))


@query("scan_insights", _SCAN + "superseded_by IS NULL AND memory_type = 'insight'")
def scan_insights(s, d):
    return store.insights(_m(s, d)).select(*_BRIEF)


@query("scan_training", _SCAN + "superseded_by IS NULL AND memory_type <> 'insight'")
def scan_training(s, d):
    return store.training_rows(_m(s, d)).select(*_BRIEF)


@query("scan_training_types", _SCAN + "memory_type IN ('bugfix', 'pattern')")
def scan_training_types(s, d):
    return store.training_rows(_m(s, d), ["bugfix", "pattern"]).select(*_BRIEF)


@query("scan_embedded", _SCAN + "embedding_context IS NOT NULL")
def scan_embedded(s, d):
    return store.embedded(_m(s, d)).select(*_BRIEF)


@query("filter_quality", _SCAN + "CAST(score AS DOUBLE) > 0.5")
def filter_quality(s, d):
    return store.above(_m(s, d), 0.5).select(*_BRIEF)


@query("filter_list", _SCAN + "memory_type = 'decision' AND contains(lower(context), 'owner')")
def filter_list(s, d):
    return store.listed(_m(s, d), "decision", "Owner").select(*_BRIEF)


@query("point_lookup", "SELECT id, context, score FROM memories WHERE id = (SELECT min(id) FROM memories)")
def point_lookup(s, d):
    m = _m(s, d)
    return store.by_id(m, m.agg(F.min("id")).first()[0]).select("id", "context", "score")


@query("recent_memories", """SELECT id, memory_type, created_at,
    CASE WHEN octet_length(encode(context)) > 80 THEN substr(context, 1, 77) || '...' ELSE context END AS shown
FROM memories ORDER BY created_at DESC, id LIMIT 20""")
def recent_memories(s, d):
    return store.recent(_m(s, d), 20).select("id", "memory_type", "created_at", preview(F.col("context")).alias("shown"))


@query("audit_log", "SELECT id, action, performed_at, performed_by FROM (SELECT DISTINCT id, action, performed_at, performed_by FROM consolidation_log) ORDER BY performed_at DESC, id DESC LIMIT 50")
def audit_log(s, d):
    return store.audit_log(table(s, d, "consolidation_log").select("id", "action", "performed_at", "performed_by").distinct())


@query("violations", """SELECT id, problem FROM (SELECT id, unnest([
    CASE WHEN id IS NULL OR length(id) = 0 OR length(id) > 100 THEN 'id' END,
    CASE WHEN memory_type IS NULL OR memory_type NOT IN ('decision', 'pattern', 'bugfix', 'context', 'antipattern', 'insight') THEN 'memory_type' END,
    CASE WHEN insight_type NOT IN ('cluster', 'temporal', 'causal') THEN 'insight_type' END,
    CASE WHEN greatest(strlen(coalesce(context, '')), strlen(coalesce(action, '')), strlen(coalesce(result, ''))) > 10000 THEN 'field_bytes' END,
    CASE WHEN context IS NULL OR action IS NULL OR result IS NULL THEN 'null_text' END]) AS problem FROM memories) WHERE problem IS NOT NULL""")
def violations(s, d):
    return store.violations(_m(s, d))


# -- reports

@query("store_status", """SELECT count(*) AS memories, count(*) FILTER (indexed) AS indexed, coalesce(avg(CAST(score AS DOUBLE)) FILTER (NOT isnan(score)), 0) AS avg_score FROM memories""")
def store_status(s, d):
    return store.counts(_m(s, d))


@query("type_distribution", "SELECT memory_type, count(*) AS n FROM memories GROUP BY 1")
def type_distribution(s, d):
    return store.distribution(_m(s, d), "memory_type")


@query("project_distribution", "SELECT coalesce(project, '(none)') AS project, count(*) AS n FROM memories GROUP BY memories.project")
def project_distribution(s, d):
    return store.distribution(_m(s, d), "project", "(none)")


@query("distinct_types", "SELECT DISTINCT memory_type FROM memories")
def distinct_types(s, d):
    return store.kinds(_m(s, d))


@query("score_histogram", """SELECT CAST(b.range AS INTEGER) AS bucket, coalesce(n, 0) AS rows FROM range(10) b LEFT JOIN (
    SELECT least(greatest(floor(CAST(score AS DOUBLE) * 10), 0), 9) AS k, count(*) AS n FROM memories WHERE NOT isnan(score) GROUP BY 1) h ON h.k = b.range""")
def score_histogram(s, d):
    return mining.score_histogram(_m(s, d))


@query("feedback_counts", "SELECT count(*) AS searched, count(*) FILTER (judged) AS judged, greatest(count(*) - count(*) FILTER (judged), 0) AS pending FROM feedback_tracking")
def feedback_counts(s, d):
    return mining.feedback_counts(table(s, d, "feedback_tracking"))


@query("pending_judgments", "SELECT memory_id, count(*) AS shown FROM feedback_tracking GROUP BY 1 HAVING NOT max(coalesce(judged, false))")
def pending_judgments(s, d):
    return mining.pending(table(s, d, "feedback_tracking"))


@query("routing_eval", """SELECT lower(trim(r.mode)) AS mode, r.search_strategy, count(*) AS shown, count(*) FILTER (f.judged) AS judged
FROM routing_log r JOIN feedback_tracking f ON f.query_id = r.query_id GROUP BY 1, 2""")
def routing_eval(s, d):
    return mining.routing_outcomes(table(s, d, "routing_log"), table(s, d, "feedback_tracking"))


@query("shadow_reward_means", """SELECT CAST(json_extract(x, '$.k') AS INTEGER) AS k, count(*) AS n, avg(CAST(json_extract(x, '$.reward') AS DOUBLE)) AS mean_reward
FROM (SELECT unnest(from_json(CASE WHEN json_valid(shadow_rewards) AND json_type(shadow_rewards) = 'ARRAY' THEN shadow_rewards ELSE '[]' END, '["json"]')) AS x FROM routing_log) GROUP BY 1""")
def shadow_reward_means(s, d):
    each = table(s, d, "routing_log").select(F.explode(F.from_json("shadow_rewards", "array<struct<k:int,reward:double>>")).alias("r"))
    return each.groupBy("r.k").agg(F.count("*").alias("n"), F.avg("r.reward").alias("mean_reward"))


@query("feedback_by_month", f"""SELECT strftime({ts_sql('searched_at')}, '%Y-%m') AS month, count(*) AS shown, count(DISTINCT memory_id) AS memories
FROM feedback_tracking GROUP BY 1""")
def feedback_by_month(s, d):
    f = table(s, d, "feedback_tracking").select(month_utc(instant(F.col("searched_at"))).alias("month"), "memory_id")
    return f.groupBy("month").agg(F.count("*").alias("shown"), F.countDistinct("memory_id").alias("memories"))


# -- consolidation

_CAND = "memories WHERE superseded_by IS NULL AND memory_type <> 'insight'"
_GROUPS = f"g AS (SELECT context, action, result, min(id) AS primary_id, count(*) AS size, min(created_at) AS created_at FROM {_CAND} GROUP BY 1, 2, 3 HAVING count(*) > 1)"
_MEMBERS = f"""{_GROUPS}, e AS (SELECT g.primary_id, m.id, m.memory_type, m.score, m.used_count, m.created_at FROM g JOIN (SELECT * FROM {_CAND}) m
    ON m.context IS NOT DISTINCT FROM g.context AND m.action IS NOT DISTINCT FROM g.action AND m.result IS NOT DISTINCT FROM g.result),
s AS (SELECT *, first_value(id) OVER (PARTITION BY primary_id ORDER BY memory_type = 'insight', -coalesce(score, 0), -coalesce(used_count, 0), created_at, id) AS survivor_id FROM e)"""
_STALE = f"st AS (SELECT id FROM memories WHERE score < CAST(0.3 AS FLOAT) AND coalesce(used_count, 0) = 0 AND epoch(TIMESTAMP '2026-01-01' - {ts_sql('created_at')}) / 86400.0 > 90)"
_KEY = "lower(regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"
_ORPHANS = f"o AS (SELECT id, parent_id FROM memories WHERE {_KEY.format('parent_id')} <> '' AND {_KEY.format('parent_id')} NOT IN (SELECT {_KEY.format('id')} FROM memories))"
_PLAN = f"""{_MEMBERS}, {_STALE}, {_ORPHANS}, p AS (
    SELECT 0 AS ordinal, 'merge' AS action, id, survivor_id, 0.6 AS confidence FROM s WHERE id <> survivor_id
    UNION ALL SELECT 1, 'archive', id, NULL, 0.9 FROM st UNION ALL SELECT 2, 'delete', id, NULL, 0.95 FROM o)"""


@query("exact_dup_groups", f"WITH {_GROUPS} SELECT primary_id, size, created_at FROM g")
def exact_dup_groups(s, d):
    return con.exact_groups(_m(s, d)).orderBy("created_at", "primary_id")


@query("exact_dup_members", f"WITH {_MEMBERS} SELECT primary_id, id, 1.0::DOUBLE AS similarity FROM e")
def exact_dup_members(s, d):
    return con.exact_members(_m(s, d))


@query("survivor_choice", f"WITH {_MEMBERS} SELECT primary_id, id, survivor_id FROM s")
def survivor_choice(s, d):
    return con.survivors(con.exact_members(_m(s, d)), _m(s, d))


@query("stale_scan", f"WITH {_STALE} SELECT id FROM st")
def stale_scan(s, d):
    return _stale(s, d)


def _stale(s, d):
    return con.stale(_m(s, d).withColumn("score", F.when(~F.isnan("score"), F.col("score"))), _now(), 90, 0.3)


@query("orphan_antijoin", f"WITH {_ORPHANS} SELECT id, parent_id FROM o")
def orphan_antijoin(s, d):
    return con.orphans(_m(s, d))


def _plan(s, d):
    m = _m(s, d)
    return con.plan(con.exact_members(m), _stale(s, d), con.orphans(m).select("id"), m)


@query("consolidation_plan", f"WITH {_PLAN} SELECT ordinal, action, id, survivor_id, CAST(confidence AS DOUBLE) AS confidence FROM p")
def consolidation_plan(s, d):
    return _plan(s, d)


@query("confidence_gate", f"WITH {_PLAN} SELECT action, count(*) AS steps FROM p WHERE confidence >= 0.9 GROUP BY 1")
def confidence_gate(s, d):
    return con.gate(_plan(s, d), 0.9).groupBy("action").agg(F.count("*").alias("steps"))


@query("plan_actions_json", f"""WITH {_PLAN} SELECT id, action, CASE WHEN action = 'merge' THEN '{{"type":"merge","source_id":"' || survivor_id || '","target_id":"' || id || '"}}'
    ELSE '{{"type":"' || action || '","memory_id":"' || id || '"}}' END AS step FROM p""")
def plan_actions_json(s, d):
    p = _plan(s, d)
    return p.select("id", "action", con.action_json(p).alias("step"))


@query("apply_snapshot", f"""WITH {_PLAN}, mg AS (SELECT id, max(survivor_id) AS survivor_id FROM p WHERE action = 'merge' GROUP BY id)
SELECT m.id, coalesce(mg.survivor_id, m.superseded_by) AS superseded_by, m.indexed AND m.id NOT IN (SELECT id FROM p WHERE action = 'archive') AS indexed
FROM memories m LEFT JOIN mg ON mg.id = m.id WHERE m.id NOT IN (SELECT id FROM p WHERE action = 'delete')""")
def apply_snapshot(s, d):
    out, _, _, _ = con.apply_plan(_m(s, d), table(s, d, "feedback_tracking"), _plan(s, d), NOW)
    return out.select("id", "superseded_by", "indexed")


@query("apply_summary", f"WITH {_PLAN} SELECT action, count(*) AS steps FROM p GROUP BY 1")
def apply_summary(s, d):
    return con.apply_plan(_m(s, d), table(s, d, "feedback_tracking"), _plan(s, d), NOW)[3]


@query("apply_feedback", f"WITH {_PLAN} SELECT memory_id, count(*) AS rows FROM feedback_tracking WHERE memory_id NOT IN (SELECT id FROM p WHERE action = 'delete') GROUP BY 1")
def apply_feedback(s, d):
    told = con.apply_plan(_m(s, d), table(s, d, "feedback_tracking"), _plan(s, d), NOW)[1]
    return told.groupBy("memory_id").agg(F.count("*").alias("rows"))


# -- mutation on snapshots

@query("touch_from_feedback", """SELECT m.id, coalesce(m.used_count, 0) + coalesce(t.n, 0) AS used_count, coalesce(t.at_, m.last_used_at) AS last_used_at
FROM memories m LEFT JOIN (SELECT memory_id, count(*) AS n, max(judged_at) AS at_ FROM feedback_tracking WHERE judged GROUP BY 1) t ON t.memory_id = m.id""")
def touch_from_feedback(s, d):
    touches = table(s, d, "feedback_tracking").where("judged").select(F.col("memory_id").alias("id"), F.col("judged_at").alias("at"))
    return store.touch(_m(s, d).select("id", "used_count", "last_used_at"), touches)


@query("mark_judged", f"""SELECT memory_id, count(*) FILTER (judged OR memory_id IN (SELECT id FROM memories WHERE memory_type = 'bugfix')) AS judged,
    count(*) FILTER (memory_id IN (SELECT id FROM memories WHERE memory_type = 'bugfix') AND NOT coalesce(judged, false)) AS newly FROM feedback_tracking GROUP BY 1""")
def mark_judged(s, d):
    f = table(s, d, "feedback_tracking")
    ids = _m(s, d).where("memory_type = 'bugfix'").select(F.col("id").alias("memory_id"), F.lit(NOW).alias("at"))
    return store.mark_judged(f, ids).groupBy("memory_id").agg(F.count_if("judged").alias("judged"), F.count_if(F.col("judged") & (F.col("judged_at") == NOW)).alias("newly"))


@query("delete_cascade", """SELECT (SELECT count(*) FROM memories WHERE project IS DISTINCT FROM 'amber-gateway') AS memories,
    (SELECT count(*) FROM feedback_tracking WHERE memory_id NOT IN (SELECT id FROM memories WHERE project = 'amber-gateway')) AS feedback""")
def delete_cascade(s, d):
    m, f = store.delete(_m(s, d), table(s, d, "feedback_tracking"), _m(s, d).where("project = 'amber-gateway'"))
    return m.agg(F.count("*").alias("memories")).crossJoin(F.broadcast(f.agg(F.count("*").alias("feedback"))))


# -- tags, import, export, migration

_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_STRICT = """regexp_full_match(tags, '\\s*\\[\\s*("([^"\\\\\\x00-\\x1f]|\\\\.)*"\\s*(,\\s*"([^"\\\\\\x00-\\x1f]|\\\\.)*"\\s*)*)?\\]\\s*')"""
_TAGS = f"""list_filter(CASE WHEN {_STRICT} THEN from_json(CASE WHEN {_STRICT} THEN tags ELSE '[]' END, '["varchar"]')
    ELSE list_transform(str_split(tags, ','), lambda x: {_TRIM.format('x')}) END, lambda x: {_TRIM.format('x')} <> '')"""


@query("tag_normalize", f"SELECT id, array_to_string(t, '\x1f') AS joined, len(t) AS n FROM (SELECT id, {_TAGS} AS t FROM memories WHERE tags IS NOT NULL) WHERE len(t) > 0")
def tag_normalize(s, d):
    t = F.from_json(normalize_tags(F.col("tags")), "array<string>")
    return _m(s, d).select("id", t.alias("t")).where("t is not null").select("id", F.array_join("t", "\x1f").alias("joined"), F.size("t").cast("long").alias("n"))


@query("tag_migration_stats", f"""SELECT count(*) AS scanned, count(*) FILTER ({_STRICT}) AS already_json, count(*) FILTER (NOT {_STRICT} AND contains(tags, ',')) AS rewritten_csv,
    count(*) FILTER (NOT {_STRICT} AND NOT contains(tags, ',')) AS rewritten_naked FROM memories WHERE tags <> ''""")
def tag_migration_stats(s, d):
    return store.migrate_tags(_m(s, d))[1]


@query("export_portable", "SELECT id, memory_type, context, score, project, created_at, used_count FROM memories WHERE superseded_by IS NULL")
def export_portable(s, d):
    return store.portable(_m(s, d)).select("id", "memory_type", "context", "score", "project", "created_at", "used_count")


@query("export_envelope", f"SELECT 1 AS version, count(*) AS count, '{NOW}' AS exported_at FROM memories WHERE superseded_by IS NULL")
def export_envelope(s, d):
    return store.envelope(_m(s, d), NOW)


@query("import_merge", "SELECT count(DISTINCT id) AS imported, count(*) + (SELECT count(*) FROM memory_intake i WHERE i.id IN (SELECT id FROM memories)) - count(DISTINCT id) AS skipped FROM memory_intake WHERE id NOT IN (SELECT id FROM memories)")
def import_merge(s, d):
    return store.merge_import(_m(s, d), table(s, d, "memory_intake"))[1]


@query("import_added", "SELECT DISTINCT id, false AS indexed FROM memory_intake WHERE id NOT IN (SELECT id FROM memories)")
def import_added(s, d):
    return store.merge_import(_m(s, d), table(s, d, "memory_intake"))[0].select("id", "indexed")


@query("migrate_stats", """SELECT count(*) AS read, count(*) FILTER (project = 'amber-gateway') AS matched, count(*) FILTER (project = 'amber-gateway' AND have IS NULL) AS migrated,
    count(*) FILTER (project = 'amber-gateway' AND have IS NOT NULL) AS skipped_existing, count(*) FILTER (project IS NULL) AS skipped_null,
    count(*) FILTER (project <> 'amber-gateway') AS skipped_other FROM memory_intake i LEFT JOIN (SELECT id AS have FROM memories) m ON m.have = i.id""")
def migrate_stats(s, d):
    return store.migrate(_m(s, d), table(s, d, "memory_intake"), "amber-gateway")[1]


# -- insights

@query("temporal_recurrence", f"""WITH t AS (SELECT memory_type, {ts_sql('created_at')} AS ts FROM memories WHERE superseded_by IS NULL AND memory_type <> 'insight'),
w AS (SELECT memory_type, ts FROM (SELECT *, max(ts) OVER (PARTITION BY memory_type) AS latest FROM t) WHERE ts >= latest - INTERVAL 168 HOUR)
SELECT memory_type, count(*) AS occurrences, epoch(max(ts) - min(ts)) / 3600.0 / (count(*) - 1) AS interval_hours FROM w GROUP BY 1 HAVING count(*) >= 3""")
def temporal_recurrence(s, d):
    return mining.recurrence(_m(s, d))


_TRAIN = "SELECT * FROM memories WHERE superseded_by IS NULL AND memory_type <> 'insight'"


@query("explicit_chains", f"""WITH RECURSIVE t AS ({_TRAIN}),
f AS (SELECT parent_id, arg_min(id, created_at || ' ' || id) AS next FROM t WHERE parent_id IS NOT NULL GROUP BY 1),
w AS (SELECT t.id AS root_id, CAST(0 AS BIGINT) AS place, t.id FROM t JOIN f ON f.parent_id = t.id WHERE t.parent_id IS NULL
      UNION ALL SELECT w.root_id, w.place + 1, f.next FROM w JOIN f ON f.parent_id = w.id)
SELECT root_id, place, id FROM w""")
def explicit_chains(s, d):
    return mining.explicit_chains(_m(s, d).select("id", "parent_id", "created_at", "memory_type", "superseded_by"))


@query("meta_metrics", f"""WITH t AS ({_TRAIN}) SELECT 'memory_count' AS name, CAST(count(*) AS DOUBLE) AS value FROM t UNION ALL SELECT 'avg_score', sum(CAST(score AS DOUBLE)) / count(*) FROM t
UNION ALL SELECT 'type_fraction_' || memory_type, count(*) / (SELECT count(*) FROM t) FROM t GROUP BY memory_type""")
def meta_metrics(s, d):
    return mining.metrics(_m(s, d))


@query("low_score_recs", f"""SELECT id AS target_id, 'archive' AS action, printf('Score %.2f below threshold 0.3', CASE WHEN CAST(score AS DOUBLE) < 0 THEN -floor(-CAST(score AS DOUBLE) * 100 + 0.5) ELSE floor(CAST(score AS DOUBLE) * 100 + 0.5) END / 100) AS reasoning
FROM ({_TRAIN}) WHERE CAST(score AS DOUBLE) < 0.3""")
def low_score_recs(s, d):
    return mining.low_scores(_m(s, d))


@query("ranker_features", f"""SELECT id, coalesce(CAST(score AS DOUBLE), 0) AS score, CAST(coalesce(used_count, 0) AS DOUBLE) AS used_count,
    greatest(epoch(coalesce({ts_sql('last_used_at')}, {ts_sql('updated_at')}) - {ts_sql('created_at')}) / 86400.0, 0) AS recency_days,
    CAST(length(context) + length(action) AS DOUBLE) AS text_length, CASE WHEN coalesce(tags, '') <> '' THEN 1.0 ELSE 0.0 END::DOUBLE AS has_tags FROM memories""")
def ranker_features(s, d):
    return mining.ranker_features(_m(s, d))


@query("rouge_l")
def rouge_l(s, d):
    return _m(s, d).select("id", mining.rouge_l(F.col("context"), F.col("action")).alias("rouge"))


@query("quality_gate")
def quality_gate(s, d):
    return mining.quality_gate(_m(s, d).select("id", F.col("context").alias("generated"), F.col("action").alias("reference")))


@query("classifier_accuracy")
def classifier_accuracy(s, d):
    model = mining.classifier(_m(s, d))
    return mining.accuracy(model.transform(mining.training_texts(_m(s, d))))


@query("ranker_accuracy")
def ranker_accuracy(s, d):
    rows = mining.labelled(_m(s, d), table(s, d, "feedback_tracking")).where("not isnan(score)")
    model = mining.ranker(_m(s, d).where("not isnan(score)"), table(s, d, "feedback_tracking"))
    return mining.accuracy(model.transform(rows))


_ID = "sha256(concat_ws('|', insight_type, context, action, result, source_ids))"


@query("chain_insights", f"""WITH RECURSIVE t AS ({_TRAIN}),
f AS (SELECT parent_id, arg_min(id, created_at || ' ' || id) AS next FROM t WHERE parent_id IS NOT NULL GROUP BY 1),
w AS (SELECT t.id AS root_id, 0 AS place, t.id FROM t JOIN f ON f.parent_id = t.id WHERE t.parent_id IS NULL
      UNION ALL SELECT w.root_id, w.place + 1, f.next FROM w JOIN f ON f.parent_id = w.id),
c AS (SELECT root_id, list(id ORDER BY place) AS ids FROM w GROUP BY 1),
i AS (SELECT 'Causal chain of ' || len(ids) || ' memories' AS context, 'Root type: ' || memory_type AS action, 'Chain: ' || array_to_string(ids, ' -> ') AS result, 'causal' AS insight_type,
      array_to_string(ids, ',') AS source_ids, NULL AS tags FROM c JOIN memories m ON m.id = c.root_id)
SELECT {_ID} AS id, * FROM i""")
def chain_insights(s, d):
    m = _m(s, d)
    return mining.chain_insights(mining.explicit_chains(m), m)


@query("temporal_insights", f"""WITH r AS ({ORACLE['temporal_recurrence']}),
i AS (SELECT 'Recurring ' || memory_type || ' pattern detected' AS context, occurrences || ' occurrences with ~' || printf('%.1f', interval_hours) || 'h interval' AS action,
      'Temporal pattern in ' || memory_type || ' memories' AS result, 'temporal' AS insight_type, '' AS source_ids, NULL AS tags FROM r)
SELECT {_ID} AS id, * FROM i""")
def temporal_insights(s, d):
    return mining.temporal_insights(mining.recurrence(_m(s, d)))
