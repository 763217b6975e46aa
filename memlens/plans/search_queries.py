"""Queries of retrieval, routing, relevance and similarity mining, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlens.functions.text import has_tags, judge_tokens, merge_verdict, probe_text, query_terms, strip_thinking, word_count
from memlens.operators import consolidation as con
from memlens.operators import mining, ranking, routing
from memlens.plans.core_problems import ts_sql
from memlens.runtime import table
from memlens.sources.adapters import ASKED_SQL, DV_SQL, NUMBER_SQL, REWARDS_SQL, asked, field_vectors, number, reward_events, search_queries, searchable, wide_vectors

NOW = "2026-01-01T00:00:00Z"
HITS = 10
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


_Q = f"""qs AS (SELECT id AS query_id, regexp_extract_all(coalesce(action, ''), '[\\p{{L}}\\p{{Nl}}\\p{{N}}]+') AS words FROM memories WHERE {ASKED_SQL}),
qt AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, lower(unnest(words)) AS token FROM qs) GROUP BY 1, 2)"""
_BM = """dt AS (SELECT id, regexp_extract_all(lower(concat_ws(' ', context, action, result)), '[\\p{{L}}\\p{{N}}]+') AS t FROM memories),
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM dt),
po AS (SELECT id, term, len, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM dt) GROUP BY ALL),
tk AS (SELECT DISTINCT token FROM qt),
vm AS (SELECT token, term FROM (SELECT DISTINCT term FROM po) v JOIN tk ON starts_with(v.term, tk.token)),
tf AS (SELECT token, id, sum(tf) AS tf, any_value(len) AS len FROM vm JOIN po USING (term) GROUP BY 1, 2),
fd AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT tf.token, id, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS w FROM tf JOIN fd USING (token), st),
bm AS (SELECT query_id, id, -sum(w * times) AS rank FROM qt JOIN sc USING (token) GROUP BY 1, 2),
bt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9), id) AS pos FROM bm QUALIFY pos <= {k})"""
_KN = """qv AS (SELECT id AS query_id, vec FROM av WHERE field = 'context' AND id IN (SELECT query_id FROM qs)),
kn AS (SELECT query_id, id, max(list_cosine_similarity(qv.vec, dv.vec)) AS sim FROM qv, dv GROUP BY 1, 2),
kt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS pos FROM kn QUALIFY pos <= {k})"""
_FU = """fu AS (SELECT query_id, id, sum(s) AS score FROM (SELECT query_id, id, 0.7::DOUBLE / (60 + pos) AS s FROM kt UNION ALL SELECT query_id, id, 0.3::DOUBLE / (60 + pos) FROM bt) GROUP BY 1, 2),
fp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS place FROM fu)"""
_TEXT = f"{_Q}, {_BM.format(k=HITS)}"
_BOTH = f"{_TEXT}, {DV_SQL}, {_KN.format(k=HITS)}, {_FU}"


def _m(s, d):
    return table(s, d, "memories")


def _bm25(s, d, stem=False):
    return ranking.bm25(_m(s, d), ranking.query_tokens(search_queries(s, d), stem), HITS, stem)


def _three(s, d):
    return ranking.three_field(field_vectors(searchable(_m(s, d))), search_queries(s, d).select("query_id", "vec"), HITS)


@query("bm25_many", f"WITH {_TEXT} SELECT query_id, id, round(rank, 6) AS rank, CAST(pos AS INTEGER) AS pos FROM bt")
def bm25_many(s, d):
    return _bm25(s, d).select("query_id", "id", F.round("rank", 6).alias("rank"), "pos")


@query("bm25_stemmed")  # SQL has no stemmer; the tests compare with the full-text index it follows
def bm25_stemmed(s, d):
    return _bm25(s, d, True).select("query_id", "id", F.round("rank", 6).alias("rank"), "pos")


@query("index_update", f"""WITH {_TEXT} SELECT query_id, id, round(rank, 6) AS rank, CAST(pos AS INTEGER) AS pos FROM bt""".replace("FROM memories)", f"FROM memories WHERE {NUMBER_SQL.format('id')} % 7 <> 3)"))
def index_update(s, d):
    """A kept index of which rows leave and rows are written again finds what an index of the rest finds."""
    m = _m(s, d)
    n = number(F.col("id"))
    index = ranking.TextIndex.build(m.withColumn("context", F.when(n % 5 == 0, F.lit("to be written again")).otherwise(F.col("context"))), stem=False)
    index.update(m.where(n % 5 == 0).where(n % 7 != 3), m.where(n % 7 == 3).select("id"))
    tokens = ranking.query_tokens(search_queries(s, d), False)
    return ranking.bm25(ranking.TextIndex.open(s, index.path), tokens, HITS).select("query_id", "id", F.round("rank", 6).alias("rank"), "pos")


@query("knn_many", """WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS sim FROM q, embeddings e)
SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(id AS VARCHAR) AS id, round(sim, 6) AS sim, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, CAST(id AS VARCHAR)) AS INTEGER) AS pos FROM s
QUALIFY pos <= 10""")
def knn_many(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    return ranking.knn(e.select(F.col("vec_id").alias("id"), "vec"), q, HITS).select("query_id", "id", F.round("sim", 6).alias("sim"), "pos")


@query("three_field_knn", f"WITH {_Q}, {DV_SQL}, {_KN.format(k=HITS)} SELECT query_id, id, round(sim, 6) AS sim, CAST(pos AS INTEGER) AS pos FROM kt")
def three_field_knn(s, d):
    return _three(s, d).select("query_id", "id", F.round("sim", 6).alias("sim"), "pos")


@query("knn_recall", f"""WITH {_Q}, {DV_SQL}, {_KN.format(k=HITS)}, one AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(qv.vec, dv.vec), 9) DESC, id) AS pos FROM qv, dv WHERE field = 'context' QUALIFY pos <= 10)
SELECT round(avg(r), 9) AS recall FROM (SELECT query_id, (SELECT count(*) FROM one WHERE one.query_id = kt.query_id AND one.id IN (SELECT id FROM kt k2 WHERE k2.query_id = kt.query_id)) / 10.0 AS r FROM kt GROUP BY query_id)""")
def knn_recall(s, d):
    """How much of the three-field hits the context field alone finds."""
    q = search_queries(s, d).select("query_id", "vec")
    context = ranking.knn(field_vectors(searchable(_m(s, d)), ("context",)).select("id", "vec"), q, HITS)
    return ranking.recall_at(context, _three(s, d), HITS).select(F.round("recall", 9).alias("recall"))


@query("near_dup_lookup", f"""WITH {DV_SQL}, p AS (SELECT a.id AS query_id, b.id, a.field, list_cosine_similarity(a.vec, b.vec) AS sim
    FROM av a JOIN dv b ON a.field = b.field AND a.id <> b.id WHERE {NUMBER_SQL.format('a.id')} % 20 = 0),
m AS (SELECT query_id, id, min(sim) AS sim FROM p WHERE sim > 0.95 GROUP BY 1, 2 HAVING count(*) = 3)
SELECT query_id, id, round(sim, 6) AS sim FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) = 1""")
def near_dup_lookup(s, d):
    m = _m(s, d)
    questions = wide_vectors(asked(m)).withColumnRenamed("id", "query_id")
    return ranking.nearest_in_all(wide_vectors(searchable(m)), questions, ranking.TEXT_COLUMNS, 0.95).select("query_id", "id", F.round("sim", 6).alias("sim"))


@query("rrf_fuse", f"WITH {_BOTH} SELECT query_id, id, round(score, 9) AS score, CAST(place AS INTEGER) AS place FROM fp")
def rrf_fuse(s, d):
    return ranking.rrf(_three(s, d), _bm25(s, d)).select("query_id", "id", F.round("score", 9).alias("score"), "place")


@query("shadow_rewards", f"""WITH {_BOTH}, k AS (SELECT unnest([3, 5, 10, 20]) AS k)
SELECT query_id, k, round(sum(score) FILTER (place <= k) / sum(score), 9) AS reward FROM fp, k GROUP BY 1, 2""")
def shadow_rewards(s, d):
    return ranking.shadow_rewards(ranking.rrf(_three(s, d), _bm25(s, d))).select("query_id", "k", F.round("reward", 9).alias("reward"))


@query("rewards_json", f"""WITH {_BOTH}, k AS (SELECT unnest([3, 5, 10, 20]) AS k),
r AS (SELECT query_id, k, round(sum(score) FILTER (place <= k) / sum(score), 4) AS reward FROM fp, k GROUP BY 1, 2)
SELECT query_id, string_agg(k || ':' || printf('%.4f', reward), ',' ORDER BY k) AS told FROM r GROUP BY 1""")
def rewards_json(s, d):
    """The rewards as the routing log keeps them, read back."""
    kept = ranking.rewards_json(ranking.shadow_rewards(ranking.rrf(_three(s, d), _bm25(s, d))))
    each = F.from_json("shadow_rewards", "array<struct<k:int,reward:double>>")
    return kept.select("query_id", F.array_join(F.transform(each, lambda r: F.concat(r["k"].cast("string"), F.lit(":"), F.format_string("%.4f", F.round(r["reward"], 4)))), ",").alias("told"))


_SHOWN = "SELECT query_id, CAST(place AS INTEGER) AS place, m.id, round(fp.score, 9) AS rrf, m.memory_type, m.context, {degraded} AS degraded FROM fp JOIN memories m USING (id) WHERE place <= 10 AND superseded_by IS NULL"
_FULL = _SHOWN.format(degraded="query_id NOT IN (SELECT query_id FROM qv)")


def _shown(df):
    return df.select("query_id", "place", "id", F.round("rrf", 9).alias("rrf"), "memory_type", "context", "degraded")


def _search(s, d, **more):
    return ranking.search(_m(s, d), search_queries(s, d), field_vectors(searchable(_m(s, d))), HITS, stem=False, **more)


@query("hybrid_search", f"WITH {_BOTH} {_FULL}")
def hybrid_search(s, d):
    return _shown(_search(s, d))


@query("hybrid_stemmed")
def hybrid_stemmed(s, d):
    return _shown(ranking.search(_m(s, d), search_queries(s, d), field_vectors(searchable(_m(s, d))), HITS))


@query("degraded_search", f"""WITH {_TEXT}, kt AS (SELECT query_id, id, pos FROM bt WHERE false), {_FU} {_SHOWN.format(degraded='true')}""")
def degraded_search(s, d):
    return _shown(ranking.search(_m(s, d), search_queries(s, d), None, HITS, stem=False))


_HAS_TAG = """list_contains(list_transform(CASE WHEN tags LIKE '["%"]' AND json_valid(tags) AND NOT contains(tags, 'null,') AND NOT contains(tags, ', null') AND NOT contains(tags, ',null')
    THEN from_json(tags, '["varchar"]') END, lambda x: lower(x)), 'cache')"""


@query("tag_search", f"WITH {_BOTH} {_FULL} AND {_HAS_TAG}")
def tag_search(s, d):
    return _shown(_search(s, d, tags=["CACHE"]))


@query("search_envelope", f"""WITH {_BOTH}, h AS ({_FULL}), n AS (SELECT query_id, count(*) AS hits, string_agg(id, ',' ORDER BY place) AS ids FROM h GROUP BY 1)
SELECT query_id, coalesce(hits, 0) AS hits, coalesce(ids, '') AS ids, query_id NOT IN (SELECT query_id FROM qv) AS degraded FROM qs LEFT JOIN n USING (query_id)""")
def search_envelope(s, d):
    q = search_queries(s, d)
    told = ranking.envelope(_search(s, d), q, F.col("vec").isNull())
    r = F.from_json("response", "results array<struct<id:string>>, degraded boolean")
    return told.select("query_id", r.alias("r")).select("query_id", F.size("r.results").cast("long").alias("hits"), F.array_join("r.results.id", ",").alias("ids"), "r.degraded")


@query("diverse_hits")  # greedy in order of similarity; the tests have a plain version
def diverse_hits(s, d):
    v = field_vectors(searchable(_m(s, d)), ("context",)).select("id", "vec")
    hits = ranking.knn(v, search_queries(s, d).select("query_id", "vec"), 20)
    return ranking.diverse(hits, v, 5).select("query_id", "id", F.round("sim", 6).alias("sim"), "pos")


@query("tag_filter", f"SELECT id FROM memories WHERE {_HAS_TAG}")
def tag_filter(s, d):
    return table(s, d, "memories").where(has_tags(F.col("tags"), ["Cache"])).select("id")


@query("sanitize_queries", """SELECT doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{Nl}\\p{N}]+'), ' ') AS terms,
    regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{Nl}\\p{N}\\s]', '', 'g') AS probe,
    CAST(len(str_split_regex(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), '\\s+')) * CAST(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') <> '' AS INTEGER) AS INTEGER) AS words
FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '\\p{M}')""")  # engines differ in which marks are letters
def sanitize_queries(s, d):
    docs = table(s, d, "documents").where(~F.coalesce("text", F.lit("")).rlike(r"\p{M}"))
    return docs.select("doc_id", F.array_join(query_terms(F.col("text")), " ").alias("terms"), probe_text(F.col("text")).alias("probe"), word_count(F.col("text")).alias("words"))


@query("reply_parsing", """WITH r AS (SELECT id, lower(trim(action)) AS a, coalesce(reason, '') AS why FROM (SELECT id, any_value(action) AS action, min(reason) AS reason FROM consolidation_log GROUP BY id)),
p AS (SELECT id, CASE WHEN a = 'merge' THEN ' Merge ' ELSE 'KEEP_BOTH ' END || why AS said FROM r)
SELECT id, regexp_replace(said, '^\\s+|\\s+$', '', 'g') AS said, CASE WHEN starts_with(said, ' Merge') THEN 'merge' ELSE 'keep' END AS verdict FROM p""")
def reply_parsing(s, d):
    """Replies made from the audit rows, behind a thinking part that mentions the other verdict."""
    log = table(s, d, "consolidation_log").groupBy("id").agg(F.first("action").alias("action"), F.min("reason").alias("reason"))
    said = F.concat(F.when(F.lower(F.trim("action")) == "merge", " Merge ").otherwise("KEEP_BOTH "), F.coalesce("reason", F.lit("")))
    reply = strip_thinking(F.concat(F.lit("<think>MERGE? </think> KEEP?</think>"), said))
    return log.select("id", reply.alias("said"), merge_verdict(reply).alias("verdict"))


# -- text probes (every row asks with its own context)

@query("fts_probe_top5", f"""WITH qt AS (SELECT query_id, token, count(*) AS times FROM (SELECT id AS query_id, lower(unnest(regexp_extract_all(regexp_replace(context, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\s]', '', 'g'), '[\\p{{L}}\\p{{Nl}}\\p{{N}}]+'))) AS token
    FROM memories WHERE superseded_by IS NULL AND memory_type <> 'insight') GROUP BY 1, 2), {_BM.format(k=5)}
SELECT query_id AS probe_id, id, round(rank, 6) AS rank FROM bt WHERE query_id <> id AND id IN (SELECT id FROM memories WHERE superseded_by IS NULL AND memory_type <> 'insight')""")
def fts_probe_top5(s, d):
    return con.text_probes(_m(s, d), stem=False).select("probe_id", "id", F.round("rank", 6).alias("rank"))


@query("fts_dup_groups")
def fts_dup_groups(s, d):
    m = _m(s, d)
    return con.text_groups(m, con.text_probes(m))


# -- routing

_WORDS = {m: "[" + ", ".join(f"'{w}'" for w in ws) + "]" for m, ws in routing.MODE_WORDS.items()}
_MODE = "CASE " + " ".join(f"WHEN list_has_any(w, {ws}) THEN '{m}'" for m, ws in _WORDS.items()) + " ELSE 'routine' END"
_ASKED = "['bug', 'plan', 'design', 'review', 'implement', 'update', 'nothing'][doc_id % 7 + 1]"


@query("mode_detect", f"SELECT doc_id, {_MODE} AS mode FROM (SELECT doc_id, str_split_regex(lower({_ASKED} || ' ' || coalesce(text, '')), '\\s+') AS w FROM documents)")
def mode_detect(s, d):
    words = F.element_at(F.array(*[F.lit(w) for w in ("bug", "plan", "design", "review", "implement", "update", "nothing")]), (F.col("doc_id") % 7 + 1).cast("int"))
    text = F.concat(words, F.lit(" "), F.coalesce("text", F.lit("")))
    return table(s, d, "documents").select("doc_id", routing.detect_mode(text).alias("mode"))


_DEFAULTS = ", ".join(f"('{m}', '{a}', '{b}', '{c}', '{p}', {t}, {lo}, {hi})" for m, a, b, c, p, _, t, lo, hi in routing.MODE_DEFAULTS)


@query("mode_defaults_join", f"""SELECT query_id, mode, r.top_k, d.lo AS top_k_min, d.hi AS top_k_max, r.search_strategy = d.s AS usual FROM (SELECT *, lower(trim(mode)) AS m FROM routing_log) r
JOIN (VALUES {_DEFAULTS}) d(name, s, l, c, p, t, lo, hi) ON d.name = r.m""".replace("SELECT query_id, mode,", "SELECT query_id, r.m AS mode,"))
def mode_defaults_join(s, d):
    r = table(s, d, "routing_log").select("query_id", routing.parse_mode(F.col("mode")).alias("mode"), "top_k", F.col("search_strategy").alias("used"))
    j = r.join(F.broadcast(routing.mode_defaults(s)), "mode")
    return j.select("query_id", "mode", "top_k", "top_k_min", "top_k_max", (F.col("used") == F.col("search_strategy")).alias("usual"))


_FOLD = f"""{REWARDS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY router_level, state, action ORDER BY seq DESC) - 1 AS back FROM rw WHERE reward IS NOT NULL),
q AS (SELECT router_level, state, action, sum(0.1::DOUBLE * pow(0.9::DOUBLE, back) * reward) AS value, count(*) AS update_count FROM b GROUP BY 1, 2, 3)"""


@query("bandit_fold", f"WITH {_FOLD} SELECT router_level, state, action, round(value, 6) AS value, update_count FROM q")
def bandit_fold(s, d):
    return routing.fold_rewards(reward_events(s, d)).withColumn("value", F.round("value", 6))


@query("bandit_argmax", f"WITH {_FOLD} SELECT state, arg_max(action, value) AS action FROM q GROUP BY 1")
def bandit_argmax(s, d):
    return routing.best_actions(routing.fold_rewards(reward_events(s, d))).select("state", "action")


@query("router_decide", f"""WITH {_FOLD}, best AS (SELECT state, arg_max(action, value) AS action FROM q GROUP BY 1)
SELECT query_id, m AS mode, coalesce(best.action, d.s) AS search_strategy, d.l AS llm_selection, CAST(coalesce(r.top_k, d.lo) AS INTEGER) AS top_k FROM (SELECT *, lower(trim(mode)) AS m FROM routing_log) r
JOIN (VALUES {_DEFAULTS}) d(name, s, l, c, p, t, lo, hi) ON d.name = r.m LEFT JOIN best ON best.state = r.m""")
def router_decide(s, d):
    q = table(s, d, "routing_log").select("query_id", routing.parse_mode(F.col("mode")).alias("mode"), "top_k").where("mode is not null")
    return routing.decide(q, routing.fold_rewards(reward_events(s, d))).select("query_id", "mode", "search_strategy", "llm_selection", "top_k")


@query("q_panel", f"""WITH {_FOLD} SELECT state, round(coalesce(max(value) FILTER (action = 'high_threshold'), 0), 6) AS high_threshold, round(coalesce(max(value) FILTER (action = 'low_threshold'), 0), 6) AS low_threshold,
    CAST((SELECT sum(update_count) FROM q) AS BIGINT) AS updates FROM q GROUP BY 1""")
def q_panel(s, d):
    p = routing.q_panel(routing.fold_rewards(reward_events(s, d)))
    return p.select("state", F.round("high_threshold", 6).alias("high_threshold"), F.round("low_threshold", 6).alias("low_threshold"), "updates")


@query("spread_rewards", """WITH r AS (SELECT lower(trim(mode)) AS state, search_strategy, llm_selection, contextualization, proactivity FROM routing_log)
SELECT router_level, state, action, count(*) AS n FROM (SELECT 'search' AS router_level, state, search_strategy AS action FROM r UNION ALL SELECT 'llm', state, llm_selection FROM r
UNION ALL SELECT 'context', state, contextualization FROM r UNION ALL SELECT 'proactivity', state, proactivity FROM r) GROUP BY 1, 2, 3""")
def spread_rewards(s, d):
    r = table(s, d, "routing_log").withColumn("mode", routing.parse_mode(F.col("mode"))).withColumn("reward", F.lit(1.0)).withColumn("seq", F.lit(0))
    return routing.spread_rewards(r).groupBy("router_level", "state", "action").agg(F.count("*").alias("n"))


@query("heuristic_judge", f"""WITH t AS (SELECT id, regexp_extract_all(lower(action), '[\\p{{L}}\\p{{N}}]+') AS q, regexp_extract_all(lower(concat_ws(' ', context, result)), '[\\p{{L}}\\p{{N}}]+') AS w,
    coalesce(CASE WHEN regexp_full_match(updated_at, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ') THEN greatest(epoch(TIMESTAMP '2026-01-01' - CAST(replace(replace(updated_at, 'T', ' '), 'Z', '') AS TIMESTAMP)), 0) / 86400.0 END, 0) AS days,
    coalesce(used_count, 0) AS used FROM memories),
k AS (SELECT *, CASE WHEN len(q) = 0 THEN 0 ELSE len(list_filter(q, lambda x: list_contains(w, x))) / len(q) END AS keyword FROM t)
SELECT id, round(least(greatest(0.4::DOUBLE * keyword + 0.3::DOUBLE * exp(-days / 30.0) + 0.3::DOUBLE * least(used / 10.0, 1.0), 0), 1), 6) AS score FROM k""")
def heuristic_judge(s, d):
    """Each row asks with its action and is judged by its other texts."""
    m = _m(s, d)
    days = routing.days_since(F.col("updated_at"), F.lit(NOW).cast("timestamp"))
    score, _ = routing.judge(F.col("action"), F.concat_ws(" ", "context", "result"), days, F.col("used_count"))
    return m.select("id", F.round(score, 6).alias("score"))


# -- similarity mining

# four weeks in place of six hours, as rows that are alike lie days apart in these tables
@query("implicit_edges", f"""WITH {DV_SQL}, r AS (SELECT m.id, {ts_sql('m.created_at')} AS ts, vec FROM memories m JOIN av ON av.id = m.id AND field = 'context' WHERE superseded_by IS NULL AND memory_type <> 'insight')
SELECT a.id AS a, b.id AS b, epoch(b.ts - a.ts) / 3600.0 AS gap_hours, round(list_cosine_similarity(a.vec, b.vec), 6) AS similarity
FROM r a JOIN r b ON (b.ts > a.ts OR b.ts = a.ts AND b.id > a.id) AND b.ts <= a.ts + INTERVAL 672 HOUR WHERE list_cosine_similarity(a.vec, b.vec) >= 0.7""")
def implicit_edges(s, d):
    return mining.implicit_edges(_usable(s, d), 672).select("a", "b", "gap_hours", F.round("similarity", 6).alias("similarity"))


def _usable(s, d):
    """Memories whose context blob is null where it is not usable."""
    from memlens.functions.vectors import usable_vector
    from memlens.sources.adapters import DIM

    m = _m(s, d).select("id", "memory_type", "context", "action", "result", "parent_id", "created_at", "superseded_by", "embedding_context")
    return m.withColumn("embedding_context", F.when(usable_vector(F.col("embedding_context"), DIM).isNotNull(), F.col("embedding_context")))


@query("implicit_chains")
def implicit_chains(s, d):
    return mining.implicit_chains(_usable(s, d), 672)


@query("all_chains")
def all_chains(s, d):
    return mining.chains(_usable(s, d), 672)


def _context_vectors(s, d):
    return field_vectors(_m(s, d), ("context",)).select("id", "vec")


_KINDS = f"WITH {DV_SQL}, k AS (SELECT vec, min(id) AS class FROM av WHERE field = 'context' GROUP BY vec)"


@query("cluster_classes", f"{_KINDS} SELECT class, id FROM av JOIN k USING (vec) WHERE field = 'context'")
def cluster_classes(s, d):
    return ranking.vector_classes(_context_vectors(s, d), mining.CLUSTER_SIMILARITY)[0].select("class", "id")


@query("cluster_edges", f"""{_KINDS} SELECT a.class AS a, b.class AS b, round(list_cosine_similarity(a.vec, b.vec), 6) AS similarity
FROM k a JOIN k b ON a.class < b.class WHERE list_cosine_similarity(a.vec, b.vec) >= 0.85""")
def cluster_edges(s, d):
    """Pairs of classes of equal vectors; cluster_classes has the members."""
    links = ranking.vector_classes(_context_vectors(s, d), mining.CLUSTER_SIMILARITY)[1]
    return links.where("a < b").select("a", "b", F.round("sim", 6).alias("similarity"))


def _linkage(s, d):
    own = mining.training_rows(_usable(s, d)).where("embedding_context is not null")
    return mining.average_linkage_clusters(own, ranking.near_links(_context_vectors(s, d).join(own.select("id"), "id", "left_semi"), mining.CLUSTER_SIMILARITY))


@query("average_linkage")
def average_linkage(s, d):
    return _linkage(s, d)


@query("cluster_insights")
def cluster_insights(s, d):
    return mining.cluster_insights(_linkage(s, d), _m(s, d))
