"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlens.llm.clusters import clusters, describe
from memlens.llm.history import History
from memlens.llm.leaks import leaks, report
from memlens.llm.neighbours import nearest
from memlens.llm.reading import fit, reading_levels
from memlens.llm.setjoin import near_duplicates
from memlens.llm.tokens import encode
from memlens.llm.vectors import FIELDS
from memlens.runtime import table
from memlens.sources.adapters import DV_SQL


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    history, intake = History(table(spark, sf_dir, "memories")), table(spark, sf_dir, "memory_intake")
    found = intake.select("arrival_no").limit(0)
    for batch in intake.select("batch_no").distinct().orderBy("batch_no").collect():  # as they came in, each against all before
        found = found.unionByName(history.absorb(intake.where(F.col("batch_no").eqNullSafe(batch[0])), ["batch_no", "arrival_no"]).select("arrival_no"))
    return found


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "memories"), {f: f"embedding_{f}" for f in FIELDS})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "memories"), ["context", "action", "result"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(table(spark, sf_dir, "memories"), "embedding_context")
    return found.where(F.col("cluster_id") != F.col("id")).select("cluster_id", "id")


def p6_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster with its size and its three densest members."""
    told = describe(clusters(table(spark, sf_dir, "memories"), "embedding_context"))
    return told.select("cluster_id", "size", F.array_join("typical", ",").alias("typical"))


def p6_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many others lie within the threshold of each clustered memory."""
    return clusters(table(spark, sf_dir, "memories"), "embedding_context").select("id", "density")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of which a document holds half of the words or more, wherever they stand in it."""
    return report(leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), coverage=0.5))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return reading_levels(docs, fit(docs, table(spark, sf_dir, "reading_labels")))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p4_found, p6_found, p6_described, p6_density, p8_ids, p9_found, p9_report, p10_found)}

_NEAR = f"""{DV_SQL}, n AS (SELECT a.id, b.id AS other FROM av a JOIN av b ON a.field = 'context' AND b.field = 'context' AND a.id <> b.id WHERE list_cosine_similarity(a.vec, b.vec) >= 0.85),
reach AS (SELECT id, other FROM n UNION SELECT r.id, n.other FROM reach r JOIN n ON n.id = r.other),
c AS (SELECT id, min(least(id, other)) AS cluster_id FROM reach GROUP BY id), d AS (SELECT id, count(*) AS density FROM n GROUP BY id)"""
_WIDE = """SELECT {key}, max(vec) FILTER (field = 'context') AS c, max(vec) FILTER (field = 'action') AS a, max(vec) FILTER (field = 'result') AS r FROM {rows} GROUP BY {key} HAVING count(*) = 3"""
_CLOSE = " AND ".join(f"list_cosine_similarity(x.{f}, y.{f}) > 0.95" for f in "car")
_INTAKE = DV_SQL.split(",\ndv AS")[0].replace("av AS", "iv AS").replace("FROM memories", "FROM memory_intake").replace(" id, indexed AND superseded_by IS NULL AS live", " batch_no, arrival_no, 0 AS live").replace(" id, indexed AND superseded_by IS NULL", " batch_no, arrival_no, 0").replace("SELECT field, id, live, vec", "SELECT field, batch_no, arrival_no, vec")

ORACLE: dict[str, str] = {
    "p1_found": f"""WITH RECURSIVE {DV_SQL}, {_INTAKE}, h AS ({_WIDE.format(key='id', rows='av')}), i AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY batch_no, arrival_no) AS n FROM ({_WIDE.format(key='batch_no, arrival_no', rows='iv')})),
old AS MATERIALIZED (SELECT DISTINCT x.n FROM i x JOIN h y ON {_CLOSE}), early AS MATERIALIZED (SELECT x.n, list(y.n) AS near FROM i x JOIN i y ON y.n < x.n AND {_CLOSE} GROUP BY x.n),
step AS MATERIALIZED (SELECT i.n, i.n IN (SELECT n FROM old) AS known, coalesce(early.near, []) AS near FROM i LEFT JOIN early ON early.n = i.n),
run AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS cases UNION ALL
    SELECT s.n, CASE WHEN s.known OR len(list_filter(s.near, lambda m: NOT list_contains(run.cases, m))) > 0 THEN list_append(run.cases, s.n) ELSE run.cases END FROM run JOIN step s ON s.n = run.n + 1)
SELECT arrival_no FROM i WHERE list_contains((SELECT cases FROM run ORDER BY n DESC LIMIT 1), i.n)""",
    "p2_found": f"""WITH {DV_SQL} SELECT a.field AS field_name, a.id, b.id AS neighbour_id FROM av a JOIN av b ON a.field = b.field AND a.id <> b.id WHERE list_cosine_similarity(a.vec, b.vec) >= 0.85
QUALIFY row_number() OVER (PARTITION BY a.field, a.id ORDER BY round(list_cosine_similarity(a.vec, b.vec), 12) DESC, b.id) <= 5""",
    "p4_found": """WITH w AS (SELECT id, unnest(regexp_extract_all(lower(concat_ws(' ', context, action, result)), '[\\p{L}\\p{Nd}]+')) AS word FROM memories),
t AS (SELECT id, word, count(*) AS c, sum(count(*)) OVER (PARTITION BY id) AS n FROM w GROUP BY id, word),
p AS (SELECT a.id AS id_a, b.id AS id_b, sum(least(a.c, b.c)) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM t a JOIN t b ON a.word = b.word AND a.id < b.id AND a.n >= 12 AND b.n >= 12 GROUP BY a.id, b.id)
SELECT id_a, id_b FROM p WHERE common / (na + nb - common) >= 0.75""",
    "p6_found": f"WITH RECURSIVE {_NEAR} SELECT cluster_id, id FROM c WHERE cluster_id <> id",
    "p6_described": f"""WITH RECURSIVE {_NEAR}, t AS (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY density DESC, id) AS k FROM c JOIN d USING (id))
SELECT cluster_id, count(*) AS size, string_agg(id, ',' ORDER BY k) FILTER (k <= 3) AS typical FROM t GROUP BY 1""",
    "p6_density": f"WITH {_NEAR.split(',' + chr(10) + 'reach')[0]} SELECT id, count(*) AS density FROM n GROUP BY id",
}
