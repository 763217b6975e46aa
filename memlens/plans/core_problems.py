"""Queries of the general data problems (packed fields, orphans, hierarchies) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlens.functions.packed import explode_packed
from memlens.operators.hierarchy import linked, resolve_roots
from memlens.operators.references import memory_references, missing_references, parent_keys
from memlens.runtime import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = table(spark, sf_dir, "memories").select("id", "tags", "source_ids")
    log = table(spark, sf_dir, "consolidation_log").select("id", "memory_ids")
    own = explode_packed(memories, {"memories.tags": ("tags", "tag"), "memories.source_ids": ("source_ids", "id")})
    once = log.groupBy("id").agg(F.min("memory_ids").alias("memory_ids"))
    return own.unionByName(explode_packed(once, {"consolidation_log.memory_ids": ("memory_ids", "id")}))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories, feedback = table(spark, sf_dir, "memories"), table(spark, sf_dir, "feedback_tracking")
    return missing_references(memory_references(memories, feedback), parent_keys(memories))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = table(spark, sf_dir, "memories").select("id", "parent_id", "superseded_by")
    # both link fields at once: an edge's ids carry the field's name
    tagged = None
    for link in ("parent_id", "superseded_by"):
        edges = linked(memories, link).select(F.concat(F.lit(f"{link}:"), "id").alias("id"), F.concat(F.lit(f"{link}:"), "parent").alias("parent"))
        tagged = edges if tagged is None else tagged.unionByName(edges)
    return resolve_roots(tagged).select(
        F.substring_index("id", ":", 1).alias("link_field"),
        F.expr("substr(id, instr(id, ':') + 1)").alias("id"),
        F.when(F.col("depth") < 0, F.col("root_id")).otherwise(F.expr("substr(root_id, instr(root_id, ':') + 1)")).alias("root_id"),
        "depth",
    )


QUERIES = {"p3_found": p3_found, "p5_found": p5_found, "p7_found": p7_found}

# One regular expression takes quoted spans or runs of the characters a bare value may have.
_UNWRAP = """CASE WHEN regexp_full_match({0}, '\\s*"([^"\\\\]|\\\\.)*"\\s*', 's') AND regexp_matches(json_extract_string(trim({0}), '$'), '^\\s*[\\[{{"]')
             THEN json_extract_string(trim({0}), '$') ELSE {0} END"""
_ITEM = """trim(CASE
    WHEN x[1] = '"' THEN coalesce(json_extract_string(TRY_CAST('"' || replace(x[2:-2], '""', '\\"') || '"' AS JSON), '$'), x[2:-2])
    WHEN x[1] = '''' THEN x[2:-2] ELSE x END)"""


def _values(kind: str) -> str:
    bare = "[\\p{L}\\p{M}\\p{N}+#./\\-_:]+" + ("(?: [\\p{L}\\p{M}\\p{N}+#./\\-_:]+)*" if kind == "tag" else "")
    quoted = '"(?:[^"\\\\]|\\\\.|"")*"|' + "''(?:[^''\\\\]|\\\\.)*''"
    return (
        f"list_filter(list_transform(list_filter(regexp_extract_all(replace(t, '->', ','), '{quoted}|{bare}', 0, 's'), lambda x: lower(x) <> 'null'),"
        f" lambda x: {_ITEM}), lambda x: x <> '')"
    )


def _packed_sql(name: str, source: str, column: str, kind: str) -> str:
    first = _UNWRAP.format(column)
    return f"""SELECT '{name}' AS field_name, record_id, CAST(pos AS BIGINT) AS pos, v[pos] AS item
FROM (SELECT record_id, v, unnest(range(1, len(v) + 1)) AS pos
      FROM (SELECT record_id, {_values(kind)} AS v
            FROM (SELECT record_id, {_UNWRAP.format('t1')} AS t FROM (SELECT id AS record_id, {first} AS t1 FROM {source})) b) c) d"""


_SOURCES = _packed_sql("s", "memories", "source_ids", "id")

def _key(column: str) -> str:
    return f"lower(regexp_replace({column}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"


def ts_sql(column: str) -> str:
    """A text time as a UTC timestamp in DuckDB; without an offset it is UTC."""
    full = f"CASE WHEN regexp_matches({column}, '(Z|[+-]\\d\\d:?\\d\\d)$') THEN {column} ELSE {column} || 'Z' END"
    return f"make_timestamp(epoch_us(CAST({full} AS TIMESTAMPTZ)))"


ORACLE = {
    "p3_found": "\nUNION ALL\n".join(
        (
            _packed_sql("memories.tags", "memories", "tags", "tag"),
            _packed_sql("memories.source_ids", "memories", "source_ids", "id"),
            _packed_sql(
                "consolidation_log.memory_ids", "(SELECT id, min(memory_ids) AS memory_ids FROM consolidation_log GROUP BY id)", "memory_ids", "id"
            ),
        )
    ),
    "p5_found": f"""WITH refs AS (
    SELECT 'memories.parent_id' AS ref_field, parent_id AS k, created_at AS seen FROM memories
    UNION ALL SELECT 'memories.superseded_by', superseded_by, created_at FROM memories
    UNION ALL SELECT 'memories.source_ids', s.item, m.created_at FROM ({_SOURCES}) s JOIN memories m ON m.id = s.record_id
    UNION ALL SELECT 'feedback_tracking.memory_id', memory_id, searched_at FROM feedback_tracking)
SELECT DISTINCT ref_field, {_key('k')} AS missing_id, strftime({ts_sql('seen')}, '%Y-%m') AS ref_month
FROM refs WHERE {_key('k')} <> '' AND {_key('k')} NOT IN (SELECT {_key('id')} FROM memories)""",
    "p7_found": f"""WITH RECURSIVE n AS (SELECT id, {_key('id')} AS k, {_key('parent_id')} AS p, {_key('superseded_by')} AS s FROM memories),
e AS (SELECT 'parent_id' AS link_field, a.id, b.id AS up FROM n a JOIN n b ON a.p = b.k
      UNION ALL SELECT 'superseded_by', a.id, b.id FROM n a JOIN n b ON a.s = b.k),
roots AS (SELECT DISTINCT e.link_field, e.up AS id FROM e LEFT JOIN e x ON x.link_field = e.link_field AND x.id = e.up WHERE x.id IS NULL),
walk AS (SELECT link_field, id, id AS root_id, 0 AS depth FROM roots
         UNION ALL SELECT e.link_field, e.id, w.root_id, w.depth + 1 FROM walk w JOIN e ON e.link_field = w.link_field AND e.up = w.id)
SELECT e.link_field, e.id, coalesce(w.root_id, 'cycle') AS root_id, CAST(coalesce(w.depth, -1) AS BIGINT) AS depth
FROM e LEFT JOIN walk w ON w.link_field = e.link_field AND w.id = e.id""",
}
