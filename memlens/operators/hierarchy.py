"""Parent-child links of unknown depth to roots, depths, paths and descendants.

Frontiers grow from the roots: in round r every node knows its ancestor 2^r
links up, so a chain of depth d takes log2(d) joins and not d. A node whose walk
is still open beyond what the number of open walks allows is on, or leads into, a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlens.runtime import clean_key, cut

CYCLE = "cycle"


def linked(df: DataFrame, link: str, node: str = "id") -> DataFrame:
    """(id, parent): rows of ``df`` whose ``link`` names a row of it, blanks and case aside.

    Ids keep the spelling of their own row. Null and blank links and links that lead
    nowhere give no row. Of repeated ids the smallest link holds.
    """
    nodes = df.select(F.col(node).alias("id"), clean_key(F.col(node)).alias("key"), clean_key(F.col(link)).alias("up")).where("key is not null")
    nodes = nodes.groupBy("key").agg(F.min("id").alias("id"), F.min("up").alias("up"))
    named = nodes.select(F.col("key").alias("up"), F.col("id").alias("parent"))
    return nodes.join(named, "up").select("id", "parent")


def resolve_roots(edges: DataFrame, with_path: bool = False) -> DataFrame:
    """For edges (id, parent), one per id: id, root_id, depth (bigint), and path if asked for.

    ``path`` lists the walk from the node to its root, both included. A walk that never ends has root_id ``cycle``, depth -1 and a null
    path; paths are only built for walks that end.
    """
    ends = _walks(edges, False)
    if not with_path:
        return ends
    ends = cut(ends)
    whole = _walks(edges.join(ends.where("depth > 0").select("id"), "id", "left_semi"), True)
    return whole.unionByName(ends.where("depth < 0").withColumn("path", F.lit(None).cast("array<string>")))


def _walks(edges: DataFrame, with_path: bool) -> DataFrame:
    """Walks by doubling. What has ended stays in its files and is not written again; only open walks go on."""
    has_link = edges.select(F.col("id").alias("parent"), F.lit(True).alias("open"))
    path = [F.array("id", "parent").alias("path")] if with_path else []
    first = edges.join(has_link, "parent", "left").select("id", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("depth"), F.coalesce("open", F.lit(False)).alias("open"), *path)
    tables = [cut(first)]
    reach, still = 1, tables[0].where("open").count()
    # beside a walk of L links that ends, L - reach of its nodes are open too; so no open walk longer than this ends
    longest = still + reach
    while still and reach < longest:
        known = tables[-1]
        for t in tables[:-1]:
            known = known.unionByName(t.where("not open"))
        rest = [F.col("path").alias("rest")] if with_path else []
        far = known.select(F.col("id").alias("anc"), F.col("anc").alias("to"), F.col("depth").alias("more"), F.col("open").alias("still"), *rest)
        path = [F.concat("path", F.slice("rest", 2, F.size("rest"))).alias("path")] if with_path else []
        hopped = tables[-1].where("open").join(far, "anc").select("id", F.col("to").alias("anc"), (F.col("depth") + F.col("more")).alias("depth"), F.col("still").alias("open"), *path)
        tables.append(cut(hopped))
        reach *= 2
        still = tables[-1].where("open").count()
        longest = min(longest, still + reach)
    state = tables[-1]
    for t in tables[:-1]:
        state = state.unionByName(t.where("not open"))
    return state.select(
        "id",
        F.when(F.col("open"), CYCLE).otherwise(F.col("anc")).alias("root_id"),
        F.when(F.col("open"), F.lit(-1).cast("long")).otherwise(F.col("depth")).alias("depth"),
        *([F.when(~F.col("open"), F.col("path")).alias("path")] if with_path else []),
    )


def descendants(edges: DataFrame) -> DataFrame:
    """(ancestor_id, id, distance) for every ancestor on a walk that ends."""
    paths = resolve_roots(edges, with_path=True)
    return paths.select("id", F.posexplode("path").alias("distance", "ancestor_id")).where("distance > 0").select(
        "ancestor_id", "id", F.col("distance").cast("long").alias("distance")
    )
