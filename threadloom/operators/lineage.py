"""Lineage links between summaries and their sources, kept as an edge table.

Rows: thread_id, source_id, target_id, relation. A thread is a scope of its own;
a null thread and the empty one are the same scope.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.sources.storage import materialize

RELATION = "derived_from"
MAX_DEPTH = 100
EDGE = ["scope", "source_id", "target_id", "relation"]


def scoped(edges: DataFrame) -> DataFrame:
    return edges.withColumn("scope", F.coalesce(F.col("thread_id").cast("string"), F.lit("")))


def upsert(edges: DataFrame, new: DataFrame) -> DataFrame:
    """The edge table with new links; a link that is there already is replaced by the new one."""
    both = scoped(edges).withColumn("late", F.lit(0)).unionByName(scoped(new).withColumn("late", F.lit(1)))
    first = Window.partitionBy(*EDGE).orderBy(F.desc("late"))
    return both.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select(*edges.columns)


def parents(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links into the wanted (thread_id, entity_id)."""
    return _at(edges, wanted, "target_id")


def children(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links out of the wanted (thread_id, entity_id)."""
    return _at(edges, wanted, "source_id")


def _at(edges: DataFrame, wanted: DataFrame, side: str) -> DataFrame:
    keys = scoped(wanted).select("scope", F.col("entity_id").alias(side)).distinct()
    return scoped(edges).join(keys, ["scope", side], "left_semi").select(*edges.columns)


def walk(edges: DataFrame, wanted: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Rows (root_id, depth, edge): every upstream link of the wanted (thread_id, entity_id), at its least depth.

    Level by level: each step joins the newest sources with the links into them
    and drops sources that the root has met, so cycles end and each source is
    expanded once. Stops at an empty level or at max_depth. Each level is
    written to the shared folder, so no level is computed twice.
    """
    if isinstance(max_depth, bool) or not isinstance(max_depth, int) or max_depth < 1:
        raise ValueError("max_depth must be positive")
    links = scoped(edges).select(*EDGE, "thread_id").distinct()
    seen = scoped(wanted).select("scope", F.col("entity_id").alias("root_id"), F.col("entity_id").alias("met")).distinct()
    frontier, levels = seen, []
    for depth in range(1, max_depth + 1):
        level = frontier.join(links, (frontier["scope"] == links["scope"]) & (frontier["met"] == links["target_id"])).drop(frontier["scope"])
        levels.append(materialize(level.select("scope", "root_id", F.lit(depth).alias("depth"), "thread_id", "source_id", "target_id", "relation"), "level"))
        fresh = levels[-1].select("scope", "root_id", F.col("source_id").alias("met")).distinct()
        frontier = materialize(fresh.join(seen, ["scope", "root_id", "met"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return reduce(DataFrame.unionByName, levels).drop("scope")


WALK_SQL = """
WITH RECURSIVE walk(root_id, depth, thread_id, source_id, target_id, relation, path) AS (
  SELECT e.target_id, 1, e.thread_id, e.source_id, e.target_id, e.relation, array(e.target_id, e.source_id)
  FROM {edges} e JOIN {wanted} w ON w.entity_id = e.target_id AND w.thread_id <=> e.thread_id
  UNION ALL
  SELECT w.root_id, w.depth + 1, e.thread_id, e.source_id, e.target_id, e.relation, array_append(w.path, e.source_id)
  FROM walk w JOIN {edges} e ON e.target_id = w.source_id AND e.thread_id <=> w.thread_id
  WHERE w.depth < {max_depth} AND NOT array_contains(slice(w.path, 1, size(w.path) - 1), w.source_id))
SELECT root_id, min(depth) AS depth, thread_id, source_id, target_id, relation
FROM walk GROUP BY root_id, thread_id, source_id, target_id, relation
"""


def walk_sql(edges: DataFrame, wanted: DataFrame, max_depth: int = MAX_DEPTH - 1) -> DataFrame:
    """The same walk as one recursive query, for shallow graphs without many paths to a source."""
    return edges.sparkSession.sql(WALK_SQL.replace("{max_depth}", str(int(max_depth))), edges=edges, wanted=wanted)


def delete(edges: DataFrame, threads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edge table without the threads' links, and rows (thread_id, removed) of how many each lost."""
    keys = scoped(threads).select("scope").distinct()
    every = scoped(edges)
    gone = every.join(keys, "scope", "left_semi").groupBy("scope").agg(F.first("thread_id").alias("thread_id"), F.count("*").alias("removed"))
    return every.join(keys, "scope", "left_anti").select(*edges.columns), gone.select("thread_id", "removed")
