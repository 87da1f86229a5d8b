"""Queries over references and hierarchies (problems 2 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.operators import hierarchy, orphans
from loomgraph.sources.tables import table

PARENT_TABLES = ("symbols", "code_file", "backlog_item")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphans(table(spark, folder, "edges"), [table(spark, folder, t) for t in PARENT_TABLES])


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(p2_found(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.forest(table(spark, folder, "commit_node"))


def p6_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.ancestors(table(spark, folder, "commit_node"))


def p6_paths(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.paths(table(spark, folder, "commit_node"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p6_found": p6_found, "p6_descendants": p6_descendants, "p6_paths": p6_paths}

_P2 = """
WITH parents AS (
  SELECT id, loaded_at, deleted_at FROM symbols UNION ALL
  SELECT id, loaded_at, deleted_at FROM code_file UNION ALL
  SELECT id, loaded_at, deleted_at FROM backlog_item),
refs AS (
  SELECT DISTINCT edge_id, 'src' AS ref_end, src AS ref_id, created_at FROM edges UNION ALL
  SELECT DISTINCT edge_id, 'dst' AS ref_end, dst AS ref_id, created_at FROM edges),
judged AS (
  SELECT r.edge_id, r.ref_end, r.ref_id, r.created_at,
    count(p.id) AS known,
    count(*) FILTER (WHERE p.loaded_at <= r.created_at) AS seen,
    count(*) FILTER (WHERE p.loaded_at <= r.created_at AND (p.deleted_at IS NULL OR p.deleted_at > r.created_at)) AS alive
  FROM refs r LEFT JOIN parents p ON p.id = r.ref_id
  WHERE r.ref_id IS NOT NULL AND trim(r.ref_id) <> ''
  GROUP BY ALL),
found AS (
  SELECT edge_id, ref_end,
    CASE WHEN contains(ref_id, ':') THEN split_part(ref_id, ':', 1) ELSE 'unknown' END AS ref_table,
    coalesce(strftime(created_at, '%Y-%m'), 'none') AS period,
    CASE WHEN known = 0 THEN 'missing' WHEN seen > 0 THEN 'deleted' ELSE 'late' END AS ref_state
  FROM judged WHERE alive = 0 AND (known = 0 OR created_at IS NOT NULL))
"""

_P6 = """
WITH RECURSIVE nodes AS (
  SELECT lower(trim(hash)) AS node, min(hash) AS hash,
    min(lower(trim(list_filter(parent_hashes, lambda p: p IS NOT NULL AND trim(p) <> '')[1]))) AS parent
  FROM commit_node WHERE trim(hash) <> '' GROUP BY 1),
tree AS (
  SELECT node, hash, hash AS root_hash, 0 AS depth, [hash] AS path FROM nodes
  WHERE parent IS NULL OR parent NOT IN (SELECT node FROM nodes)
  UNION ALL
  SELECT n.node, n.hash, t.root_hash, t.depth + 1, list_append(t.path, n.hash) FROM nodes n JOIN tree t ON n.parent = t.node)
"""

SQL = {
    "p2_found": _P2 + "SELECT DISTINCT * FROM found",
    "p2_report": _P2 + "SELECT ref_table, period, ref_state, count(*) AS refs, count(DISTINCT edge_id) AS edges FROM (SELECT DISTINCT * FROM found) GROUP BY ALL",
    "p6_found": _P6 + "SELECT hash, root_hash, depth FROM tree UNION ALL SELECT hash, '', -1 FROM nodes WHERE node NOT IN (SELECT node FROM tree)",
    "p6_descendants": _P6 + "SELECT hash, unnest(path[1:depth]) AS ancestor, unnest(range(depth, 0, -1))::INTEGER AS distance FROM tree WHERE depth > 0",
    "p6_paths": _P6 + "SELECT hash, path FROM tree",
}
