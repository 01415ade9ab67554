"""Queries of the two general problems: hierarchies and orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import hierarchy as hi
from tessera.operators import orphans as orp
from tessera.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    refs = hi.inherits_edges(table(spark, d, "node_references"))
    return hi.hierarchy(refs, "from_node_id", "to_node_id").select("node_id", "root_id", "depth")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    refs = hi.inherits_edges(table(spark, d, "node_references"))
    return hi.descendants(hi.hierarchy(refs, "from_node_id", "to_node_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return orp.find_orphans(t("node_references"), t("cross_references"), t("tree_nodes"), t("shared_symbols"), t("packages"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orp.orphan_report(p5_found(spark, d))


_EDGES = """
edges AS (
  SELECT DISTINCT trim(from_node_id, E' \\t\\n\\r') AS child, trim(to_node_id, E' \\t\\n\\r') AS parent
  FROM node_references
  WHERE lower(trim(kind, E' \\t\\n\\r')) = 'inherits'
    AND trim(from_node_id, E' \\t\\n\\r') <> '' AND trim(to_node_id, E' \\t\\n\\r') <> ''),
nodes AS (SELECT child AS n FROM edges UNION SELECT parent FROM edges),
up AS (
  SELECT child AS n, parent AS a FROM edges
  UNION
  SELECT up.n, e.parent FROM up JOIN edges e ON up.a = e.child)
"""

_ORPHANS = """
refs AS (
  SELECT 'node_references' AS source_table, ref_id, '' AS proj, captured_at AS at,
    CASE WHEN trim(coalesce(to_node_id, ''), E' \\t\\n\\r') <> '' THEN trim(to_node_id, E' \\t\\n\\r')
         WHEN split_part(trim(to_name, E' \\t\\n\\r'), '.', 1) IN (SELECT trim(import_name, E' \\t\\n\\r') FROM packages WHERE import_name IS NOT NULL)
         THEN trim(to_name, E' \\t\\n\\r') END AS node
  FROM node_references
  UNION ALL
  SELECT 'cross_references', ref_id, trim(to_project, E' \\t\\n\\r'), linked_at, trim(to_node_id, E' \\t\\n\\r') FROM cross_references),
idx AS (
  SELECT p.proj, p.node, bool_or(deleted_at IS NULL) AS alive, min(indexed_at) AS first_indexed FROM (
    SELECT '' AS proj, trim(node_id, E' \\t\\n\\r') AS node, deleted_at, indexed_at FROM tree_nodes
    UNION ALL SELECT trim(project, E' \\t\\n\\r'), trim(node_id, E' \\t\\n\\r'), deleted_at, indexed_at FROM tree_nodes) p
  GROUP BY 1, 2),
fixed AS (
  SELECT '' AS proj, trim(node_id, E' \\t\\n\\r') AS node FROM shared_symbols
  UNION SELECT trim(project, E' \\t\\n\\r'), trim(node_id, E' \\t\\n\\r') FROM shared_symbols),
judged AS (
  SELECT r.source_table, r.ref_id, coalesce(strftime(r.at, '%Y-%m'), 'unknown') AS period,
    CASE WHEN f.node IS NOT NULL THEN NULL WHEN i.node IS NULL THEN 'missing' WHEN NOT i.alive THEN 'deleted'
         WHEN i.first_indexed > r.at THEN 'late' END AS state
  FROM refs r LEFT JOIN idx i ON i.proj = r.proj AND i.node = r.node LEFT JOIN fixed f ON f.proj = r.proj AND f.node = r.node
  WHERE r.node IS NOT NULL AND r.node <> ''),
found AS (SELECT DISTINCT source_table, ref_id, state, period FROM judged WHERE state IS NOT NULL)
"""

QUERIES = {"p4_found": p4_found, "p4_descendants": p4_descendants, "p5_found": p5_found, "p5_report": p5_report}

SQL = {
    "p4_found": f"""WITH RECURSIVE {_EDGES},
ring AS (SELECT n FROM up WHERE n = a),
roots AS (SELECT n FROM nodes WHERE n NOT IN (SELECT child FROM edges)),
cyc AS (SELECT x.n, min(r.n) AS root_id FROM (SELECT n, a FROM up UNION SELECT n, n FROM nodes) x JOIN ring r ON r.n = x.a GROUP BY x.n)
SELECT k.n AS node_id,
  coalesce(c.root_id, CASE WHEN r.n IS NOT NULL THEN k.n ELSE m.root_id END) AS root_id,
  CAST(CASE WHEN c.n IS NOT NULL THEN -1 ELSE coalesce(m.steps, 0) END AS INTEGER) AS depth
FROM nodes k LEFT JOIN cyc c ON c.n = k.n LEFT JOIN roots r ON r.n = k.n
LEFT JOIN (SELECT u.n, min(CASE WHEN q.n IS NOT NULL THEN u.a END) AS root_id, count(*) AS steps FROM up u LEFT JOIN roots q ON q.n = u.a GROUP BY u.n) m ON m.n = k.n""",
    "p4_descendants": f"""WITH RECURSIVE {_EDGES},
ring AS (SELECT n FROM up WHERE n = a),
bad AS (SELECT DISTINCT u.n FROM up u JOIN ring r ON r.n = u.a),
d AS (
  SELECT parent AS node_id, child AS descendant_id, 1 AS distance FROM edges WHERE child NOT IN (SELECT n FROM bad)
  UNION ALL
  SELECT e.parent, d.descendant_id, d.distance + 1 FROM d JOIN edges e ON e.child = d.node_id)
SELECT node_id, descendant_id, CAST(distance AS INTEGER) AS distance FROM d""",
    "p5_found": f"WITH {_ORPHANS} SELECT * FROM found",
    "p5_report": f"WITH {_ORPHANS} SELECT source_table, period, state, count(*) AS orphans FROM found GROUP BY ALL",
}
