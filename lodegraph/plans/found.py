"""Queries of the data-quality operators in the core: hierarchies and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import hierarchy as H
from lodegraph.operators import references as R
from lodegraph.session import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    edges, hints = table(spark, d, "edges"), table(spark, d, "edge_hints")
    parts = [(table(spark, d, "components").where(F.lower("component_type").isin("method", "class", "interface")), None, "component_id", "component_type", "loaded_at")]
    parts += [(table(spark, d, t), kind, key, None, "loaded_at") for t, kind, key in (("files", "file", "file_id"), ("sql_units", "sql_unit", "sql_id"), ("db_tables", "table", "table_id"))]
    return R.orphan_references(
        [
            R.Reference("edges", edges, "edge_id", "src_type", "src_id", "src_id"),
            R.Reference("edges", edges, "edge_id", "dst_type", "dst_id", "dst_id"),
            R.Reference("edge_hints", hints, "hint_id", "src_type", "src_id", "src_id"),
        ],
        R.records(parts),
        R.records([(table(spark, d, "removed_nodes"), None, "node_id", "node_type", None)]),
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_id", "ref_field", "state")


def p4_by_month(spark: SparkSession, d: str) -> DataFrame:
    return R.orphans_by_month(_orphans(spark, d))


def _components(spark: SparkSession, d: str) -> H.Hierarchy:
    return H.resolve(table(spark, d, "components"), "component_id", "parent_component_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d).states().where("state <> 'ok'").select(F.col("id").alias("component_id"), "state")


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    h = _components(spark, d)
    return h.paths().select(F.col("id").alias("component_id"), "state", F.array_join("path", "/").alias("path"), "depth", "root_id", "n_descendants")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return _components(spark, d).descendants().select(F.col("id").alias("component_id"), "descendant_id", "distance")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p4_found, p4_by_month)}


_NODES = """nodes AS (
  SELECT lower(trim(component_type)) AS t, component_id AS id, min(loaded_at) AS loaded FROM components
    WHERE lower(component_type) IN ('method', 'class', 'interface') GROUP BY 1, 2
  UNION ALL SELECT 'file', file_id, min(loaded_at) FROM files GROUP BY 2
  UNION ALL SELECT 'sql_unit', sql_id, min(loaded_at) FROM sql_units GROUP BY 2
  UNION ALL SELECT 'table', table_id, min(loaded_at) FROM db_tables GROUP BY 2
), gone AS (SELECT DISTINCT lower(trim(node_type)) AS t, node_id AS id FROM removed_nodes),
refs AS (
  SELECT 'edges' AS ref_table, edge_id AS ref_id, 'src_id' AS ref_field, lower(trim(src_type)) AS t, src_id AS id, created_at FROM edges
  UNION SELECT 'edges', edge_id, 'dst_id', lower(trim(dst_type)), dst_id, created_at FROM edges
  UNION SELECT 'edge_hints', hint_id, 'src_id', lower(trim(src_type)), src_id, created_at FROM edge_hints
), found AS (
  SELECT ref_table, ref_id, ref_field, created_at,
         CASE WHEN n.id IS NOT NULL THEN CASE WHEN n.loaded > refs.created_at THEN 'late' END
              WHEN g.id IS NOT NULL THEN 'deleted' ELSE 'missing' END AS state
  FROM refs LEFT JOIN nodes n ON n.t = refs.t AND n.id = refs.id LEFT JOIN gone g ON g.t = refs.t AND g.id = refs.id
  WHERE refs.id IS NOT NULL)"""

# UNION drops rows that are there already, so the closure ends on cycles too.
_TREE = """c AS (SELECT component_id AS id, max(parent_component_id) AS parent FROM components WHERE component_id IS NOT NULL GROUP BY 1),
up(id, anc) AS (
  SELECT id, parent FROM c WHERE parent IS NOT NULL
  UNION SELECT up.id, c.parent FROM up JOIN c ON c.id = up.anc WHERE c.parent IS NOT NULL
), onloop AS (SELECT id FROM up WHERE id = anc),
marks AS (SELECT up.id, bool_or(l.id IS NOT NULL) AS cyclic, bool_or(c.id IS NULL) AS lost FROM up LEFT JOIN onloop l ON l.id = up.anc LEFT JOIN c ON c.id = up.anc GROUP BY 1),
states AS (SELECT c.id, CASE WHEN l.id IS NOT NULL THEN 'loop' WHEN m.cyclic THEN 'under_loop' WHEN m.lost THEN 'broken' ELSE 'ok' END AS state FROM c LEFT JOIN onloop l ON l.id = c.id LEFT JOIN marks m ON m.id = c.id),
above AS (SELECT up.id, up.anc FROM up JOIN c ON c.id = up.anc JOIN states s ON s.id = up.id WHERE s.state IN ('ok', 'broken')),
depths AS (SELECT s.id, s.state, count(a.anc) AS depth FROM states s LEFT JOIN above a ON a.id = s.id WHERE s.state IN ('ok', 'broken') GROUP BY 1, 2)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH RECURSIVE {_TREE} SELECT id AS component_id, state FROM states WHERE state <> 'ok'",
        "p1_hierarchy": f"WITH RECURSIVE {_TREE}, steps AS (SELECT id, anc FROM above UNION ALL SELECT id, id FROM depths), paths AS (SELECT s.id, string_agg(CAST(s.anc AS VARCHAR), '/' ORDER BY d.depth) AS path, arg_min(s.anc, d.depth) AS root FROM steps s JOIN depths d ON d.id = s.anc GROUP BY 1), below AS (SELECT anc AS id, count(*) AS n FROM above GROUP BY 1) SELECT s.id AS component_id, s.state, p.path, CAST(d.depth AS INTEGER) AS depth, CASE WHEN s.state = 'ok' THEN p.root END AS root_id, CASE WHEN d.id IS NOT NULL THEN coalesce(b.n, 0) END AS n_descendants FROM states s LEFT JOIN depths d ON d.id = s.id LEFT JOIN paths p ON p.id = s.id LEFT JOIN below b ON b.id = s.id",
        "p1_descendants": f"WITH RECURSIVE {_TREE} SELECT a.anc AS component_id, a.id AS descendant_id, CAST(d.depth - u.depth AS INTEGER) AS distance FROM above a JOIN depths d ON d.id = a.id JOIN depths u ON u.id = a.anc",
        "p4_found": f"WITH {_NODES} SELECT ref_table, ref_id, ref_field, state FROM found WHERE state IS NOT NULL",
        "p4_by_month": f"WITH {_NODES} SELECT ref_table, ref_field, state, strftime(created_at, '%Y-%m') AS month, count(*) AS orphans FROM found WHERE state IS NOT NULL GROUP BY ALL",
    }
