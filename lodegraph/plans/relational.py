"""Filters, joins, aggregations, rankings and set operations over the metadata tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.functions import paths
from lodegraph.model import COMPONENTS, CONTENTS, EDGES, FILES, HINTS, NODES, UNITS, Model
from lodegraph.operators import extract as X
from lodegraph.operators import relational as R

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = lambda spark, d: f(Model(spark, d))
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def pct(column: str = "confidence"):
    """Confidence in whole percent: sums of integers don't depend on their order."""
    return F.round(F.col(column) * 100).cast("long")


# P: projections, filters, predicates ------------------------------------------
@query(f"WITH {EDGES} SELECT edge_id, edge_kind, confidence FROM e WHERE edge_kind IN ('call', 'use_table') AND (confidence >= 0.8 OR confidence IS NULL) AND src_type <> 'file'")
def ref_p1_boolean_filters(m):
    kind = F.col("edge_kind").isin("call", "use_table")
    return m.edges("src_type", "edge_kind", "confidence").where(kind & ((F.col("confidence") >= 0.8) | F.col("confidence").isNull()) & (F.col("src_type") != "file")).select("edge_id", "edge_kind", "confidence")


@query(f"WITH {EDGES}, {COMPONENTS} SELECT edge_id, src_id, dst_id FROM e WHERE src_type = 'method' AND src_id IN (SELECT component_id FROM c WHERE component_type = 'method' AND project_id IN (SELECT project_id FROM projects WHERE name IS NOT NULL))")
def ref_p2_scoped_ids(m):
    named = m.projects().where("name is not null")
    scope = R.scoped(m.components("project_id", "component_type").where("component_type = 'method'"), "project_id", named, "project_id")
    return R.scoped(m.edges("project_id", "src_type", "src_id", "dst_id").where("src_type = 'method'"), "src_id", scope, "component_id").select("edge_id", "src_id", "dst_id")


@query(f"WITH {COMPONENTS} SELECT component_id, component_name FROM c WHERE component_name LIKE 'Daily%' OR component_name LIKE '%Service' OR component_name LIKE '%Locker%' OR upper(component_name) LIKE '%DAO'")
def ref_p3_like(m):
    n = F.col("component_name")
    return m.components("component_name").where(n.startswith("Daily") | n.endswith("Service") | n.contains("Locker") | F.upper(n).like("%DAO")).select("component_id", "component_name")


@query("SELECT table_id, table_name FROM db_tables WHERE table_name ILIKE '%vendor%' OR table_comment ILIKE '%code%'")
def ref_p4_ilike(m):
    return m.tables().where(F.col("table_name").ilike("%vendor%") | F.col("table_comment").ilike("%code%")).select("table_id", "table_name")


@query(f"WITH {EDGES} SELECT edge_kind, count(*) FILTER (dst_id IS NULL) AS unresolved, count(dst_id) AS resolved FROM e GROUP BY edge_kind")
def ref_p5_null_tests(m):
    return m.edges("dst_id", "edge_kind").groupBy("edge_kind").agg(F.count_if(F.col("dst_id").isNull()).alias("unresolved"), F.count("dst_id").alias("resolved"))


@query(f"WITH {EDGES} SELECT edge_id, confidence FROM e WHERE confidence >= 0.5 AND edge_kind <> 'call' OR edge_kind = 'call' AND confidence >= 0.3")
def ref_p6_confidence_threshold(m):
    return R.confident(m.edges("edge_kind", "confidence"), 0.5, {"call": 0.3}).select("edge_id", "confidence")


@query(f"WITH {EDGES}, {NODES} SELECT edge_id FROM e WHERE EXISTS (SELECT 1 FROM n WHERE n.node_type = e.src_type AND n.node_id = e.src_id) AND EXISTS (SELECT 1 FROM n WHERE n.node_type = e.dst_type AND n.node_id = e.dst_id)")
def ref_p7_exists_both_ends(m):
    return R.with_both_ends(m.edges("src_type", "src_id", "dst_type", "dst_id"), m.nodes()).select("edge_id")


@query(f"WITH {UNITS} SELECT sql_id FROM s WHERE sql_id NOT IN (SELECT min(sql_id) FROM s GROUP BY file_id, stmt_kind)")
def ref_p8_not_in_min(m):
    return R.later_duplicates(m.sql_units(), ["file_id", "stmt_kind"], "sql_id").select("sql_id")


@query(f"WITH {FILES} SELECT CASE WHEN path LIKE '%/controller/%' THEN 'controller' WHEN path LIKE '%/service/%' THEN 'service' WHEN path LIKE '%/mapper/%' THEN 'mapper' WHEN path LIKE '%.jsp' THEN 'view' ELSE 'other' END AS layer, count(*) AS files FROM f GROUP BY 1")
def ref_p9_case_when_like(m):
    return m.files().groupBy(paths.layer("path").alias("layer")).agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {COMPONENTS} SELECT component_id, component_name FROM c WHERE component_type = 'method' AND NOT (starts_with(component_name, 'get') OR component_name IN ('toString', 'equals', 'hashCode') OR regexp_matches(component_name, '(Exception|Listener)$') OR length(component_name) <= 2)")
def ref_p10_external_call_filter(m):
    return m.components("component_name", "component_type").where("component_type = 'method'").where(~R.external_call("component_name", ["get"], ["toString", "equals", "hashCode"], ["Exception", "Listener"])).select("component_id", "component_name")


@query(f"WITH {NODES} SELECT node_type, node_id, label, file_id, project_id FROM n")
def ref_p11_node_details(m):
    return m.nodes()


@query(f"WITH {EDGES}, {NODES} SELECT e.edge_id, n.project_id FROM e JOIN n ON n.node_type = e.src_type AND n.node_id = e.src_id WHERE n.project_id IS NOT NULL AND e.src_type <> 'table'")
def ref_p12_project_edges(m):
    return R.project_edges(m.edges("project_id", "src_type", "src_id", "dst_type", "dst_id"), m.nodes()).select("edge_id", "project_id")


# J: joins ----------------------------------------------------------------------
@query(f"WITH {FILES}, {COMPONENTS} SELECT f.path, k.component_name AS class_name, m.component_name AS method_name FROM f JOIN c k ON k.file_id = f.file_id AND k.component_type = 'class' JOIN c m ON m.parent_component_id = k.component_id AND m.component_type = 'method'")
def ref_j1_file_class_method(m):
    k = m.components("file_id", "component_name", "component_type", "parent_component_id").where("component_type = 'class'").select("file_id", F.col("component_id").alias("class_id"), F.col("component_name").alias("class_name"))
    x = m.components("file_id", "component_name", "component_type", "parent_component_id").where("component_type = 'method'").select(F.col("parent_component_id").alias("class_id"), F.col("component_name").alias("method_name"))
    return m.files().join(k, "file_id").join(x, "class_id").select("path", "class_name", "method_name")


@query(f"WITH {FILES}, {UNITS} SELECT f.project_id, s.stmt_kind, count(*) AS units FROM s JOIN f USING (file_id) GROUP BY ALL")
def ref_j2_units_of_files(m):
    return m.sql_units().join(m.files(), "file_id").groupBy("project_id", "stmt_kind").agg(F.count(F.lit(1)).alias("units"))


@query(f"WITH {NODES}, r AS (SELECT DISTINCT lower(node_type) AS t, node_id FROM removed_nodes) SELECT n.node_type, n.node_id, n.label FROM r JOIN n ON n.node_type = r.t AND n.node_id = r.node_id")
def ref_j3_polymorphic(m):
    gone = m.raw("removed_nodes").select(F.lower("node_type").alias("node_type"), "node_id").distinct()
    return R.polymorphic(gone, m.nodes()).select("node_type", "node_id", "label")


@query(f"WITH {EDGES} SELECT d.table_id, d.table_name, count(e.edge_id) AS uses FROM db_tables d LEFT JOIN e ON e.dst_type = 'table' AND e.dst_id = d.table_id GROUP BY ALL")
def ref_j4_left_count_tables(m):
    uses = m.edges("dst_type", "dst_id").where("dst_type = 'table'").select(F.col("dst_id").alias("table_id"), "edge_id")
    return R.counted(m.tables(), uses, "table_id", ["table_name"], "edge_id", "uses")


@query(f"WITH {COMPONENTS} SELECT k.component_id AS class_id, count(m.component_id) AS methods FROM c k LEFT JOIN c m ON m.parent_component_id = k.component_id AND m.component_type = 'method' WHERE k.component_type = 'class' GROUP BY 1")
def ref_j5_left_count_methods(m):
    k = m.components("component_type", "parent_component_id").where("component_type = 'class'").select(F.col("component_id").alias("class_id"))
    x = m.components("component_type", "parent_component_id").where("component_type = 'method'").select(F.col("parent_component_id").alias("class_id"), F.col("component_id").alias("method_id"))
    return R.counted(k, x, "class_id", [], "method_id", "methods")


@query(f"WITH {EDGES}, {FILES} SELECT f.file_id, count(DISTINCT e.edge_id) AS edges FROM f JOIN e ON (e.src_type = 'file' AND e.src_id = f.file_id) OR (e.dst_type = 'file' AND e.dst_id = f.file_id) GROUP BY 1")
def ref_j6_or_join(m):
    return R.touching(m.edges("src_type", "src_id", "dst_type", "dst_id"), m.files().select("file_id"), "file").groupBy("file_id").agg(F.count(F.lit(1)).alias("edges"))


@query(f"WITH {EDGES}, {COMPONENTS} SELECT c.component_id, count(*) AS calls FROM c LEFT JOIN e ON e.src_type = 'method' AND e.src_id = c.component_id WHERE c.component_type = 'method' AND e.edge_kind = 'call' GROUP BY 1 HAVING count(*) >= 2")
def ref_j7_outer_to_inner(m):
    calls = m.edges("src_type", "src_id", "edge_kind").where("src_type = 'method'").select(F.col("src_id").alias("component_id"), "edge_kind")
    x = m.components("component_type").where("component_type = 'method'").join(calls, "component_id", "left").where("edge_kind = 'call'")
    return x.groupBy("component_id").agg(F.count(F.lit(1)).alias("calls")).where("calls >= 2")


@query(f"WITH {COMPONENTS} SELECT a.component_id, a.component_name, b.component_name AS parent_name FROM c a LEFT JOIN c b ON b.component_id = a.parent_component_id")
def ref_j8_self_join_parent(m):
    p = m.components("component_name", "parent_component_id").select(F.col("component_id").alias("parent_component_id"), F.col("component_name").alias("parent_name"))
    return m.components("component_name", "parent_component_id").join(p, "parent_component_id", "left").select("component_id", "component_name", "parent_name")


@query(f"WITH {EDGES}, {NODES} SELECT e.edge_id, a.label AS src_label, e.edge_kind, b.label AS dst_label, pa.path AS src_path, p.root_path FROM e JOIN n a ON a.node_type = e.src_type AND a.node_id = e.src_id JOIN n b ON b.node_type = e.dst_type AND b.node_id = e.dst_id JOIN f pa ON pa.file_id = a.file_id JOIN projects p ON p.project_id = pa.project_id")
def ref_j9_relationship_view(m):
    return R.relationship_view(m.edges("src_type", "src_id", "dst_type", "dst_id", "edge_kind"), m.nodes(), m.files(), m.projects())


@query(f"WITH {EDGES}, {FILES} SELECT e.edge_id, a.path AS src_path, b.path AS dst_path FROM e JOIN f a ON e.src_type = 'file' AND a.file_id = e.src_id JOIN f b ON e.dst_type = 'file' AND b.file_id = e.dst_id WHERE e.edge_kind IN ('include', 'import')")
def ref_j10_typed_file_edges(m):
    a = m.files().select(F.col("file_id").alias("src_id"), F.col("path").alias("src_path"))
    b = m.files().select(F.col("file_id").alias("dst_id"), F.col("path").alias("dst_path"))
    return m.edges("src_type", "src_id", "dst_type", "dst_id", "edge_kind").where("src_type = 'file' and dst_type = 'file' and edge_kind in ('include', 'import')").join(a, "src_id").join(b, "dst_id").select("edge_id", "src_path", "dst_path")


@query("SELECT a.table_id AS table_a, b.table_id AS table_b, split_part(a.table_name, '_', 2) AS stem FROM db_tables a JOIN db_tables b ON split_part(a.table_name, '_', 2) = split_part(b.table_name, '_', 2) AND a.table_id <> b.table_id AND a.owner = b.owner")
def ref_j11_equi_with_residual(m):
    t = m.tables().select("owner", "table_id", F.split_part("table_name", F.lit("_"), F.lit(2)).alias("stem"))
    a, b = t.withColumnRenamed("table_id", "table_a"), t.withColumnRenamed("table_id", "table_b")
    return a.join(b, ["owner", "stem"]).where("table_a <> table_b").select("table_a", "table_b", "stem")


@query("WITH k AS (SELECT DISTINCT lower(regexp_replace(split_part(table_name, '_', 2), '(_ID|ID)$', '')) AS key FROM db_tables), x AS (SELECT table_id, lower(split_part(table_name, '_', 2)) AS col FROM db_tables) SELECT x.table_id, x.col, coalesce(k.key, 'dummy') AS target FROM x LEFT JOIN k ON k.key = regexp_replace(x.col, '(_id|id)$', '')")
def ref_j12_derived_key(m):
    stem = F.split_part("table_name", F.lit("_"), F.lit(2))
    keys = m.tables().select(F.lower(F.regexp_replace(stem, "(_ID|ID)$", "")).alias("key")).distinct()
    x = m.tables().select("table_id", F.lower(stem).alias("col")).withColumn("key", F.regexp_replace("col", "(_id|id)$", ""))
    return x.join(keys.withColumn("hit", F.lit(True)), "key", "left").select("table_id", "col", F.when(F.col("hit"), F.col("key")).otherwise("dummy").alias("target"))


@query(f"WITH {FILES}, g AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, count(*) AS n FROM f GROUP BY 1) SELECT directory, n AS files, n * (n - 1) // 2 AS pairs, 60 AS score_pct FROM g WHERE n > 1")
def ref_j13_pairs_per_directory(m):
    return R.proximity(m.files(), paths.dirname("path"))


@query(f"WITH {COMPONENTS}, {HINTS}, x AS (SELECT hint_id, src_id, json_extract_string(hint, '$.called_name') AS called FROM h WHERE src_type = 'method' AND json_valid(hint)), src AS (SELECT component_id, project_id, file_id, parent_component_id FROM c), cand AS (SELECT x.hint_id, d.component_id AS target, CASE WHEN d.parent_component_id = src.parent_component_id THEN 1 WHEN d.file_id = src.file_id THEN 2 WHEN d.project_id = src.project_id THEN 3 ELSE 4 END AS tier FROM x JOIN src ON src.component_id = x.src_id JOIN c d ON d.component_type = 'method' AND d.component_name = x.called) SELECT hint_id, target, tier FROM (SELECT *, row_number() OVER (PARTITION BY hint_id ORDER BY tier, target) AS rn FROM cand) WHERE rn = 1")
def ref_j14_prioritised_lookup(m):
    return R.resolve_calls(m.hints(), m.components("project_id", "file_id", "component_name", "component_type", "parent_component_id"))


@query(f"WITH {EDGES}, x AS (SELECT DISTINCT dst_id FROM e WHERE dst_type = 'table' AND dst_id IS NOT NULL), q AS (SELECT x.dst_id, d.table_name FROM x JOIN db_tables d ON d.table_id = x.dst_id), cand AS (SELECT q.dst_id, d.table_id, d.owner, row_number() OVER (PARTITION BY q.dst_id ORDER BY CASE WHEN d.owner = 'APP' THEN 0 ELSE 1 END, d.table_id) AS rn FROM q JOIN db_tables d ON d.table_name = q.table_name) SELECT dst_id, table_id, owner FROM cand WHERE rn = 1")
def ref_j15_default_owner_first(m):
    used = m.edges("dst_type", "dst_id").where("dst_type = 'table' and dst_id is not null").select("dst_id").distinct()
    named = used.join(m.tables().select(F.col("table_id").alias("dst_id"), "table_name"), "dst_id")
    return R.default_first(named.join(m.tables().select("table_name", "table_id", "owner"), "table_name"), ["dst_id"], "owner", "APP", "table_id").select("dst_id", "table_id", "owner")


@query(f"WITH {FILES}, x AS (SELECT DISTINCT regexp_extract(path, '([^/]+/[^/]+)$', 1) AS target FROM f WHERE path LIKE '%.jsp') SELECT x.target, count(*) AS files FROM x JOIN f ON f.path LIKE '%/' || x.target GROUP BY 1")
def ref_j16_suffix_path(m):
    wanted = m.files().where(F.col("path").endswith(".jsp")).select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("target")).distinct()
    return R.by_suffix(wanted, "target", m.files(), "path").groupBy("target").agg(F.count(F.lit(1)).alias("files"))


# A: aggregations ----------------------------------------------------------------
@query(f"WITH {FILES}, {COMPONENTS}, {UNITS} SELECT p.project_id, (SELECT count(*) FROM f WHERE f.project_id = p.project_id) AS files, (SELECT count(*) FROM c WHERE c.project_id = p.project_id AND component_type = 'class') AS classes, (SELECT count(*) FROM c WHERE c.project_id = p.project_id AND component_type = 'method') AS methods, (SELECT count(*) FROM s JOIN f USING (file_id) WHERE f.project_id = p.project_id) AS sql_units FROM projects p")
def ref_a1_project_summary(m):
    return R.project_summary(m.projects(), m.files(), m.components("project_id", "component_type"), m.sql_units())


@query(f"WITH {FILES} SELECT lower(language) AS language, count(*) AS files FROM f GROUP BY 1")
def ref_a2_group_count(m):
    return m.files().groupBy(F.lower("language").alias("language")).agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {EDGES} SELECT edge_kind, count(DISTINCT src_id) AS sources, count(DISTINCT dst_id) AS targets FROM e GROUP BY 1")
def ref_a3_count_distinct(m):
    return m.edges("src_id", "dst_id", "edge_kind").groupBy("edge_kind").agg(F.countDistinct("src_id").alias("sources"), F.countDistinct("dst_id").alias("targets"))


@query(f"WITH {COMPONENTS} SELECT parent_component_id, component_name, count(*) AS n FROM c WHERE component_type = 'method' AND parent_component_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def ref_a4_having(m):
    return R.repeated(m.components("component_name", "component_type", "parent_component_id").where("component_type = 'method' and parent_component_id is not null"), ["parent_component_id", "component_name"])


@query(f"WITH {FILES}, {COMPONENTS} SELECT regexp_extract(f.path, '/(controller|service|mapper|model|support)/', 1) AS layer, string_agg(DISTINCT c.component_type, ',' ORDER BY c.component_type) AS kinds, count(*) AS components FROM f JOIN c USING (file_id) GROUP BY 1")
def ref_a5_group_concat(m):
    x = m.files().join(m.components("project_id", "file_id", "component_type").drop("project_id"), "file_id").withColumn("layer", F.regexp_extract("path", "/(controller|service|mapper|model|support)/", 1))
    return x.groupBy("layer").agg(F.array_join(F.sort_array(F.collect_set("component_type")), ",").alias("kinds"), F.count(F.lit(1)).alias("components"))


@query(f"WITH {COMPONENTS} SELECT project_id, component_name, component_type, coalesce(parent_component_id, -1) AS parent, min(component_id) AS keep FROM c GROUP BY 1, 2, 3, 4")
def ref_a6_min_per_key(m):
    return m.components("project_id", "component_name", "component_type", "parent_component_id").groupBy("project_id", "component_name", "component_type", F.coalesce("parent_component_id", F.lit(-1)).alias("parent")).agg(F.min("component_id").alias("keep"))


@query(f"WITH {EDGES} SELECT src_type, dst_type, edge_kind, project_id, count(*) AS frequency, max(confidence) AS confidence FROM e GROUP BY ALL")
def ref_a7_pattern_frequency(m):
    return m.edges("project_id", "src_type", "dst_type", "edge_kind", "confidence").groupBy("src_type", "dst_type", "edge_kind", "project_id").agg(F.count(F.lit(1)).alias("frequency"), F.max("confidence").alias("confidence"))


@query(f"WITH {EDGES}, {NODES} SELECT a.project_id AS src_project, b.project_id AS dst_project, count(*) AS edges, sum(CAST(round(e.confidence * 100) AS BIGINT)) AS confidence_pct, CASE WHEN count(DISTINCT e.edge_kind) > 1 THEN 'mixed' ELSE min(e.edge_kind) END AS kind FROM e JOIN n a ON a.node_type = e.src_type AND a.node_id = e.src_id JOIN n b ON b.node_type = e.dst_type AND b.node_id = e.dst_id WHERE a.project_id IS NOT NULL AND b.project_id IS NOT NULL GROUP BY 1, 2")
def ref_a8_pair_rollup(m):
    return R.pair_rollup(m.edges("project_id", "src_type", "src_id", "dst_type", "dst_id", "edge_kind", "confidence"), m.nodes(), "project_id", "src_project", "dst_project")


@query(f"WITH {EDGES}, x AS (SELECT src_type AS t, src_id AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst_type, dst_id, 0, 1 FROM e WHERE dst_id IS NOT NULL) SELECT t AS node_type, id AS node_id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, count(*) AS degree FROM x GROUP BY 1, 2")
def ref_a9_degrees(m):
    return R.degrees(m.edges("src_type", "src_id", "dst_type", "dst_id"))


@query(f"WITH {EDGES}, x AS (SELECT least(src_type || ':' || src_id, dst_type || ':' || dst_id) AS a, greatest(src_type || ':' || src_id, dst_type || ':' || dst_id) AS b, CASE edge_kind WHEN 'extends' THEN 90 WHEN 'implements' THEN 90 WHEN 'use_table' THEN 75 WHEN 'call' THEN 70 WHEN 'include' THEN 60 ELSE 50 END AS score, edge_kind FROM e WHERE dst_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, edge_kind) AS rn FROM x) SELECT a AS node1, b AS node2, score, edge_kind AS reason FROM r WHERE rn = 1")
def ref_a10_best_score_per_pair(m):
    return R.best_per_pair(m.edges("src_type", "src_id", "dst_type", "dst_id", "edge_kind"))


@query(f"WITH {EDGES} SELECT CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' WHEN confidence >= 0.5 THEN 'low' WHEN confidence IS NULL THEN 'none' ELSE 'very_low' END AS bin, count(*) AS n, min(confidence) AS lowest, max(confidence) AS highest FROM e GROUP BY 1")
def ref_a11_histogram(m):
    return m.edges("confidence").groupBy(R.confidence_bin("confidence").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("confidence").alias("lowest"), F.max("confidence").alias("highest"))


@query("SELECT language, count(*) AS n, CAST(sum(loc) AS BIGINT) AS total, CAST(sum(loc) AS DOUBLE) / count(loc) AS mean, median(loc) AS median, CAST(sum(CAST(loc AS HUGEINT) * loc) AS BIGINT) AS squares FROM (SELECT DISTINCT file_id, lower(language) AS language, loc FROM files) GROUP BY 1")
def ref_a12_moments(m):
    f = m.raw("files").select("file_id", F.lower("language").alias("language"), "loc").distinct()
    return f.groupBy("language").agg(
        F.count(F.lit(1)).alias("n"), F.sum("loc").alias("total"), F.try_divide(F.sum("loc").cast("double"), F.count("loc")).alias("mean"), F.median("loc").alias("median"), F.sum(F.col("loc").cast("long") * F.col("loc")).alias("squares")
    )


@query(f"WITH {EDGES} SELECT edge_kind, count(*) AS edges, count(dst_id) AS resolved, CASE WHEN count(*) = 0 THEN 0 ELSE CAST(count(dst_id) AS DOUBLE) / count(*) END AS coverage FROM e GROUP BY 1")
def ref_a13_coverage_ratio(m):
    return m.edges("dst_id", "edge_kind").groupBy("edge_kind").agg(F.count(F.lit(1)).alias("edges"), F.count("dst_id").alias("resolved")).withColumn("coverage", R.ratio("resolved", "edges"))


@query(f"WITH {FILES}, x AS (SELECT project_id, CASE WHEN loc <= 100 THEN 1 WHEN loc <= 300 THEN 2 WHEN loc <= 800 THEN 3 ELSE 4 END AS rank FROM f WHERE loc IS NOT NULL) SELECT project_id, count(*) FILTER (rank = 1) AS low, count(*) FILTER (rank = 2) AS med, count(*) FILTER (rank = 3) AS high, count(*) FILTER (rank = 4) AS crit, max(rank) AS worst FROM x GROUP BY 1")
def ref_a14_severity_histogram(m):
    x = m.files().where("loc is not null").select("project_id", R.severity_rank("loc").alias("rank"))
    return x.groupBy("project_id").agg(*[F.count_if(F.col("rank") == k).alias(n) for k, n in ((1, "low"), (2, "med"), (3, "high"), (4, "crit"))], F.max("rank").alias("worst"))


@query(f"WITH {EDGES} SELECT project_id, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium, count(*) FILTER (confidence < 0.5) AS low, CAST(count(*) FILTER (confidence >= 0.8) * 10 + count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) * 7 + count(*) FILTER (confidence < 0.5) * 3 AS DOUBLE) / (10 * count(*)) AS quality FROM e WHERE confidence IS NOT NULL GROUP BY 1")
def ref_a15_relationship_quality(m):
    return R.relationship_quality(m.edges("project_id", "confidence"))


@query(f"WITH {EDGES}, x AS (SELECT src_type AS t, src_id AS id, confidence FROM e UNION ALL SELECT dst_type, dst_id, confidence FROM e WHERE dst_id IS NOT NULL) SELECT t AS node_type, id AS node_id, CAST(sum(CAST(round(confidence * 100) AS BIGINT)) AS DOUBLE) / count(confidence) AS mean_pct FROM x WHERE confidence IS NOT NULL GROUP BY 1, 2")
def ref_a16_incident_confidence(m):
    return R.incident_confidence(m.edges("src_type", "src_id", "dst_type", "dst_id", "confidence"))


@query(f"WITH {FILES}, b AS (SELECT file_id % 8 AS batch, count(*) AS n, sum(loc) AS loc FROM f GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS files, CAST(sum(loc) AS BIGINT) AS loc, count(*) AS batches FROM b")
def ref_a17_merged_batches(m):
    b = m.files().groupBy((F.col("file_id") % 8).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sum("loc").alias("loc"))
    return b.agg(F.sum("n").alias("files"), F.sum("loc").alias("loc"), F.count(F.lit(1)).alias("batches"))


# W: rank-like forms ---------------------------------------------------------------
@query(f"WITH {UNITS} SELECT file_id, stmt_id, sql_id FROM (SELECT *, row_number() OVER (PARTITION BY file_id, stmt_id ORDER BY sql_id) AS rn FROM s) WHERE rn = 1")
def ref_w1_first_per_key(m):
    return R.first_per_key(m.sql_units(), ["file_id", "stmt_id"], F.col("sql_id")).select("file_id", "stmt_id", "sql_id")


@query(f"WITH {HINTS} SELECT src_type, src_id, hint_id FROM (SELECT *, row_number() OVER (PARTITION BY src_type, src_id ORDER BY created_at DESC, hint_id) AS rn FROM h) WHERE rn = 1")
def ref_w2_latest_hint(m):
    return R.first_per_key(m.hints(), ["src_type", "src_id"], F.desc("created_at"), F.col("hint_id")).select("src_type", "src_id", "hint_id")


_SIGNATURE = r"public [A-Za-z<>]+ ([a-z][A-Za-z]*)\(([^()]*)\)"


@query(f"WITH {COMPONENTS}, {HINTS}, {CONTENTS}, g AS (SELECT file_id, unnest(regexp_extract_all(content, '{_SIGNATURE}', 1)) AS name, unnest(regexp_extract_all(content, '{_SIGNATURE}', 2)) AS args FROM t), sg AS (SELECT DISTINCT file_id, name, CASE WHEN trim(args) = '' THEN 0 ELSE len(string_split(args, ',')) END AS params FROM g), x AS (SELECT hint_id, json_extract_string(hint, '$.called_name') AS called, TRY_CAST(json_extract_string(hint, '$.arg_count') AS BIGINT) AS args FROM h WHERE json_valid(hint)), r AS (SELECT x.hint_id, c.component_id, CASE abs(x.args - sg.params) WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 1 END AS score FROM x JOIN c ON c.component_name = x.called AND c.component_type = 'method' JOIN sg ON sg.file_id = c.file_id AND sg.name = c.component_name WHERE x.args IS NOT NULL) SELECT hint_id, component_id, score FROM (SELECT *, row_number() OVER (PARTITION BY hint_id ORDER BY score DESC, component_id) AS rn FROM r) WHERE rn = 1")
def ref_w3_best_overload(m):
    params = F.when(F.trim("args") == "", 0).otherwise(F.size(F.split("args", ","))).alias("params")
    signatures = X.method_signatures(m.contents(), "file_id", "content").select("file_id", F.col("name").alias("component_name"), params).distinct()
    return R.best_overload(m.hints(), m.components("file_id", "component_name", "component_type"), signatures)


@query(f"WITH {COMPONENTS}, x AS (SELECT component_id, 10 AS priority, 'controller' AS reason FROM c WHERE component_name LIKE '%Controller' UNION ALL SELECT component_id, 8, 'service' FROM c WHERE component_name LIKE '%Service%' UNION ALL SELECT component_id, 5, 'daily' FROM c WHERE component_name LIKE 'Daily%') SELECT component_id, priority, reason FROM (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY priority DESC, reason) AS rn FROM x) WHERE rn = 1")
def ref_w4_entry_points(m):
    n = F.col("component_name")
    return R.entry_points(m.components("component_name"), [(n.endswith("Controller"), 10, "controller"), (n.contains("Service"), 8, "service"), (n.startswith("Daily"), 5, "daily")])


@query(f"WITH {COMPONENTS}, x AS (SELECT parent_component_id AS class_id, component_id, component_name, CASE WHEN regexp_matches(component_name, '^(init|open|start|load)') THEN 0 WHEN regexp_matches(component_name, '^(check|find|select)') THEN 1 WHEN regexp_matches(component_name, '^(save|update|insert)') THEN 3 WHEN regexp_matches(component_name, '^(close|archive|notify)') THEN 4 ELSE 2 END AS pr FROM c WHERE component_type = 'method' AND parent_component_id IS NOT NULL), y AS (SELECT class_id, component_id AS src, lead(component_id) OVER (PARTITION BY class_id ORDER BY pr, component_id) AS dst FROM x) SELECT class_id, src, dst FROM y WHERE dst IS NOT NULL")
def ref_w5_consecutive_pairs(m):
    return R.consecutive(m.components("component_name", "component_type", "parent_component_id"))


@query(f"WITH {EDGES} SELECT edge_id, row_number() OVER (PARTITION BY src_type, src_id ORDER BY created_at, edge_id) - 1 AS sequence_order FROM e")
def ref_w6_sequence_order(m):
    return m.edges("src_type", "src_id", "created_at").select("edge_id", (F.row_number().over(W.partitionBy("src_type", "src_id").orderBy("created_at", "edge_id")) - 1).alias("sequence_order"))


# T: sort, limit, top-k -------------------------------------------------------------
@query(f"WITH {FILES} SELECT file_id, loc FROM f WHERE loc IS NOT NULL ORDER BY loc DESC, file_id")
def ref_t1_order_by(m):
    return m.files().where("loc is not null").select("file_id", "loc").orderBy(F.desc("loc"), "file_id")


@query(f"WITH {EDGES} SELECT dst_type, dst_id, count(*) AS uses FROM e WHERE dst_id IS NOT NULL GROUP BY ALL ORDER BY uses DESC, dst_type, dst_id LIMIT 20")
def ref_t2_limit_after_order(m):
    return m.edges("dst_type", "dst_id").where("dst_id is not null").groupBy("dst_type", "dst_id").agg(F.count(F.lit(1)).alias("uses")).orderBy(F.desc("uses"), "dst_type", "dst_id").limit(20)


@query(f"WITH {EDGES}, d AS (SELECT t || ':' || id AS k, count(*) AS n FROM (SELECT src_type AS t, src_id AS id FROM e WHERE dst_id IS NOT NULL UNION ALL SELECT dst_type, dst_id FROM e WHERE dst_id IS NOT NULL) GROUP BY 1), top AS (SELECT k FROM d ORDER BY n DESC, k LIMIT 100) SELECT edge_id FROM e WHERE dst_id IS NOT NULL AND src_type || ':' || src_id IN (SELECT k FROM top) AND dst_type || ':' || dst_id IN (SELECT k FROM top)")
def ref_t3_induced_subgraph(m):
    return R.top_subgraph(m.edges("src_type", "src_id", "dst_type", "dst_id").where("dst_id is not null"), 100).select("edge_id")


@query(f"WITH {EDGES}, p AS (SELECT dst_id AS table_id, src_type, edge_kind, count(*) AS frequency, max(confidence) AS confidence FROM e WHERE dst_type = 'table' AND dst_id IS NOT NULL GROUP BY ALL) SELECT table_id, src_type, edge_kind, frequency, confidence FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY frequency DESC, confidence DESC NULLS LAST, src_type, edge_kind) AS rn FROM p) WHERE rn <= 5")
def ref_t4_top_patterns_per_table(m):
    p = m.edges("src_type", "dst_type", "dst_id", "edge_kind", "confidence").where("dst_type = 'table' and dst_id is not null").groupBy(F.col("dst_id").alias("table_id"), "src_type", "edge_kind").agg(F.count(F.lit(1)).alias("frequency"), F.max("confidence").alias("confidence"))
    return R.top_k(p, ["table_id"], 5, F.desc("frequency"), F.desc_nulls_last("confidence"), F.col("src_type"), F.col("edge_kind"))


@query("WITH x AS (SELECT doc_id, abs(n_chars - length(text)) AS err FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL) SELECT doc_id, err, side FROM (SELECT doc_id, err, 'worst' AS side FROM x ORDER BY err DESC, doc_id LIMIT 5) UNION ALL SELECT doc_id, err, side FROM (SELECT doc_id, err, 'best' AS side FROM x ORDER BY err, doc_id LIMIT 5)")
def ref_t5_best_and_worst(m):
    x = m.raw("documents").where("text is not null and n_chars is not null").select("doc_id", F.abs(F.col("n_chars") - F.length("text")).alias("err"))
    return x.orderBy(F.desc("err"), "doc_id").limit(5).withColumn("side", F.lit("worst")).unionByName(x.orderBy("err", "doc_id").limit(5).withColumn("side", F.lit("best")))


@query(f"WITH {COMPONENTS} SELECT component_id, component_name FROM c WHERE component_type = 'class' ORDER BY length(component_name), component_name, component_id LIMIT 50")
def ref_t6_computed_sort_key(m):
    return m.components("component_name", "component_type").where("component_type = 'class'").orderBy(F.length("component_name"), "component_name", "component_id").limit(50).select("component_id", "component_name")


@query(f"WITH {FILES}, {COMPONENTS} SELECT DISTINCT f.file_id, f.path FROM f JOIN c USING (file_id) WHERE c.component_type = 'method' ORDER BY f.path, f.file_id LIMIT 30")
def ref_t7_distinct_order_limit(m):
    x = m.files().join(m.components("file_id", "component_type").where("component_type = 'method'").select("file_id"), "file_id", "left_semi")
    return x.select("file_id", "path").orderBy("path", "file_id").limit(30)


# set operations ----------------------------------------------------------------------
@query(f"WITH {FILES}, {UNITS} SELECT file_id, 'both' AS side FROM (SELECT file_id FROM f INTERSECT SELECT file_id FROM s) UNION ALL SELECT file_id, 'files' FROM (SELECT file_id FROM f EXCEPT SELECT file_id FROM s) UNION ALL SELECT file_id, 'units' FROM (SELECT file_id FROM s EXCEPT SELECT file_id FROM f)")
def ref_set_operations(m):
    return R.compare_sets(m.files().select("file_id"), m.sql_units().select("file_id"), "files", "units")


@query(f"WITH {COMPONENTS} SELECT component_name FROM c WHERE component_type = 'class' UNION SELECT component_name FROM c WHERE component_type = 'interface'")
def ref_set_union_distinct(m):
    c = m.components("component_name", "component_type")
    return c.where("component_type = 'class'").select("component_name").union(c.where("component_type = 'interface'").select("component_name")).distinct()


# Y: secondary modules ------------------------------------------------------------------
@query(f"WITH {EDGES} SELECT edge_id FROM e WHERE dst_type = 'table' AND dst_id = (SELECT min(table_id) FROM db_tables WHERE owner = 'APP')")
def ref_y1_scalar_subquery(m):
    one = m.tables().where("owner = 'APP'").agg(F.min("table_id").alias("dst_id"))
    return m.edges("dst_type", "dst_id").where("dst_type = 'table'").join(F.broadcast(one), "dst_id").select("edge_id")  # one row


@query("SELECT coalesce(owner, '-') AS owner, table_name, status FROM db_tables ORDER BY 1, 2")
def ref_y3_catalog_listing(m):
    return m.tables().select(F.coalesce("owner", F.lit("-")).alias("owner"), "table_name", "status").orderBy("owner", "table_name")


@query(f"WITH {EDGES} SELECT src_type, dst_type, count(*) AS n FROM e GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10")
def ref_y5_two_key_top(m):
    return m.edges("src_type", "dst_type").groupBy("src_type", "dst_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src_type", "dst_type").limit(10)


@query(f"WITH {FILES}, {UNITS} SELECT f.file_id, count(s.sql_id) AS units FROM f LEFT JOIN s USING (file_id) WHERE lower(f.language) = 'xml' GROUP BY 1")
def ref_y6_files_left_units(m):
    return R.counted(m.files().where("lower(language) = 'xml'").select("file_id"), m.sql_units().select("file_id", "sql_id"), "file_id", [], "sql_id", "units")


@query(f"WITH {COMPONENTS} SELECT k.component_name || '.' || x.component_name AS fqn, x.component_id FROM c k JOIN c x ON x.parent_component_id = k.component_id AND x.component_type = 'method' WHERE lower(k.component_name) LIKE '%service%' ORDER BY fqn, x.component_id LIMIT 100")
def ref_y7_start_nodes(m):
    k = m.components("component_name", "component_type", "parent_component_id").where(F.col("component_name").ilike("%service%")).select(F.col("component_id").alias("parent_component_id"), F.col("component_name").alias("k"))
    x = m.components("component_name", "component_type", "parent_component_id").where("component_type = 'method'").join(k, "parent_component_id")
    return x.select(F.concat_ws(".", "k", "component_name").alias("fqn"), "component_id").orderBy("fqn", "component_id").limit(100)


@query(f"WITH {EDGES} SELECT edge_kind, dst_type, dst_id, count(*) AS n FROM e WHERE edge_kind IN ('import', 'extends', 'implements') AND dst_id IS NOT NULL GROUP BY ALL ORDER BY n DESC, edge_kind, dst_type, dst_id LIMIT 10")
def ref_y8_top_dependencies(m):
    x = m.edges("dst_type", "dst_id", "edge_kind").where("edge_kind in ('import', 'extends', 'implements') and dst_id is not null").groupBy("edge_kind", "dst_type", "dst_id").agg(F.count(F.lit(1)).alias("n"))
    return x.orderBy(F.desc("n"), "edge_kind", "dst_type", "dst_id").limit(10)


@query(f"WITH {FILES}, {UNITS} SELECT * FROM (SELECT 'file' AS origin, path AS label FROM f WHERE path ILIKE '%vendor%' ORDER BY file_id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'unit', coalesce(stmt_id, '?') FROM s WHERE stmt_id ILIKE '%vendor%' ORDER BY sql_id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'table', table_name FROM db_tables WHERE table_name ILIKE '%vendor%' ORDER BY table_id LIMIT 3)")
def ref_y10_related_text(m):
    parts = [(m.files(), "file", "path", "file_id", 10), (m.sql_units(), "unit", "stmt_id", "sql_id", 5), (m.tables(), "table", "table_name", "table_id", 3)]
    return R.related(parts, "%vendor%")


@query(f"WITH {EDGES} SELECT edge_id FROM e WHERE confidence < 0.3")
def ref_y12_low_confidence(m):
    return m.edges("confidence").where("confidence < 0.3").select("edge_id")


@query(f"WITH {FILES}, {COMPONENTS}, x AS (SELECT file_id, component_name AS name FROM c WHERE component_type = 'class') SELECT file_id, name, 'component' AS origin FROM x UNION ALL SELECT f.file_id, regexp_extract(f.path, '([^/]+)$', 1), 'catalog' FROM f WHERE f.file_id NOT IN (SELECT file_id FROM x WHERE file_id IS NOT NULL)")
def ref_y13_component_merge(m):
    x = m.components("file_id", "component_name", "component_type").where("component_type = 'class'").select("file_id", F.col("component_name").alias("name"), F.lit("component").alias("origin"))
    rest = m.files().join(x, "file_id", "left_anti").select("file_id", paths.basename("path").alias("name"), F.lit("catalog").alias("origin"))
    return x.unionByName(rest)


@query(f"WITH {FILES}, x AS (SELECT CASE WHEN path LIKE '%/controller/%' THEN 'controller' WHEN path LIKE '%/service/%' THEN 'service' WHEN path LIKE '%/mapper/%' THEN 'mapper' WHEN path LIKE '%.jsp' THEN 'view' ELSE 'other' END AS layer FROM f) SELECT layer, CASE layer WHEN 'controller' THEN 1 WHEN 'service' THEN 2 WHEN 'mapper' THEN 3 WHEN 'view' THEN 4 ELSE 9 END AS position, count(*) AS files FROM x GROUP BY 1, 2 ORDER BY 2")
def ref_y14_layers_in_order(m):
    x = m.files().select(paths.layer("path").alias("layer"))
    pos = F.when(F.col("layer") == "controller", 1).when(F.col("layer") == "service", 2).when(F.col("layer") == "mapper", 3).when(F.col("layer") == "view", 4).otherwise(9)
    return x.groupBy("layer", pos.alias("position")).agg(F.count(F.lit(1)).alias("files")).orderBy("position")


@query(f"WITH {EDGES}, x AS (SELECT edge_kind, count(*) * CAST(max(round(confidence * 100)) AS BIGINT) AS product FROM e GROUP BY 1) SELECT edge_kind, product FROM x ORDER BY product DESC, edge_kind LIMIT 1")
def ref_y19_argmax(m):
    x = m.edges("edge_kind", "confidence").groupBy("edge_kind").agg((F.count(F.lit(1)) * F.max(pct())).alias("product"))
    return x.orderBy(F.desc("product"), "edge_kind").limit(1)


@query(f"WITH {FILES}, {COMPONENTS} SELECT c.component_id, c.component_name, f.path FROM c LEFT JOIN f USING (file_id) WHERE c.component_type IN ('class', 'interface') AND c.component_name NOT LIKE '%Legacy%' ORDER BY c.component_name, c.component_id")
def ref_y20_hub_listing(m):
    x = m.components("file_id", "component_name", "component_type").where("component_type in ('class', 'interface')").where(~F.col("component_name").like("%Legacy%"))
    return x.join(m.files().select("file_id", "path"), "file_id", "left").select("component_id", "component_name", "path").orderBy("component_name", "component_id")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
