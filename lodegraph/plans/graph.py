"""Graph queries, table maintenance, exports and incremental forms over the metadata tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.functions import findings, paths, sqltext
from lodegraph.model import COMPONENTS, CONTENTS, EDGES, FILES, HINTS, NODES, UNITS, Model
from lodegraph.operators import dml as D
from lodegraph.operators import extract as X
from lodegraph.operators import graph as G
from lodegraph.operators import relational as R
from lodegraph.plans.scores import FOUND
from lodegraph.sources import sinks as K

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = lambda spark, d: f(Model(spark, d))
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


_KEYED = f"{EDGES}, k AS (SELECT edge_id, edge_kind, src_type || ':' || src_id AS src, CASE WHEN dst_id IS NOT NULL THEN dst_type || ':' || dst_id END AS dst, confidence FROM e)"
_PAIRS = "p AS (SELECT DISTINCT src, dst FROM k WHERE dst IS NOT NULL)"


def _start(m: Model, *nodes: str):
    return m.spark.createDataFrame([(n,) for n in nodes], "node string")


@query(f"WITH RECURSIVE {_KEYED}, {_PAIRS}, u AS (SELECT src, dst FROM p UNION SELECT dst, src FROM p), b AS (SELECT 'file:10' AS node, 0 AS depth UNION SELECT u.dst, b.depth + 1 FROM b JOIN u ON u.src = b.node WHERE b.depth < 2), near AS (SELECT DISTINCT node FROM b) SELECT edge_id FROM k WHERE src IN (SELECT node FROM near) AND dst IN (SELECT node FROM near)")
def ref_g1_focus(m):
    return G.focus(G.keyed(m.edges("src_type", "src_id", "dst_type", "dst_id", "edge_kind", "confidence")), _start(m, "file:10"), 2).select("edge_id")


@query(f"WITH RECURSIVE {_KEYED}, {_PAIRS}, b AS (SELECT src AS node, 0 AS depth FROM (SELECT src FROM k WHERE src LIKE 'method:%' GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 3) UNION SELECT p.dst, b.depth + 1 FROM b JOIN p ON p.src = b.node WHERE b.depth < 2), v AS (SELECT node, min(depth) AS depth FROM b GROUP BY 1) SELECT k.edge_id, v.depth, k.src, coalesce(k.dst, 'unresolved:' || k.edge_id) AS dst FROM k JOIN v ON v.node = k.src")
def ref_g3_call_trace(m):
    e = G.keyed(m.edges("src_type", "src_id", "dst_type", "dst_id", "edge_kind", "confidence"))
    starts = e.where("src like 'method:%'").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").limit(3)
    return G.trace(e, starts, 3)


@query(f"WITH RECURSIVE {_KEYED}, {_PAIRS}, b AS (SELECT src AS node, 0 AS depth FROM (SELECT src FROM k WHERE src LIKE 'class:%' GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 3) UNION SELECT p.dst, b.depth + 1 FROM b JOIN p ON p.src = b.node WHERE b.depth < 3), v AS (SELECT node, min(depth) AS depth FROM b GROUP BY 1) SELECT k.edge_id, v.depth, k.src, k.dst FROM k JOIN v ON v.node = k.src WHERE k.dst IS NOT NULL")
def ref_g3b_resolved_trace(m):
    e = G.keyed(m.edges("src_type", "src_id", "dst_type", "dst_id", "edge_kind", "confidence"))
    starts = e.where("src like 'class:%'").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").limit(3)
    return G.trace(e, starts, 4, unresolved=False)


@query(f"WITH {EDGES}, {FILES}, {UNITS}, v AS (SELECT path AS view, row_number() OVER (ORDER BY path) AS i FROM (SELECT path FROM f WHERE path LIKE '%.jsp' ORDER BY path LIMIT 5)), q AS (SELECT sql_id AS unit, row_number() OVER (ORDER BY sql_id) AS i FROM (SELECT sql_id FROM s WHERE origin = 'jsp' ORDER BY sql_id LIMIT 10)), t AS (SELECT DISTINCT src_id AS unit, dst_id AS used FROM e WHERE src_type = 'sql_unit' AND edge_kind = 'use_table' AND confidence >= 0.3 AND dst_id IS NOT NULL) SELECT view, v2.unit, used FROM (SELECT view, unit FROM v JOIN q USING (i)) v2 LEFT JOIN t ON t.unit = v2.unit")
def ref_g4_three_layer_flow(m):
    views = m.files().where("path like '%.jsp'").select(F.col("path").alias("view"))
    units = m.sql_units().where("origin = 'jsp'").select(F.col("sql_id").alias("unit"))
    uses = m.edges("src_type", "src_id", "dst_id", "edge_kind", "confidence").where("src_type = 'sql_unit' and edge_kind = 'use_table' and confidence >= 0.3 and dst_id is not null").select(F.col("src_id").alias("unit"), F.col("dst_id").alias("used")).distinct()
    return G.positional_flow(views, units, uses, 5, 10)


@query(f"WITH {EDGES}, {COMPONENTS}, calls AS (SELECT src_id AS id, count(*) AS n FROM e WHERE src_type = 'method' AND edge_kind = 'call' GROUP BY 1), x AS (SELECT component_id, 10 AS priority, 'controller' AS reason FROM c WHERE component_type = 'class' AND component_name LIKE '%Controller%' UNION ALL SELECT component_id, least(7, n), 'calls' FROM c JOIN calls ON calls.id = c.component_id WHERE c.component_type = 'method' AND n >= 2) SELECT component_id, priority, reason FROM x ORDER BY priority DESC, component_id, reason LIMIT 30")
def ref_g5_entry_points(m):
    calls = m.edges("src_type", "src_id", "edge_kind").where("src_type = 'method' and edge_kind = 'call'").groupBy(F.col("src_id").alias("component_id")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    c = m.components("component_name", "component_type")
    a = c.where("component_type = 'class'").where(F.col("component_name").contains("Controller")).select("component_id", F.lit(10).cast("long").alias("priority"), F.lit("controller").alias("reason"))
    b = c.where("component_type = 'method'").join(calls, "component_id").select("component_id", F.least(F.lit(7), "n").cast("long").alias("priority"), F.lit("calls").alias("reason"))
    return a.unionByName(b).orderBy(F.desc("priority"), "component_id", "reason").limit(30)


@query(f"WITH RECURSIVE {_KEYED}, {_PAIRS}, b AS (SELECT src AS start, src AS node, 0 AS depth FROM (SELECT DISTINCT src FROM p WHERE src LIKE 'method:%' ORDER BY src LIMIT 20) UNION SELECT b.start, p.dst, b.depth + 1 FROM b JOIN p ON p.src = b.node WHERE b.depth < 4), v AS (SELECT start, node, min(depth) AS depth FROM b GROUP BY 1, 2) SELECT start, max(depth) AS depth, count(*) AS nodes FROM v GROUP BY 1")
def ref_g6_chain_depth(m):
    e = G.keyed(m.edges("src_type", "src_id", "dst_type", "dst_id", "edge_kind", "confidence"))
    starts = e.where("dst is not null and src like 'method:%'").select(F.col("src").alias("node")).distinct().orderBy("node").limit(20)
    return G.chain_depth(e, starts, 4)


@query()
def ref_g6_full_chain_depth(m):
    """As :func:`ref_g6_chain_depth`, whose SQL ends at depth 4, but to the end of every chain."""
    e = G.keyed(m.edges("src_type", "src_id", "dst_type", "dst_id", "edge_kind", "confidence"))
    starts = e.where("dst is not null and src like 'method:%'").select(F.col("src").alias("node")).distinct().orderBy("node").limit(20)
    return G.chain_depth(e, starts)


@query()
def ref_g7_topological_levels(m):
    return G.topological_levels(G.keyed(m.edges("src_type", "src_id", "dst_type", "dst_id", "edge_kind", "confidence").where("edge_kind in ('extends', 'implements')")))


@query(f"WITH {_KEYED}, {_PAIRS} SELECT a.src AS node1, a.dst AS node2 FROM p a JOIN p b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def ref_g8_two_cycles(m):
    return G.mutual(G.keyed(m.edges("src_type", "src_id", "dst_type", "dst_id", "edge_kind", "confidence")))


@query()
def ref_g9_communities(m):
    return G.label_propagation(G.keyed(m.edges("src_type", "src_id", "dst_type", "dst_id", "edge_kind", "confidence")))


@query(f"WITH RECURSIVE {_KEYED}, p AS (SELECT DISTINCT src, dst FROM k WHERE dst IS NOT NULL AND edge_kind = 'implements'), u AS (SELECT src, dst FROM p UNION SELECT dst, src FROM p), b AS (SELECT DISTINCT src AS node, src AS root FROM u UNION SELECT u.dst, b.root FROM b JOIN u ON u.src = b.node WHERE b.root < u.dst OR true) SELECT node, min(root) AS component FROM b GROUP BY 1")
def ref_g9_connected_components(m):
    return G.components(G.keyed(m.edges("src_type", "src_id", "dst_type", "dst_id", "edge_kind", "confidence").where("edge_kind = 'implements'")))


@query()
def ref_g9_all_components(m):
    """As :func:`ref_g9_connected_components`, whose SQL takes only implements edges, but over all resolved edges."""
    return G.components(G.keyed(m.edges("src_type", "src_id", "dst_type", "dst_id", "edge_kind", "confidence")))


@query(f"WITH {EDGES}, {FILES}, {UNITS}, d AS (SELECT 'file:' || file_id AS node, regexp_extract(path, '^([^/]+/[^/]+)', 1) AS cluster FROM f), t AS (SELECT 'sql_unit:' || src_id AS node, 'table:' || max(dst_id) AS cluster FROM e WHERE edge_kind = 'use_table' AND dst_type = 'table' AND dst_id IS NOT NULL AND src_type = 'sql_unit' GROUP BY 1) SELECT node, cluster FROM d UNION ALL SELECT node, cluster FROM t")
def ref_g10_rule_clusters(m):
    d = m.files().select(F.concat(F.lit("file:"), F.col("file_id").cast("string")).alias("node"), F.regexp_extract("path", "^([^/]+/[^/]+)", 1).alias("cluster"))
    t = m.edges("src_type", "src_id", "dst_type", "dst_id", "edge_kind").where("edge_kind = 'use_table' and dst_type = 'table' and dst_id is not null and src_type = 'sql_unit'").groupBy("src_id").agg(F.max("dst_id").alias("t"))
    return d.unionByName(t.select(F.concat(F.lit("sql_unit:"), F.col("src_id").cast("string")).alias("node"), F.concat(F.lit("table:"), F.col("t").cast("string")).alias("cluster")))


@query(f"WITH {EDGES}, {NODES}, x AS (SELECT regexp_extract(fa.path, '^([^/]+)/', 1) AS a, regexp_extract(fb.path, '^([^/]+)/', 1) AS b, e.edge_kind, e.confidence FROM e JOIN n na ON na.node_type = e.src_type AND na.node_id = e.src_id JOIN n nb ON nb.node_type = e.dst_type AND nb.node_id = e.dst_id JOIN f fa ON fa.file_id = na.file_id JOIN f fb ON fb.file_id = nb.file_id) SELECT a AS src_component, b AS dst_component, count(*) AS edges, CASE WHEN count(DISTINCT edge_kind) > 1 THEN 'mixed' ELSE min(edge_kind) END AS kind FROM x WHERE a <> b GROUP BY 1, 2")
def ref_g11_component_rollup(m):
    n = m.nodes().join(m.files().select("file_id", F.regexp_extract("path", "^([^/]+)/", 1).alias("component")), "file_id")
    return R.pair_rollup(m.edges("src_type", "src_id", "dst_type", "dst_id", "edge_kind", "confidence"), n, "component", "src_component", "dst_component").where("src_component <> dst_component").select("src_component", "dst_component", "edges", "kind")


_CLEAN = r"regexp_replace(regexp_replace(content, '/\*[^*]*\*+([^/*][^*]*\*+)*/', ' ', 'g'), '--[^\n]*', ' ', 'g')"
_SQLT = f"{FILES}, {CONTENTS}, x AS (SELECT f.file_id, {_CLEAN} AS clean, regexp_replace({_CLEAN}, '[ \\t\\r\\n]+', ' ', 'g') AS flat FROM t JOIN f USING (file_id) WHERE f.path LIKE '%.sql' AND content IS NOT NULL)"


def _sql_texts(m: Model):
    return m.contents().where("content is not null").join(m.files().where("path like '%.sql'").select("file_id"), "file_id")


@query(f"WITH {_SQLT}, s AS (SELECT unnest(string_split(flat, ';')) AS st FROM x), c AS (SELECT upper(regexp_extract(st, '(?i)CREATE TABLE ([A-Za-z0-9_]+)', 1)) AS tab, unnest(regexp_extract_all(st, '[(,] ?([a-z_]+) (?:NUMBER|VARCHAR2|DATE)', 1)) AS col FROM s WHERE regexp_matches(st, '(?i)CREATE TABLE [A-Za-z0-9_]+')) SELECT tab, string_agg(DISTINCT col, ',' ORDER BY col) AS columns, count(DISTINCT col) AS n FROM c GROUP BY 1")
def ref_g12_erd_nodes(m):
    flat = F.regexp_replace(sqltext.without_comments("content"), r"[ \t\r\n]+", " ")
    s = _sql_texts(m).select(F.explode(F.split(flat, ";")).alias("st")).where(F.col("st").rlike("(?i)CREATE TABLE [A-Za-z0-9_]+"))
    c = s.select(F.upper(F.regexp_extract("st", "(?i)CREATE TABLE ([A-Za-z0-9_]+)", 1)).alias("tab"), F.explode(F.regexp_extract_all("st", F.lit(r"[(,] ?([a-z_]+) (?:NUMBER|VARCHAR2|DATE)"), F.lit(1))).alias("col"))
    return c.groupBy("tab").agg(F.array_join(F.sort_array(F.collect_set("col")), ",").alias("columns"), F.countDistinct("col").alias("n"))


_JOINP = r"(?i)\bFROM\s+([A-Za-z_][A-Za-z0-9_]*)\s+[a-z]\s+(?:LEFT\s+)?JOIN\s+([A-Za-z_][A-Za-z0-9_]*)"


@query(f"WITH {_SQLT}, j AS (SELECT upper(unnest(regexp_extract_all(clean, '{_JOINP}', 1))) AS a, upper(unnest(regexp_extract_all(clean, '{_JOINP}', 2))) AS b FROM x) SELECT least(a, b) AS table1, greatest(a, b) AS table2, count(*) AS frequency, CASE WHEN count(*) > 1 THEN 80 ELSE 70 END AS pct FROM j GROUP BY 1, 2")
def ref_g12_erd_edges(m):
    a, b = (F.regexp_extract_all(sqltext.without_comments("content"), F.lit(_JOINP), F.lit(i)) for i in (1, 2))
    j = _sql_texts(m).select(F.explode(F.arrays_zip(a.alias("a"), b.alias("b"))).alias("j")).select(F.upper("j.a").alias("a"), F.upper("j.b").alias("b"))
    x = j.groupBy(F.least("a", "b").alias("table1"), F.greatest("a", "b").alias("table2")).agg(F.count(F.lit(1)).alias("frequency"))
    return x.withColumn("pct", F.when(F.col("frequency") > 1, 80).otherwise(70))


@query(f"WITH {COMPONENTS}, k AS (SELECT parent_component_id AS class_id, component_name AS name, row_number() OVER (PARTITION BY parent_component_id ORDER BY component_name, component_id) AS rn FROM c WHERE component_type = 'method' AND parent_component_id IS NOT NULL) SELECT class_id, string_agg(name, ',' ORDER BY rn) FILTER (rn <= 10) AS methods, count(*) AS total FROM k GROUP BY 1")
def ref_g13_class_diagram(m):
    k = m.components("component_name", "component_type", "parent_component_id").where("component_type = 'method' and parent_component_id is not null").select(F.col("parent_component_id").alias("class_id"), F.col("component_name").alias("name"), "component_id")
    rn = F.row_number().over(W.partitionBy("class_id").orderBy("name", "component_id"))
    k = k.withColumn("rn", rn)
    first = F.sort_array(F.collect_list(F.when(F.col("rn") <= 10, F.struct("rn", "name"))))
    return k.groupBy("class_id").agg(F.array_join(F.transform(first, lambda x: x["name"]), ",").alias("methods"), F.count(F.lit(1)).alias("total"))


@query(f"WITH {EDGES}, x AS (SELECT least(src_type || ':' || src_id, dst_type || ':' || dst_id) AS a, greatest(src_type || ':' || src_id, dst_type || ':' || dst_id) AS b, CASE edge_kind WHEN 'extends' THEN 90 WHEN 'implements' THEN 90 WHEN 'use_table' THEN 75 WHEN 'call' THEN 70 WHEN 'include' THEN 60 ELSE 50 END AS score, edge_kind FROM e WHERE dst_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, edge_kind) AS rn FROM x) SELECT a AS node1, b AS node2, score FROM r WHERE rn = 1 AND score >= 75 ORDER BY score DESC, a, b LIMIT 200")
def ref_g14_relatedness_graph(m):
    return R.best_per_pair(m.edges("src_type", "src_id", "dst_type", "dst_id", "edge_kind")).where("score >= 75").orderBy(F.desc("score"), "node1", "node2").limit(200).select("node1", "node2", "score")


@query(f"WITH {COMPONENTS} SELECT project_id, component_id, CAST((row_number() OVER (PARTITION BY project_id ORDER BY component_id) - 1) // 8 AS INTEGER) AS y, (row_number() OVER (PARTITION BY project_id ORDER BY component_id) - 1) % 8 AS x FROM c WHERE component_type = 'class'")
def ref_g15_grid_positions(m):
    return G.grid_positions(m.components("project_id", "component_type").where("component_type = 'class'"), "component_id", 8, "project_id")


@query(f"WITH {FILES}, {COMPONENTS}, k AS (SELECT file_id, count(*) FILTER (component_type = 'class') AS classes, count(*) FILTER (component_type = 'method') AS methods, string_agg(component_name, ',' ORDER BY component_id) FILTER (component_type = 'class') AS names FROM c GROUP BY 1) SELECT f.file_id, f.path, k.classes, k.methods, k.names FROM f JOIN k USING (file_id)")
def ref_g16_hierarchy_assembly(m):
    c = F.col("component_type")
    names = F.sort_array(F.collect_list(F.when(c == "class", F.struct("component_id", "component_name"))))
    k = m.components("file_id", "component_name", "component_type").groupBy("file_id").agg(F.count_if(c == "class").alias("classes"), F.count_if(c == "method").alias("methods"), names.alias("l"))
    k = k.withColumn("names", F.when(F.size("l") > 0, F.array_join(F.transform("l", lambda x: x["component_name"]), ",")))
    return m.files().join(k, "file_id").select("file_id", "path", "classes", "methods", "names")


@query(f"WITH {COMPONENTS}, {HINTS}, x AS (SELECT hint_id, src_id, CAST(round(confidence * 100) AS BIGINT) AS pct, json_extract_string(hint, '$.called_name') AS called FROM h WHERE src_type = 'method' AND hint_type = 'method_call' AND json_valid(hint) AND confidence IS NOT NULL), n AS (SELECT component_name, min(component_id) AS target FROM c WHERE component_type = 'method' GROUP BY 1) SELECT x.hint_id, n.target, CASE WHEN n.target IS NOT NULL THEN least(100, pct + 20) ELSE greatest(10, pct - 30) END AS pct FROM x LEFT JOIN n ON n.component_name = x.called")
def ref_g17_call_resolution(m):
    x = m.hints().where("src_type = 'method' and hint_type = 'method_call' and confidence is not null").where(F.expr("try_parse_json(hint) is not null"))
    x = x.select("hint_id", F.round(F.col("confidence") * 100).cast("long").alias("p"), F.get_json_object("hint", "$.called_name").alias("component_name"))
    n = m.components("component_name", "component_type").where("component_type = 'method'").groupBy("component_name").agg(F.min("component_id").alias("target"))
    return x.join(n, "component_name", "left").select("hint_id", "target", F.when(F.col("target").isNotNull(), F.least(F.lit(100), F.col("p") + 20)).otherwise(F.greatest(F.lit(10), F.col("p") - 30)).alias("pct"))


@query(f"WITH {HINTS}, {UNITS}, x AS (SELECT hint_id, src_id, json_extract_string(hint, '$.target') AS target FROM h WHERE hint_type LIKE '%include%' AND json_valid(hint)), u AS (SELECT stmt_id, min(sql_id) AS sql_id FROM s WHERE stmt_id IS NOT NULL GROUP BY 1) SELECT x.hint_id, x.target, u.sql_id FROM x LEFT JOIN u ON u.stmt_id = x.target")
def ref_g18_include_resolution(m):
    x = m.hints().where("hint_type like '%include%'").where(F.expr("try_parse_json(hint) is not null")).select("hint_id", F.get_json_object("hint", "$.target").alias("target"))
    u = m.sql_units().where("stmt_id is not null").groupBy(F.col("stmt_id").alias("target")).agg(F.min("sql_id").alias("sql_id"))
    return x.join(u, "target", "left").select("hint_id", "target", "sql_id")


_TAB = r"(?i)\b(?:FROM|JOIN|UPDATE|INTO)\s+([A-Za-z_][A-Za-z0-9_$#.]*)"


@query(f"WITH {_SQLT}, u AS (SELECT DISTINCT file_id, upper(unnest(regexp_extract_all(clean, '{_TAB}', 1))) AS tab FROM x), d AS (SELECT upper(table_name) AS tab, min(table_id) AS table_id FROM db_tables GROUP BY 1) SELECT u.file_id, u.tab, d.table_id, CASE WHEN d.table_id IS NOT NULL THEN 80 ELSE 30 END AS pct FROM u LEFT JOIN d USING (tab)")
def ref_g19_table_usage(m):
    u = _sql_texts(m).select("file_id", F.explode(sqltext.tables("content")).alias("tab"))
    d = m.tables().groupBy(F.upper("table_name").alias("tab")).agg(F.min("table_id").alias("table_id"))
    return u.join(d, "tab", "left").select("file_id", "tab", "table_id", F.when(F.col("table_id").isNotNull(), 80).otherwise(30).alias("pct"))


@query(f"WITH {EDGES}, {COMPONENTS}, x AS (SELECT edge_id, json_extract_string(meta, '$.called_name') AS called FROM e WHERE dst_id IS NULL AND meta IS NOT NULL AND json_valid(meta)), n AS (SELECT component_name, min(component_id) AS target FROM c WHERE component_type = 'method' GROUP BY 1) SELECT x.edge_id, n.target FROM x JOIN n ON n.component_name = x.called")
def ref_g20_edge_repair(m):
    x = m.edges("dst_id", "meta").where("dst_id is null and meta is not null").select("edge_id", F.get_json_object("meta", "$.called_name").alias("component_name"))
    n = m.components("component_name", "component_type").where("component_type = 'method'").groupBy("component_name").agg(F.min("component_id").alias("target"))
    return x.join(n, "component_name").select("edge_id", "target")


@query(f"WITH {FILES}, d AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, file_id FROM f), y AS (SELECT dir, file_id AS src, lead(file_id) OVER (PARTITION BY dir ORDER BY file_id) AS dst FROM d) SELECT dir, src, dst, 40 AS pct FROM y WHERE dst IS NOT NULL")
def ref_g21_package_fallback(m):
    d = m.files().select(paths.dirname("path").alias("dir"), F.col("file_id").alias("src"))
    return d.withColumn("dst", F.lead("src").over(W.partitionBy("dir").orderBy("src"))).where("dst is not null").withColumn("pct", F.lit(40))


@query(f"WITH {EDGES} SELECT project_id, bool_or(edge_kind = 'call') AS calls, bool_or(edge_kind = 'use_table') AS tables, bool_or(edge_kind IN ('extends', 'implements')) AS inheritance, bool_or(dst_id IS NULL) AS unresolved, count(DISTINCT edge_kind) AS kinds FROM e GROUP BY 1")
def ref_g22_pattern_availability(m):
    k = F.col("edge_kind")
    return m.edges("project_id", "dst_id", "edge_kind").groupBy("project_id").agg(F.bool_or(k == "call").alias("calls"), F.bool_or(k == "use_table").alias("tables"), F.bool_or(k.isin("extends", "implements")).alias("inheritance"), F.bool_or(F.col("dst_id").isNull()).alias("unresolved"), F.countDistinct("edge_kind").alias("kinds"))


# M: maintenance ---------------------------------------------------------------------
@query(f"WITH {EDGES}, new AS (SELECT edge_id + 1000000 AS edge_id, project_id FROM e WHERE edge_kind = 'mybatis_include' AND confidence >= 0.9) SELECT edge_id, project_id FROM e WHERE project_id NOT IN (SELECT project_id FROM new) UNION ALL SELECT edge_id, project_id FROM new")
def ref_m2_replace_partition(m):
    e = m.edges().select("edge_id", "project_id", "edge_kind", "confidence")
    new = e.where("edge_kind = 'mybatis_include' and confidence >= 0.9").select((F.col("edge_id") + 1_000_000).alias("edge_id"), "project_id")
    return D.replaced(e.select("edge_id", "project_id"), new, "project_id")


@query(f"WITH {EDGES}, {FILES}, {COMPONENTS}, gone AS (SELECT DISTINCT node_id AS file_id FROM removed_nodes WHERE lower(node_type) = 'file'), dead AS (SELECT 'file' AS t, file_id AS id FROM gone UNION ALL SELECT component_type, component_id FROM c WHERE file_id IN (SELECT file_id FROM gone)) SELECT edge_id FROM e WHERE NOT EXISTS (SELECT 1 FROM dead WHERE t = src_type AND id = src_id) AND NOT EXISTS (SELECT 1 FROM dead WHERE t = dst_type AND id = dst_id)")
def ref_m3_cascade_delete(m):
    return D.cascade_delete(m.files(), m.components(), m.edges(), m.raw("removed_nodes").where("lower(node_type) = 'file'").select(F.col("node_id").alias("file_id")).distinct()).select("edge_id")


@query(f"WITH {COMPONENTS}, k AS (SELECT component_id, min(component_id) OVER (PARTITION BY project_id, component_name) AS keep FROM c WHERE component_type = 'class') SELECT x.component_id, coalesce(k.keep, x.parent_component_id) AS parent_component_id FROM c x LEFT JOIN k ON k.component_id = x.parent_component_id WHERE x.component_type = 'method'")
def ref_m4_repoint_children(m):
    c = m.components()
    p = c.where("component_type = 'class'").select("project_id", "component_name", "component_id")
    x = c.where("component_type = 'method'").select(F.col("component_id").alias("child"), "parent_component_id")
    return D.repointed(p, x, ["project_id", "component_name"], "component_id", "parent_component_id").select(F.col("child").alias("component_id"), "parent_component_id")


@query(f"WITH {UNITS} SELECT min(sql_id) AS sql_id, file_id, stmt_id FROM s GROUP BY file_id, stmt_id")
def ref_m5_dedupe_units(m):
    return m.sql_units().groupBy("file_id", "stmt_id").agg(F.min("sql_id").alias("sql_id"))


@query("SELECT min(edge_id) AS edge_id, count(*) AS copies FROM edges GROUP BY project_id, src_type, src_id, dst_type, coalesce(dst_id, -999), edge_kind, coalesce(confidence, -1), created_at")
def ref_m6_dedupe_edges(m):
    keys = ["project_id", "src_type", "src_id", "dst_type", F.coalesce("dst_id", F.lit(-999)).alias("d"), "edge_kind", F.coalesce("confidence", F.lit(-1.0)).alias("c"), "created_at"]
    return m.raw("edges").groupBy(*keys).agg(F.min("edge_id").alias("edge_id"), F.count(F.lit(1)).alias("copies")).select("edge_id", "copies")


@query(f"WITH {EDGES}, {NODES}, old AS (SELECT * FROM e WHERE confidence >= 0.8), new AS (SELECT * FROM e WHERE confidence < 0.8 AND confidence >= 0.3 AND dst_id IS NOT NULL), x AS (SELECT src_type, src_id, dst_type, dst_id, edge_kind, max(confidence) AS confidence FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.src_type = new.src_type AND old.src_id = new.src_id AND old.dst_type = new.dst_type AND old.dst_id = new.dst_id AND old.edge_kind = new.edge_kind) GROUP BY ALL) SELECT x.src_type, x.src_id, x.dst_type, x.dst_id, x.edge_kind, x.confidence, n.node_id IS NULL AS dummy FROM x LEFT JOIN n ON n.node_type = x.dst_type AND n.node_id = x.dst_id")
def ref_m7_edge_upsert(m):
    e = m.edges()
    return D.upsert_edges(e.where("confidence >= 0.8"), e.where("confidence < 0.8"), m.nodes()).drop("meta")


@query(f"WITH {_SQLT}, u AS (SELECT DISTINCT upper(unnest(regexp_extract_all(clean, '{_TAB}', 1))) AS table_name FROM x) SELECT table_name, 'INFERRED' AS status FROM u WHERE table_name NOT IN ('A','B','C','T','T1','T2','U','P','M') AND table_name NOT IN (SELECT upper(table_name) FROM db_tables)")
def ref_m8_inferred_tables(m):
    u = _sql_texts(m).select(F.explode(sqltext.tables("content")).alias("table_name"))
    return D.inferred_tables(u, m.tables())


@query("WITH a AS (SELECT coalesce(owner, '-') AS owner, table_name, max(status) AS status, max(table_comment) AS table_comment FROM db_tables GROUP BY 1, 2), b AS (SELECT owner, table_name, 'VALID' AS status, 'loaded' AS table_comment FROM a WHERE table_comment IS NULL UNION ALL SELECT 'NEW', 'T_FRESH', 'VALID', NULL) SELECT coalesce(a.owner, b.owner) AS owner, coalesce(a.table_name, b.table_name) AS table_name, CASE WHEN b.status IS NOT NULL AND (a.status IS NULL OR starts_with(a.status, 'INFERRED')) THEN b.status ELSE a.status END AS status, CASE WHEN b.status IS NOT NULL THEN coalesce(b.table_comment, a.table_comment) ELSE a.table_comment END AS table_comment FROM a FULL JOIN b ON a.owner = b.owner AND a.table_name = b.table_name")
def ref_m9_catalog_upsert(m):
    a = m.tables().groupBy(F.coalesce("owner", F.lit("-")).alias("owner"), "table_name").agg(F.max("status").alias("status"), F.max("table_comment").alias("table_comment"))
    b = a.where("table_comment is null").select("owner", "table_name", F.lit("VALID").alias("status"), F.lit("loaded").alias("table_comment"))
    b = b.unionByName(m.spark.createDataFrame([("NEW", "T_FRESH", "VALID", None)], "owner string, table_name string, status string, table_comment string"))
    return D.merged_catalog(a, b, ["owner", "table_name"])


@query(f"WITH {_SQLT}, c AS (SELECT DISTINCT upper(unnest(regexp_extract_all(clean, '(?i)COMMENT ON COLUMN ([A-Za-z0-9_]+)\\.', 1))) AS table_name FROM x) SELECT table_name, 'INFERRED_FROM_COLUMNS' AS status FROM c WHERE table_name NOT IN (SELECT table_name FROM db_tables)")
def ref_m10_tables_of_columns(m):
    c = _sql_texts(m).select(F.explode(F.regexp_extract_all(sqltext.without_comments("content"), F.lit(r"(?i)COMMENT ON COLUMN ([A-Za-z0-9_]+)\."), F.lit(1))).alias("t")).select(F.upper("t").alias("table_name"))
    return D.orphan_column_tables(c, m.tables())


@query(f"WITH {FILES}, {CONTENTS}, a AS (SELECT file_id, hash FROM f), b AS (SELECT file_id, sha256(content) AS hash FROM t WHERE content IS NOT NULL) SELECT coalesce(a.file_id, b.file_id) AS file_id, CASE WHEN a.file_id IS NULL THEN 'added' WHEN b.file_id IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.file_id = b.file_id WHERE a.file_id IS NULL OR b.file_id IS NULL OR a.hash IS DISTINCT FROM b.hash")
def ref_incremental_changes(m):
    """Files whose recorded hash is not that of their present text."""
    now = m.contents().where("content is not null").select("file_id", F.sha2("content", 256).alias("hash"))
    return D.changed_files(m.files().select("file_id", "hash"), now, "file_id", "hash")


# K: exports ------------------------------------------------------------------------
@query(f"WITH {EDGES} SELECT edge_id AS id, src_type || ':' || src_id AS source, dst_type || ':' || dst_id AS target, edge_kind AS kind, confidence FROM e WHERE dst_id IS NOT NULL AND (confidence >= 0.7 OR edge_kind IN ('extends', 'implements'))")
def ref_k2_edge_rows(m):
    return K.edge_rows(m.edges("src_type", "src_id", "dst_type", "dst_id", "edge_kind", "confidence"), 0.7, ["extends", "implements"])


@query(f"WITH {NODES} SELECT node_type || ':' || node_id AS id, label, node_type AS type, CAST(coalesce(project_id, -1) AS VARCHAR) AS grp FROM n")
def ref_k2_node_rows(m):
    return K.node_rows(m.nodes())


@query(f"WITH {EDGES} SELECT '    ' || regexp_replace(src_type || '_' || src_id, '[^A-Za-z0-9_]', '_', 'g') || ' -->|' || edge_kind || '| ' || regexp_replace(dst_type || '_' || dst_id, '[^A-Za-z0-9_]', '_', 'g') AS line, count(*) AS n FROM e WHERE dst_id IS NOT NULL AND confidence >= 0.8 GROUP BY 1")
def ref_k3_mermaid_lines(m):
    return K.mermaid_lines(m.edges("src_type", "src_id", "dst_type", "dst_id", "edge_kind", "confidence").where("dst_id is not null and confidence >= 0.8")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query(f"{FOUND} SELECT o.file_id, CAST(line_no AS INTEGER) AS line_no, kind AS rule_id, CASE severity WHEN 'medium' THEN 'warning' ELSE 'error' END AS level, path AS uri FROM o JOIN f USING (file_id) WHERE rn = 1")
def ref_k5_findings(m):
    x = m.contents().join(m.files().select("file_id", "path"), "file_id")
    hits = findings.scan(x, "file_id", "content", "path").join(m.files().select("file_id", F.col("path").alias("uri")), "file_id")
    return hits.select("file_id", "line_no", F.col("kind").alias("rule_id"), F.when(F.col("severity") == "medium", "warning").otherwise("error").alias("level"), "uri")


@query(f"WITH {NODES} SELECT node_type, node_id, label FROM n WHERE file_id = 10 OR label LIKE '%DepotDao%'")
def ref_k8_reads(m):
    return m.nodes().where((F.col("file_id") == 10) | F.col("label").contains("DepotDao")).select("node_type", "node_id", "label")


@query("SELECT file_id, len(string_split(content, chr(10))) - 1 AS rows FROM (SELECT file_id, max(content) AS content FROM file_contents GROUP BY 1) WHERE content IS NOT NULL")
def ref_s10_row_estimate(m):
    return m.contents().where("content is not null").select("file_id", (F.size(F.split("content", "\n")) - 1).alias("rows"))


@query("SELECT project_id, name, root_path FROM projects")
def ref_s11_table_scan(m):
    return m.projects().select("project_id", "name", "root_path")


@query(f"WITH {FILES} SELECT file_id, path FROM f WHERE (path LIKE '%.java' OR path LIKE '%.xml') AND NOT (contains(path, '/target/') OR contains(path, '/build/') OR contains(path, 'node_modules'))")
def ref_s1_include_exclude(m):
    from lodegraph.sources.scans import included

    return m.files().where(included("path", ["**/*.java", "**/*.xml"], ["**/target/", "**/build/", "node_modules"])).select("file_id", "path")


@query(f"WITH {FILES}, {CONTENTS}, l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS pos FROM t WHERE content IS NOT NULL) SELECT file_id, CAST(pos // 100 AS INTEGER) AS chunk, count(*) AS lines FROM l GROUP BY 1, 2")
def ref_s8_chunk_scan(m):
    return X.line_chunks(m.contents(), "file_id", "content", 100).select("file_id", "chunk", "lines")


@query("SELECT window_start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type FROM events) GROUP BY 1, 2")
def ref_stream_hourly_events(m):
    from lodegraph.streaming.monitor import hourly

    return hourly(m.spark, m.directory)


@query("SELECT event_id, event_type FROM events")
def ref_stream_seen_once(m):
    from lodegraph.streaming.monitor import seen_once

    return seen_once(m.spark, m.directory)


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
