"""What views of a project are built from: relatedness, components, diagrams, resolved calls and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import code, findings, paths, sqltext
from lodegraph.model import COMPONENTS, CONTENTS, EDGES, FILES, HINTS, NODES, Model
from lodegraph.operators import dml as D
from lodegraph.operators import extract as X
from lodegraph.operators import relational as R
from lodegraph.plans.extraction import LINKS, _of, _targets_sql
from lodegraph.plans.text import _SQLFILES, _T, _texts
from lodegraph.sources import scans, sinks

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = lambda spark, d: f(Model(spark, d))
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


# Relatedness: linked pairs by the best of three strategies ------------------------------
_SUFFIX = "(Service|Controller|Repository|DAO|DTO|VO|Impl|Test)$"
_RELATED = f"""{EDGES}, {NODES}, en AS (SELECT least(src_type || ':' || src_id, dst_type || ':' || dst_id) AS node1, greatest(src_type || ':' || src_id, dst_type || ':' || dst_id) AS node2, CASE edge_kind WHEN 'extends' THEN 90 WHEN 'implements' THEN 90 WHEN 'use_table' THEN 75 WHEN 'call' THEN 70 WHEN 'include' THEN 60 ELSE 50 END AS score, edge_kind FROM e WHERE dst_id IS NOT NULL),
  eb AS (SELECT node1, node2, max(score) AS score, arg_min(edge_kind, (-score, edge_kind)) AS reason FROM en GROUP BY 1, 2),
  nk AS (SELECT node_type || ':' || node_id AS k, node_type, label, project_id FROM n),
  rl AS (SELECT eb.node1, eb.node2, eb.score AS edge_score, eb.reason, CASE WHEN a.node_type = 'file' AND b.node_type = 'file' AND regexp_extract(a.label, '^(.*)/[^/]*$', 1) = regexp_extract(b.label, '^(.*)/[^/]*$', 1) THEN 60 WHEN a.node_type IN ('class', 'interface') AND b.node_type IN ('class', 'interface') AND a.project_id = b.project_id AND regexp_replace(a.label, '{_SUFFIX}', '') = regexp_replace(b.label, '{_SUFFIX}', '') THEN 80 ELSE 0 END AS other, a.project_id FROM eb LEFT JOIN nk a ON a.k = eb.node1 LEFT JOIN nk b ON b.k = eb.node2),
  rb AS (SELECT node1, node2, project_id, greatest(edge_score, other) AS score, CASE WHEN other > edge_score THEN CASE other WHEN 80 THEN 'naming' ELSE 'proximity' END ELSE reason END AS reason FROM rl)"""


def relatedness(m: Model) -> DataFrame:
    """(node1, node2, project_id, score, reason) of linked pairs: a strategy takes over where it scores higher.

    Pairs that only share a directory or a name stand in their groups (ref_j13, ref_c12); they are not multiplied out.
    """
    k = m.nodes().select(F.concat_ws(":", "node_type", "node_id").alias("k"), "node_type", "label", "project_id")
    one = lambda i: k.select(F.col("k").alias(f"node{i}"), F.col("node_type").alias(f"t{i}"), F.col("label").alias(f"l{i}"), F.col("project_id").alias(f"p{i}"))
    x = R.best_per_pair(m.edges("project_id", "src_type", "src_id", "dst_type", "dst_id", "edge_kind")).join(one(1), "node1", "left").join(one(2), "node2", "left")
    typed = lambda *t: F.col("t1").isin(*t) & F.col("t2").isin(*t)
    near = typed("file") & (paths.dirname("l1") == paths.dirname("l2"))
    named = typed("class", "interface") & (F.col("p1") == F.col("p2")) & (code.suffix_stripped("l1") == code.suffix_stripped("l2"))
    other = F.when(near, 60).when(named, 80).otherwise(0)
    reason = F.when(other > F.col("score"), F.when(other == 80, "naming").otherwise("proximity")).otherwise(F.col("reason"))
    return x.select("node1", "node2", F.col("p1").alias("project_id"), F.greatest("score", other).alias("score"), reason.alias("reason"))


@query(f"WITH {_RELATED} SELECT node1, node2, score, reason FROM rb")
def ref_a10_best_of_strategies(m):
    return relatedness(m).select("node1", "node2", "score", "reason")


@query(f"WITH {_RELATED} SELECT project_id, score, reason, count(*) AS pairs FROM rb WHERE project_id IS NOT NULL GROUP BY 1, 2, 3")
def ref_m2_relatedness_by_project(m):
    """What is stored per project; a project's rows are replaced by overwriting its partition (sinks.write_partitioned)."""
    return relatedness(m).where("project_id is not null").groupBy("project_id", "score", "reason").agg(F.count(F.lit(1)).alias("pairs"))


@query(f"WITH {_RELATED}, k AS (SELECT node1, node2, score FROM rb WHERE score >= 60 AND NOT (split_part(node1, ':', 1) IN ('class', 'interface') AND split_part(node2, ':', 1) = 'file' AND reason = 'naming') ORDER BY score DESC, node1, node2 LIMIT 400) SELECT node, count(*) AS pairs, max(score) AS best FROM (SELECT node1 AS node, score FROM k UNION ALL SELECT node2, score FROM k) GROUP BY 1")
def ref_g14_graph_nodes(m):
    """Nodes of the 400 strongest pairs, as the view of 200 nodes takes them (a top-k report)."""
    k = relatedness(m).where("score >= 60").where(~(F.split_part("node1", F.lit(":"), F.lit(1)).isin("class", "interface") & F.col("node2").startswith("file:") & (F.col("reason") == "naming")))
    k = k.orderBy(F.desc("score"), "node1", "node2").limit(400)
    n = k.select(F.col("node1").alias("node"), "score").union(k.select("node2", "score"))
    return n.groupBy("node").agg(F.count(F.lit(1)).alias("pairs"), F.max("score").alias("best"))


# Confidence against what was recorded -----------------------------------------------------
@query(f"WITH {EDGES}, k AS (SELECT edge_kind, CAST(floor(confidence * 1000 + 0.5) AS BIGINT) AS c FROM e WHERE confidence IS NOT NULL), g AS (SELECT edge_kind, count(*) AS n, CAST(sum(c) AS BIGINT) AS s, CAST(sum(c * c) AS BIGINT) AS ss, CAST(sum(abs(c - 750)) AS BIGINT) AS d, median(c) AS median FROM k GROUP BY 1) SELECT edge_kind, n, CAST(s AS DOUBLE) / n AS mean, median, CASE WHEN n > 1 THEN sqrt((CAST(n AS DOUBLE) * ss - CAST(s AS DOUBLE) * s) / (CAST(n AS DOUBLE) * (n - 1))) END AS stdev, CAST(d AS DOUBLE) / n AS mae FROM g")
def ref_a12_deviation(m):
    """Mean, median, sample deviation and mean absolute error against the expected 0.75, in thousandths; sums are whole numbers, so order doesn't matter."""
    c, n = F.floor(F.col("confidence") * 1000 + 0.5).cast("long"), F.col("n").cast("double")
    k = m.edges("edge_kind", "confidence").where("confidence is not null").select("edge_kind", c.alias("c"))
    g = k.groupBy("edge_kind").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("ss"), F.sum(F.abs(F.col("c") - 750)).alias("d"), F.median("c").alias("median"))
    s = F.col("s").cast("double")
    return g.select("edge_kind", "n", (s / n).alias("mean"), "median", F.when(n > 1, F.sqrt((n * F.col("ss") - s * F.col("s")) / F.when(n > 1, n * (n - 1)))).alias("stdev"), (F.col("d").cast("double") / n).alias("mae"))


# Components and entry points ----------------------------------------------------------------
_ALL = ", ".join(f"('{n}')" for n, _ in findings.COMPONENTS)


@query(f"WITH {FILES}, g AS (SELECT project_id, {findings.component_sql('path')} AS component, count(*) AS files FROM f GROUP BY 1, 2), a AS (SELECT p.project_id, v.component FROM (SELECT DISTINCT project_id FROM f) p, (VALUES {_ALL}) v(component)) SELECT a.project_id, a.component, coalesce(g.files, 0) AS files, g.files IS NULL AS virtual FROM a LEFT JOIN g ON g.project_id IS NOT DISTINCT FROM a.project_id AND g.component = a.component")
def ref_g11_virtual_components(m):
    """All component groups of each project; those without a file are virtual."""
    f = m.files().select("project_id", findings.component_group(None, "path").alias("component"))
    names = [n for n, _ in findings.COMPONENTS]
    g = f.groupBy("project_id").pivot("component", names).agg(F.count(F.lit(1)))  # a column per rule
    x = g.select("project_id", F.explode(F.array(*[F.struct(F.lit(n).alias("component"), F.col(n).alias("n")) for n in names])).alias("c"))
    return x.select("project_id", "c.component", F.coalesce("c.n", F.lit(0)).alias("files"), F.col("c.n").isNull().alias("virtual"))


@query(f"WITH {EDGES}, {COMPONENTS}, calls AS (SELECT src_id AS id, count(*) AS n FROM e WHERE src_type = 'method' AND edge_kind IN ('call', 'call_unresolved') GROUP BY 1), busy AS (SELECT DISTINCT c.parent_component_id AS id FROM c JOIN calls ON calls.id = c.component_id WHERE c.component_type = 'method'), x AS (SELECT component_id, 10 AS p, 'controller' AS reason FROM c WHERE component_type = 'class' AND component_name LIKE '%Controller%' UNION ALL SELECT component_id, 8, 'service' FROM c WHERE component_type = 'class' AND component_name LIKE '%Service%' AND component_id IN (SELECT id FROM busy) UNION ALL SELECT component_id, 15, 'main' FROM c WHERE component_type = 'method' AND component_name = 'main' UNION ALL SELECT component_id, 5, 'test' FROM c WHERE component_type = 'method' AND lower(component_name) LIKE 'test%' UNION ALL SELECT component_id, least(7, n), 'calls' FROM (SELECT c.component_id, n FROM c JOIN calls ON calls.id = c.component_id WHERE c.component_type = 'method' AND n >= 2 ORDER BY n DESC, c.component_id LIMIT 10)), r AS (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY p DESC, reason) AS rn FROM x) SELECT component_id, CAST(p AS BIGINT) AS priority, reason FROM r WHERE rn = 1")
def ref_g5_all_entry_points(m):
    """Controllers, services that call, main and test methods, and the ten busiest callers; the highest priority of each counts."""
    c = m.components("component_name", "component_type", "parent_component_id")
    calls = m.edges("src_type", "src_id", "edge_kind").where("src_type = 'method' and edge_kind in ('call', 'call_unresolved')").groupBy(F.col("src_id").alias("component_id")).agg(F.count(F.lit(1)).alias("n"))
    methods = c.where("component_type = 'method'").join(calls, "component_id")
    busy = methods.select(F.col("parent_component_id").alias("component_id")).distinct().withColumn("busy", F.lit(True))
    top = methods.where("n >= 2").orderBy(F.desc("n"), "component_id").limit(10).select("component_id", F.least(F.lit(7), "n").cast("long").alias("top"))
    x = c.join(busy, "component_id", "left").join(top, "component_id", "left")
    cls, mth, n = F.col("component_type") == "class", F.col("component_type") == "method", F.col("component_name")
    rules = [(cls & n.contains("Controller"), 10, "controller"), (cls & n.contains("Service") & F.col("busy"), 8, "service"), (mth & (n == "main"), 15, "main"), (mth & F.lower(n).startswith("test"), 5, "test")]
    hits = [F.when(cond, F.struct((-F.lit(p)).cast("long").alias("p"), F.lit(r).alias("r"))) for cond, p, r in rules] + [F.when(F.col("top").isNotNull(), F.struct((-F.col("top")).alias("p"), F.lit("calls").alias("r")))]
    x = x.select("component_id", F.array_min(F.array_compact(F.array(*hits))).alias("best")).where("best is not null")
    return x.select("component_id", (-F.col("best.p")).alias("priority"), F.col("best.r").alias("reason"))


# Diagrams -------------------------------------------------------------------------------------
_ERD = r"(?i)\bFROM\s+([A-Za-z_][A-Za-z0-9_]*)\s+([a-z])\s+(?:LEFT\s+)?JOIN\s+([A-Za-z_][A-Za-z0-9_]*)\s+([a-z])\s+ON\s*\(?\s*([a-z])\.([A-Za-z0-9_]+)\s*=\s*([a-z])\.([A-Za-z0-9_]+)"
_G = lambda i: f"unnest(regexp_extract_all(clean, '{_ERD}', {i}))"
_PKS = r"pk AS (SELECT DISTINCT upper(regexp_extract(s, '(?i)CREATE TABLE ([A-Za-z0-9_]+)', 1)) AS tab, lower(regexp_extract(s, '(?i)PRIMARY KEY \(([A-Za-z0-9_]+)\)', 1)) AS col FROM (SELECT unnest(string_split(flat, ';')) AS s FROM x) WHERE regexp_matches(s, '(?i)CREATE TABLE [A-Za-z0-9_]+') AND regexp_matches(s, '(?i)PRIMARY KEY \('))"


@query(f"{_T}, {_SQLFILES}, {_PKS}, j AS (SELECT upper({_G(1)}) AS t1, lower({_G(2)}) AS a1, upper({_G(3)}) AS t2, lower({_G(4)}) AS a2, lower({_G(5)}) AS la, lower({_G(6)}) AS lc, lower({_G(7)}) AS ra, lower({_G(8)}) AS rc FROM x), s AS (SELECT CASE WHEN la = a1 THEN t1 WHEN la = a2 THEN t2 END AS lt, lc, CASE WHEN ra = a1 THEN t1 WHEN ra = a2 THEN t2 END AS rt, rc FROM j), d AS (SELECT s.*, pl.tab IS NOT NULL AS lk, pr.tab IS NOT NULL AS rk FROM s LEFT JOIN pk pl ON pl.tab = lt AND pl.col = lc LEFT JOIN pk pr ON pr.tab = rt AND pr.col = rc WHERE lt IS NOT NULL AND rt IS NOT NULL AND lt <> rt), o AS (SELECT CASE WHEN rk AND NOT lk THEN rt WHEN lk AND NOT rk THEN lt ELSE least(lt, rt) END AS source, CASE WHEN rk AND NOT lk THEN lt WHEN lk AND NOT rk THEN rt ELSE greatest(lt, rt) END AS target, CASE WHEN lk <> rk THEN 80 ELSE 70 END AS pct FROM d) SELECT source, target, count(*) AS joins, max(pct) AS pct FROM o GROUP BY 1, 2")
def ref_g12_erd_directed_edges(m):
    """Joins between tables, from the side whose column is a primary key; by name where neither or both are."""
    t = _texts(m, ".sql")
    clean = sqltext.without_comments("content")
    parts = F.arrays_zip(*[F.regexp_extract_all(clean, F.lit(_ERD), F.lit(i)).alias(n) for i, n in enumerate(("t1", "a1", "t2", "a2", "la", "lc", "ra", "rc"), 1)])
    j = t.select(F.explode(parts).alias("j")).select(*[(F.upper if n[0] == "t" else F.lower)(f"j.{n}").alias(n) for n in ("t1", "a1", "t2", "a2", "la", "lc", "ra", "rc")])
    side = lambda a: F.when(F.col(a) == F.col("a1"), F.col("t1")).when(F.col(a) == F.col("a2"), F.col("t2"))
    s = j.select(side("la").alias("lt"), "lc", side("ra").alias("rt"), "rc").where("lt is not null and rt is not null and lt <> rt")
    pk = X.primary_keys(t, "content")
    s = s.join(pk.select(F.col("tab").alias("lt"), F.col("col").alias("lc"), F.lit(True).alias("lk")), ["lt", "lc"], "left").join(pk.select(F.col("tab").alias("rt"), F.col("col").alias("rc"), F.lit(True).alias("rk")), ["rt", "rc"], "left").na.fill(False, ["lk", "rk"])
    right, left = F.expr("rk and not lk"), F.expr("lk and not rk")
    o = s.select(F.when(right, F.col("rt")).when(left, F.col("lt")).otherwise(F.least("lt", "rt")).alias("source"), F.when(right, F.col("lt")).when(left, F.col("rt")).otherwise(F.greatest("lt", "rt")).alias("target"), F.when(left | right, 80).otherwise(70).alias("pct"))
    return o.groupBy("source", "target").agg(F.count(F.lit(1)).alias("joins"), F.max("pct").alias("pct"))


_INHERITS = {"extends": r"\b(?:class|interface) [A-Z][A-Za-z0-9_]*(?:<[^>{]*>)? extends ([A-Z][A-Za-z0-9_]*)", "implements": r"\bclass [A-Z][A-Za-z0-9_<>, ]*? implements ([A-Z][A-Za-z0-9_]*)"}


@query(f"WITH {COMPONENTS}, {FILES}, {CONTENTS}, {_of('.java')}, k AS ({_targets_sql(_INHERITS)}), s AS (SELECT file_id, min(component_id) AS source FROM c WHERE component_type IN ('class', 'interface') GROUP BY 1), d AS (SELECT project_id, component_name AS name, min(component_id) AS target FROM c WHERE component_type IN ('class', 'interface') GROUP BY 1, 2) SELECT s.source, d.target, k.kind FROM k JOIN x USING (file_id) JOIN s USING (file_id) JOIN d ON d.project_id = x.project_id AND d.name = k.target")
def ref_g13_inheritance(m):
    """Inheritance between types of one project; types outside of it are left out."""
    x = _texts(m, ".java")
    c = m.components("project_id", "file_id", "component_name", "component_type").where("component_type in ('class', 'interface')")
    k = X.by_patterns(x, "file_id", "content", _INHERITS).withColumnRenamed("target", "name").join(x.select("file_id", "project_id"), "file_id")
    s = c.groupBy("file_id").agg(F.min("component_id").alias("source"))
    d = c.groupBy("project_id", F.col("component_name").alias("name")).agg(F.min("component_id").alias("target"))
    return k.join(s, "file_id").join(d, ["project_id", "name"]).select("source", "target", "kind")


# Resolution --------------------------------------------------------------------------------------
@query(f"WITH {COMPONENTS}, {HINTS}, x AS (SELECT hint_id, src_id, confidence, json_extract_string(hint, '$.called_name') AS called FROM h WHERE src_type = 'method' AND hint_type = 'method_call' AND json_valid(hint) AND confidence IS NOT NULL), cand AS (SELECT x.hint_id, d.component_id AS target, CASE WHEN d.parent_component_id = src.parent_component_id THEN 1 WHEN d.file_id = src.file_id THEN 2 WHEN d.project_id = src.project_id THEN 3 ELSE 4 END AS tier FROM x JOIN c src ON src.component_id = x.src_id JOIN c d ON d.component_type = 'method' AND d.component_name = x.called), best AS (SELECT hint_id, target, tier FROM (SELECT *, row_number() OVER (PARTITION BY hint_id ORDER BY tier, target) AS rn FROM cand) WHERE rn = 1) SELECT x.hint_id, best.target, best.tier, CAST(floor(CASE WHEN target IS NULL THEN greatest(0.1::DOUBLE, confidence - 0.3::DOUBLE) ELSE least(1.0::DOUBLE, confidence + 0.2::DOUBLE) END * 1000 + 0.5000001) AS BIGINT) AS millis FROM (SELECT DISTINCT hint_id, confidence FROM x WHERE called IS NOT NULL) x LEFT JOIN best USING (hint_id)")
def ref_g17_resolved_calls(m):
    """Calls with their target by tier; certainty rises by 0.2 where there is one, up to 1, and falls by 0.3 otherwise, down to 0.1."""
    h = m.hints().where("src_type = 'method' and hint_type = 'method_call' and confidence is not null and get_json_object(hint, '$.called_name') is not null")
    best = R.resolve_calls(h, m.components("project_id", "file_id", "component_name", "component_type", "parent_component_id"))
    sure = F.when(F.col("target").isNull(), F.greatest(F.lit(0.1), F.col("confidence") - 0.3)).otherwise(F.least(F.lit(1.0), F.col("confidence") + 0.2))
    return h.select("hint_id", "confidence").distinct().join(best, "hint_id", "left").select("hint_id", "target", "tier", F.floor(sure * 1000 + 0.5000001).cast("long").alias("millis"))


_INCLUDE = {"include": LINKS["include"]}


@query(f"{_T}, {_of('.jsp')}, i AS (SELECT file_id, target FROM ({_targets_sql(_INCLUDE)})), n AS (SELECT i.file_id, i.target, x.project_id, regexp_replace(i.target, '^(\\.\\./|\\./|/)+', '') AS tail FROM i JOIN x USING (file_id)) SELECT n.file_id, n.target, min(f.file_id) AS included FROM n LEFT JOIN f ON f.project_id = n.project_id AND f.path LIKE '%/' || n.tail GROUP BY 1, 2")
def ref_g18_page_includes(m):
    """Pages to the pages that they include, by the end of the path within the project; null where there is none."""
    x = _texts(m, ".jsp")
    i = X.by_patterns(x, "file_id", "content", _INCLUDE).join(x.select("file_id", "project_id"), "file_id").withColumn("tail", F.regexp_replace("target", r"^(\.\./|\./|/)+", "")).withColumn("base", F.regexp_extract("target", "([^/]+)$", 1))
    f = m.files().select(F.col("file_id").alias("included"), "project_id", "path", F.regexp_extract("path", "([^/]+)$", 1).alias("base"))
    hits = i.join(f, ["project_id", "base"]).where(F.col("path").endswith(F.concat(F.lit("/"), F.col("tail")))).groupBy("file_id", "target").agg(F.min("included").alias("included"))
    return i.select("file_id", "target").distinct().join(hits, ["file_id", "target"], "left")


# Edges made anew -----------------------------------------------------------------------------------
@query(f"{_T}, {_SQLFILES}, u AS (SELECT DISTINCT file_id, upper(unnest(regexp_extract_all(clean, '(?i)\\b(?:FROM|JOIN|UPDATE|INTO)\\s+([A-Za-z_][A-Za-z0-9_$#.]*)', 1))) AS tab FROM x) SELECT 'file' AS src_type, u.file_id AS src_id, 'table' AS dst_type, d.table_id AS dst_id, 'use_table' AS edge_kind FROM u JOIN db_tables d ON upper(d.table_name) = u.tab")
def ref_m1_regenerated_edges(m):
    u = _texts(m, ".sql").select("file_id", F.explode(sqltext.tables("content")).alias("tab")).join(m.tables().select("table_id", F.upper("table_name").alias("tab")), "tab")
    made = u.select(F.lit("file").alias("src_type"), F.col("file_id").alias("src_id"), F.lit("table").alias("dst_type"), F.col("table_id").alias("dst_id"), F.lit("use_table").alias("edge_kind"))
    return D.regenerated(m.edges("src_type", "src_id", "dst_type", "dst_id", "edge_kind").select("src_type", "src_id", "dst_type", "dst_id", "edge_kind"), made)


# Exports and scans ------------------------------------------------------------------------------------
@query(f"WITH {EDGES}, {NODES}, z AS (SELECT a.label AS a, b.label AS b, e.edge_kind AS k, e.src_type AS st, e.dst_type AS dt FROM e JOIN n a ON a.node_type = e.src_type AND a.node_id = e.src_id JOIN n b ON b.node_type = e.dst_type AND b.node_id = e.dst_id), l AS (SELECT 'sequence' AS diagram, '    ' || regexp_replace(a, '[^A-Za-z0-9_]', '_', 'g') || '->>' || regexp_replace(b, '[^A-Za-z0-9_]', '_', 'g') || ': ' || k AS line FROM z WHERE st = 'method' AND dt = 'method' UNION ALL SELECT 'class', '    ' || regexp_replace(b, '[^A-Za-z0-9_]', '_', 'g') || CASE k WHEN 'extends' THEN ' <|-- ' ELSE ' <|.. ' END || regexp_replace(a, '[^A-Za-z0-9_]', '_', 'g') FROM z WHERE k IN ('extends', 'implements') UNION ALL SELECT 'erd', '    ' || regexp_replace(a, '[^A-Za-z0-9_]', '_', 'g') || ' }}o--|| ' || regexp_replace(b, '[^A-Za-z0-9_]', '_', 'g') || ' : ' || k FROM z WHERE dt = 'table') SELECT diagram, line, count(*) AS n FROM l GROUP BY 1, 2")
def ref_k3_diagram_lines(m):
    n = m.nodes()
    a = n.select(F.col("node_type").alias("src_type"), F.col("node_id").alias("src_id"), F.col("label").alias("a"))
    b = n.select(F.col("node_type").alias("dst_type"), F.col("node_id").alias("dst_id"), F.col("label").alias("b"))
    z = m.edges("src_type", "src_id", "dst_type", "dst_id", "edge_kind").select("src_type", "src_id", "dst_type", "dst_id", "edge_kind").join(a, ["src_type", "src_id"]).join(b, ["dst_type", "dst_id"])
    return sinks.diagram_lines(z).groupBy("diagram", "line").agg(F.count(F.lit(1)).alias("n"))


#: Settings of a project as its file gives them; globs kept and left out.
SETTINGS = """
include:
  - "**/*.java"
  - "**/*.xml"
exclude:
  - "**/test/**"
"""


@query(f"WITH {FILES} SELECT file_id FROM f WHERE (path LIKE '%.java' OR path LIKE '%.xml') AND path NOT LIKE '%/test/%'")
def ref_s2_filter_settings(m):
    return m.files().where(scans.included("path", *scans.filter_config(scans.read_settings(SETTINGS)))).select("file_id")


@query(f"{_T}, {_SQLFILES}, s AS (SELECT unnest(string_split(flat, ';')) AS st FROM x), c AS (SELECT upper(regexp_extract(st, '(?i)CREATE TABLE ([A-Za-z0-9_]+)', 1)) AS tab, unnest(regexp_extract_all(st, '[(,] ?([a-z_]+) (?:NUMBER|VARCHAR2|DATE)', 1)) AS col FROM s WHERE regexp_matches(st, '(?i)CREATE TABLE [A-Za-z0-9_]+')) SELECT tab AS table_name, count(*) AS columns FROM (SELECT DISTINCT tab, col FROM c) GROUP BY 1")
def ref_s5_column_list_tables(m):
    from lodegraph.plans.sources import declared_columns

    rows = declared_columns(m).select(F.col("tab").alias("table_name"), F.col("col").alias("column_name"), F.lit("N").alias("is_foreign_key"), F.lit(None).cast("string").alias("foreign_table"), F.lit(None).cast("string").alias("foreign_column")).distinct()
    return scans.column_list_csv(rows)[0]


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
