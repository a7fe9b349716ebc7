"""Scores, bins and findings over what the other operators extract: no input is made up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import code, findings, scoring, sqltext
from lodegraph.model import COMPONENTS, CONTENTS, EDGES, FILES, UNITS, Model
from lodegraph.operators import extract as X
from lodegraph.operators import relational as R
from lodegraph.plans.text import _CLEAN, _JOINS, _PK, _SQLFILES, _T, _texts

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = lambda spark, d: f(Model(spark, d))
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


# What is measured in a file ---------------------------------------------------------
#: Forms that a parser of each language looks for.
FORMS = {
    "java": [r"(?m)^package ", r"(?m)^import ", r"\b(class|interface|enum) [A-Z]", r"\b(public|private|protected) "],
    "xml": [r"<\?xml", r"<mapper\b", r"<(select|insert|update|delete)\b", r"<(beans|bean)\b"],
    "jsp": [r"<%@", r"<%[^@]", r"\$\{", r"<[a-z]+:[a-zA-Z]"],
    "sql": [r"(?i)\bSELECT\b", r"(?i)\bCREATE\b", r"(?i)\b(INSERT|UPDATE|DELETE)\b", r"(?i)\bFROM\b"],
}
DYNAMIC = r'append\("SELECT|createQuery|executeQuery|\$\{'
REFLECTION = r"Class\.forName|getMethod\(|\.invoke\("
EXPRESSIONS = r"&&|\|\||\?[^:?]*:"
#: Characters a parser gets through in a second: parse times are estimated, as none are stored.
PARSED_A_SECOND = 1_000_000.0


def _pairs(text: str, a: str, b: str):
    n = lambda c: F.length(text) - F.length(F.replace(F.col(text), F.lit(c), F.lit("")))
    return n(a) == n(b)


def measured(m: Model) -> DataFrame:
    """One row per file with content: structure, elements, forms, table references, complexity."""
    kinds = m.components("file_id", "component_type").groupBy("file_id").agg(F.count_if(F.col("component_type").isin("class", "interface")).alias("classes"), F.count_if(F.col("component_type") == "method").alias("methods"))
    units = m.sql_units().groupBy("file_id").agg(F.count(F.lit(1)).alias("units"))
    x = _texts(m).withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    refs = x.where("ext in ('sql', 'xml')").select("file_id", F.explode(sqltext.tables("content")).alias("tab"))
    catalog = m.tables().select(F.upper("table_name").alias("tab"), F.lit(1).alias("there")).distinct()
    refs = refs.join(catalog, "tab", "left").groupBy("file_id").agg(F.count(F.lit(1)).alias("refs"), F.count("there").alias("confirmed"))
    hits = reduce(lambda a, b: a + b, [F.when((F.col("ext") == e) & F.col("content").rlike(p), 1).otherwise(0) for e, ps in FORMS.items() for p in ps])
    x = x.select(
        "file_id", "path", "loc", "ext", (F.trim("content") != "").alias("ok"), (_pairs("content", "{", "}") & _pairs("content", "(", ")")).alias("complete"), (F.length("content") / PARSED_A_SECOND).alias("secs"),
        hits.alias("hit"), F.when(F.col("ext").isin(*FORMS), 4).otherwise(0).alias("tot"), F.col("content").rlike(DYNAMIC).alias("dynamic"), F.col("content").rlike(REFLECTION).alias("reflection"),
        code.count_of("content", EXPRESSIONS).alias("expressions"), code.max_nesting("content").alias("nesting"),
    )
    x = x.join(kinds, "file_id", "left").join(units, "file_id", "left").join(refs, "file_id", "left").na.fill(0, ["classes", "methods", "units", "refs", "confirmed"])
    return x.withColumn("els", F.col("classes") + F.col("methods") + F.col("units")).withColumn("part", ~F.col("complete")).withColumn("cx", F.col("expressions") + F.col("nesting"))


_NEST = "list_reduce(list_prepend({'ch': '', 'cur': 0, 'top': 0}, list_transform(string_split(regexp_replace(content, '[^{}]', '', 'g'), ''), lambda x: {'ch': x, 'cur': 0, 'top': 0})), lambda a, x: {'ch': x.ch, 'cur': CASE WHEN x.ch = '{' THEN a.cur + 1 WHEN x.ch = '}' THEN greatest(a.cur - 1, 0) ELSE a.cur END, 'top': greatest(a.top, CASE WHEN x.ch = '{' THEN a.cur + 1 WHEN x.ch = '}' THEN greatest(a.cur - 1, 0) ELSE a.cur END)}).top"
_N = lambda c: f"(length(content) - length(replace(content, '{c}', '')))"
_HITS = " + ".join(f"CASE WHEN ext = '{e}' AND regexp_matches(content, '{p}') THEN 1 ELSE 0 END" for e, ps in FORMS.items() for p in ps)
_MEASURED = f"""{FILES}, {CONTENTS}, {COMPONENTS}, {UNITS},
  kc AS (SELECT file_id, count(*) FILTER (component_type IN ('class', 'interface')) AS classes, count(*) FILTER (component_type = 'method') AS methods FROM c GROUP BY 1),
  ku AS (SELECT file_id, count(*) AS units FROM s GROUP BY 1),
  mx AS (SELECT f.file_id, path, loc, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext, content, {_CLEAN} AS clean FROM f JOIN t USING (file_id) WHERE content IS NOT NULL),
  mr AS (SELECT DISTINCT file_id, upper(unnest(regexp_extract_all(clean, '{sqltext.TABLES}', 1))) AS tab FROM mx WHERE ext IN ('sql', 'xml')),
  kr AS (SELECT file_id, count(*) AS refs, count(d.tab) AS confirmed FROM mr LEFT JOIN (SELECT DISTINCT upper(table_name) AS tab FROM db_tables) d ON d.tab = mr.tab GROUP BY 1),
  p0 AS (SELECT mx.file_id, path, loc, ext, trim(content, ' ') <> '' AS ok, {_N('{')} = {_N('}')} AND {_N('(')} = {_N(')')} AS complete, length(content) / 1000000.0::DOUBLE AS secs, {_HITS} AS hit,
    CASE WHEN ext IN ('java', 'xml', 'jsp', 'sql') THEN 4 ELSE 0 END AS tot, regexp_matches(content, '{DYNAMIC}') AS dynamic, regexp_matches(content, '{REFLECTION}') AS reflection,
    len(regexp_extract_all(content, '{EXPRESSIONS}')) AS expressions, {_NEST} AS nesting, coalesce(classes, 0) AS classes, coalesce(methods, 0) AS methods, coalesce(units, 0) AS units, coalesce(refs, 0) AS refs, coalesce(confirmed, 0) AS confirmed
    FROM mx LEFT JOIN kc USING (file_id) LEFT JOIN ku USING (file_id) LEFT JOIN kr USING (file_id)),
  p AS (SELECT *, classes + methods + units AS els, NOT complete AS part, expressions + nesting AS cx FROM p0)"""
_D = "::DOUBLE"
_AST = f"CASE WHEN ok THEN greatest(0.0{_D}, least(1.0{_D}, 0.3{_D} + CASE WHEN complete THEN 0.5{_D} ELSE 0.3{_D} END - CASE WHEN part THEN 0.2{_D} ELSE 0.0{_D} END + CASE WHEN secs < 1 THEN 0.1{_D} WHEN secs > 10 THEN -0.1{_D} ELSE 0.0{_D} END + least(0.1{_D}, els * 0.01{_D}))) ELSE 0.0{_D} END"
_STATIC = f"CASE WHEN tot = 0 THEN 0.5 WHEN hit * 10 >= tot * 9 THEN 1.0 WHEN hit * 10 >= tot * 7 THEN 0.8 WHEN hit * 10 >= tot * 3 THEN 0.4 ELSE 0.2 END{_D}"
_CAT = f"CASE WHEN refs = 0 THEN 0.5 WHEN confirmed = 0 THEN 0.2 WHEN confirmed * 100 >= refs * 95 THEN 1.0 WHEN confirmed * 10 >= refs * 8 THEN 0.85 WHEN confirmed * 10 >= refs * 6 THEN 0.7 WHEN confirmed * 10 >= refs * 4 THEN 0.55 ELSE 0.3 END{_D}"
_HEU = f"0.5{_D} + CASE WHEN ext = 'java' AND classes + methods > 0 OR ext = 'xml' AND units > 0 THEN 0.2{_D} ELSE 0.0{_D} END - 0.2{_D}"
_PEN = f"CASE WHEN dynamic THEN 0.15{_D} ELSE 0.0{_D} END + CASE WHEN reflection THEN 0.25{_D} ELSE 0.0{_D} END + 0.05{_D} * expressions + 0.03{_D} * nesting"
_M = lambda e: f"CAST(floor(({e}) * 1000 + 0.5000001) AS BIGINT)"
_PARTS = f"q AS (SELECT file_id, {_M(_AST)} AS ast, {_M(_STATIC)} AS static, {_M(_CAT)} AS catalog, {_M(_HEU)} AS heuristic, {_M(_PEN)} AS penalty FROM p)"
_CONF = "greatest(100000, least(1000000, 400 * ast + 300 * static + 200 * catalog + 100 * heuristic - 1000 * penalty))"


def score_parts(m: Model) -> DataFrame:
    """(file_id, ast, static, catalog, heuristic, penalty) in whole thousandths: what is compared doesn't hang on the last bit."""
    x = measured(m)
    elements = F.when(F.col("ext") == "java", F.col("classes") + F.col("methods")).when(F.col("ext") == "xml", F.col("units")).otherwise(0)
    parts = {
        "ast": scoring.ast_score("ok", "complete", "part", "part", "secs", "els"), "static": scoring.static_score("hit", "tot"), "catalog": scoring.catalog_score("confirmed", "refs", F.col("confirmed") > 0),
        "heuristic": scoring.heuristic_score("ext", elements, F.lit("regex")), "penalty": scoring.complexity_penalty("dynamic", "reflection", "expressions", "nesting"),
    }
    return x.select("file_id", *[F.floor(e * 1000 + 0.5000001).cast("long").alias(n) for n, e in parts.items()])


def _confidence():
    """In millionths."""
    return F.greatest(F.lit(100_000), F.least(F.lit(1_000_000), F.expr("400 * ast + 300 * static + 200 * catalog + 100 * heuristic - 1000 * penalty")))


@query(f"WITH {_MEASURED}, {_PARTS} SELECT * FROM q")
def ref_c1_score_parts(m):
    return score_parts(m)


@query(f"WITH {_MEASURED}, {_PARTS} SELECT file_id, CAST({_CONF} AS BIGINT) AS confidence FROM q")
def ref_c1_parsing_confidence(m):
    return score_parts(m).select("file_id", _confidence().cast("long").alias("confidence"))


# Joins as they are written, against catalog and declared keys
_JOINED = rf"""{_JOINS}, {_PK}, tabs AS (SELECT DISTINCT upper(table_name) AS tab FROM db_tables), dyn AS (SELECT file_id, regexp_matches(content, '[#$]\{{') AS dynamic FROM x),
  keys AS (SELECT DISTINCT col FROM pk),
  jk AS (SELECT j.file_id, j.target, j.l, j.r, tabs.tab IS NOT NULL AS known, contains(j.l, '.') AND contains(j.r, '.') AS qualified, dynamic, kl.col IS NOT NULL AS lkey, kr.col IS NOT NULL AS rkey
    FROM j JOIN dyn USING (file_id) LEFT JOIN tabs ON tabs.tab = j.target LEFT JOIN keys kl ON kl.col = lower(split_part(j.l, '.', 2)) LEFT JOIN pk kr ON kr.tab = j.target AND kr.col = lower(split_part(j.r, '.', 2)))"""


def joined(m: Model) -> DataFrame:
    """Explicit joins with what the catalog and the primary keys declared in scripts say of both sides."""
    t = _texts(m, ".sql")
    pk = X.primary_keys(t, "content")
    yes = F.lit(True)
    col = lambda c: F.lower(F.split_part(c, F.lit("."), F.lit(2)))
    j = X.sql_joins(t.withColumn("dynamic", F.col("content").rlike(r"[#$]\{")), "file_id", "content", "dynamic").select("file_id", "target", F.col("left").alias("l"), F.col("right").alias("r"), "dynamic").withColumn("lc", col("l")).withColumn("rc", col("r"))
    j = j.join(m.tables().select(F.upper("table_name").alias("target"), yes.alias("known")).distinct(), "target", "left")
    j = j.join(pk.select(F.col("col").alias("lc"), yes.alias("lkey")).distinct(), "lc", "left").join(pk.select(F.col("tab").alias("target"), F.col("col").alias("rc"), yes.alias("rkey")), ["target", "rc"], "left")
    no = F.lit(False)
    return j.select("file_id", "target", "l", "r", F.coalesce("known", no).alias("known"), (F.col("l").contains(".") & F.col("r").contains(".")).alias("qualified"), "dynamic", F.coalesce("lkey", no).alias("lkey"), F.coalesce("rkey", no).alias("rkey"))


@query(f"{_T}, {_SQLFILES}, {_JOINED} SELECT DISTINCT file_id, target, l, r, greatest(0, least(100, 90 + CASE WHEN known THEN 15 ELSE -20 END + CASE WHEN qualified THEN 15 ELSE -20 END - CASE WHEN dynamic THEN 30 ELSE 0 END + CASE WHEN lkey <> rkey THEN 20 ELSE 0 END)) AS pct FROM jk")
def ref_c2_join_confidence(m):
    yes = F.lit(True)
    s = scoring.join_confidence(yes, ~yes, yes, "known", "qualified", "dynamic", F.col("lkey") != F.col("rkey"))
    return joined(m).select("file_id", "target", "l", "r", F.round(s * 100).cast("int").alias("pct")).distinct()


@query(f"{_T}, {_SQLFILES}, {_JOINED}, g AS (SELECT file_id, target, l, r, count(*) AS n, bool_or(lkey) AS lkey, bool_or(rkey) AS rkey FROM jk GROUP BY 1, 2, 3, 4), w AS (SELECT *, count(*) OVER (PARTITION BY file_id, target) AS columns FROM g) SELECT file_id, target, l, r, n, lkey <> rkey AS inferred, least(100, CASE WHEN lkey <> rkey THEN 85 WHEN lkey AND rkey THEN 60 ELSE 70 END + CASE WHEN columns >= 2 THEN 5 ELSE 0 END) AS pct FROM w")
def ref_c15_keys_by_test(m):
    g = joined(m).groupBy("file_id", "target", "l", "r").agg(F.count(F.lit(1)).alias("n"), F.bool_or("lkey").alias("lkey"), F.bool_or("rkey").alias("rkey"))
    pairs = g.groupBy("file_id", "target").agg(F.count(F.lit(1)).alias("columns"))
    one = F.col("lkey") != F.col("rkey")
    pct = F.when(one, 85).when(F.col("lkey") & F.col("rkey"), 60).otherwise(70) + F.when(F.col("columns") >= 2, 5).otherwise(0)
    return g.join(pairs, ["file_id", "target"]).select("file_id", "target", "l", "r", "n", one.alias("inferred"), F.least(F.lit(100), pct).alias("pct"))


# Conditions as they are written
_OPERATOR = r"(?i)(<=|>=|<>|!=|=|<|>| IN | BETWEEN | LIKE | IS )"
_CONSTANT = r"(=|<|>|IN \(|BETWEEN|LIKE) ?('[^']*'|[0-9]+)"
_CONSTANT_SQL = _CONSTANT.replace("'", "''")
_BOUND = r":[A-Za-z]|\?|[#$]\{"
_CONDS = r"s AS (SELECT file_id, unnest(string_split(flat, ';')) || ';' AS st FROM x), w AS (SELECT file_id, regexp_extract(st, '(?i)\bWHERE (.*?)(?: GROUP BY| ORDER BY| HAVING|;|$)', 1) AS wh FROM s), k AS (SELECT DISTINCT file_id, trim(unnest(regexp_split_to_array(wh, '(?i) AND | OR '))) AS cond FROM w)"


@query(f"{_T}, {_SQLFILES}, {_CONDS}, o AS (SELECT file_id, cond, trim(upper(regexp_extract(cond, '{_OPERATOR}', 1))) AS op, regexp_matches(cond, '(?i){_CONSTANT_SQL}') AS const, regexp_matches(cond, '{_BOUND}') AS bound, regexp_matches(cond, '^[A-Za-z_]+\\.[A-Za-z_]') AS qualified FROM k WHERE cond <> '') SELECT file_id, cond, op, greatest(0, least(100, 40 + CASE WHEN NOT bound THEN 30 ELSE -10 END + CASE WHEN const THEN 20 WHEN bound THEN 10 ELSE -15 END + CASE WHEN op = '=' THEN 15 WHEN op IN ('IN', 'BETWEEN') THEN 10 ELSE -5 END + CASE WHEN qualified THEN 15 ELSE -10 END)) AS pct FROM o")
def ref_c3_filter_confidence(m):
    s = _texts(m, ".sql").select("file_id", F.explode(F.split(F.regexp_replace(sqltext.without_comments("content"), r"[ \t\r\n]+", " "), ";")).alias("st"))
    c = F.col("cond")
    k = s.select("file_id", F.explode(sqltext.conditions(F.concat("st", F.lit(";")))).alias("cond")).distinct()
    k = k.withColumn("op", F.trim(F.upper(F.regexp_extract("cond", _OPERATOR, 1)))).withColumn("bound", c.rlike(_BOUND))
    score = scoring.filter_confidence(~F.col("bound"), c.rlike("(?i)" + _CONSTANT), "bound", "op", c.rlike(r"^[A-Za-z_]+\.[A-Za-z_]"))
    return k.select("file_id", "cond", "op", F.round(score * 100).cast("int").alias("pct"))


# What summaries say of their own certainty
_ENRICHED = f"e4 AS (SELECT q.file_id, {_CONF} / 1000000.0{_D} AS c, fs.conf * 0.9{_D} * CASE WHEN fresh THEN 1.0{_D} ELSE 0.7{_D} END AS qq FROM q JOIN (SELECT file_id, max(llm_summary_confidence) AS conf FROM files WHERE llm_summary_confidence IS NOT NULL GROUP BY 1) fs USING (file_id) JOIN (SELECT f.file_id, coalesce(f.hash = sha256(t.content), false) AS fresh FROM f JOIN t USING (file_id) WHERE content IS NOT NULL) fr USING (file_id))"


def _summaries(m: Model) -> DataFrame:
    return m.raw("files").where("llm_summary_confidence is not null").groupBy("file_id").agg(F.max("llm_summary_confidence").alias("conf"))


@query(f"WITH {_MEASURED}, {_PARTS}, {_ENRICHED} SELECT file_id, {_M(f'greatest(0.0{_D}, least(1.0{_D}, c + CASE WHEN qq > 0.5 THEN least(0.3{_D}, (qq - 0.5{_D}) * 0.6{_D}) ELSE greatest(-0.2{_D}, (qq - 0.5{_D}) * 0.4{_D}) END))')} AS millis FROM e4")
def ref_c4_enrichment_delta(m):
    """Summary certainty times a fixed trust in the model times the evidence: whether the recorded hash is that of the text."""
    fresh = _texts(m).join(m.files().select("file_id", "hash"), "file_id").select("file_id", F.coalesce(F.col("hash") == F.sha2("content", 256), F.lit(False)).alias("fresh"))
    x = score_parts(m).select("file_id", (_confidence() / F.lit(1_000_000.0)).alias("c")).join(_summaries(m), "file_id").join(fresh, "file_id")
    return x.select("file_id", F.floor(scoring.enriched("c", "conf", F.lit(0.9), F.when(F.col("fresh"), 1.0).otherwise(0.7)) * 1000 + 0.5000001).cast("long").alias("millis"))


#: Weights tried, in thousandths (fixed values); what they leave goes to the heuristic, within its bounds.
GRID = [(a, s, d, max(50, min(150, 1000 - a - s - d))) for a in range(200, 601, 100) for s in range(100, 401, 75) for d in range(100, 301, 50)]
GRID = [w for w in GRID if 800 <= sum(w) <= 1200]
_GRID = "g AS (SELECT * FROM (VALUES " + ", ".join(map(str, GRID)) + ") v(a, b, d, h))"


@query(f"WITH {_MEASURED}, {_PARTS}, {_GRID}, tr AS (SELECT q.*, CAST(floor(conf * 1000 + 0.5) AS BIGINT) AS truth FROM q JOIN (SELECT file_id, max(llm_summary_confidence) AS conf FROM files WHERE llm_summary_confidence IS NOT NULL GROUP BY 1) USING (file_id)) SELECT a AS ast_weight, b AS static_weight, d AS catalog_weight, h AS heuristic_weight, CAST(sum(abs(greatest(100000, least(1000000, a * ast + b * static + d * catalog + h * heuristic - 1000 * penalty)) - 1000 * truth)) AS BIGINT) AS error, count(*) AS files FROM g, tr GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10 ORDER BY error, 1, 2, 3 LIMIT 1")
def ref_c5_weight_calibration(m):
    """The weights whose confidence comes nearest to the recorded one; at least ten files must have one."""
    w = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("ast_weight", "static_weight", "catalog_weight", "heuristic_weight"), ws)]) for ws in GRID])
    x = score_parts(m).join(_summaries(m).select("file_id", F.floor(F.col("conf") * 1000 + 0.5).cast("long").alias("truth")), "file_id")
    x = x.select("ast", "static", "catalog", "heuristic", "penalty", "truth", F.inline(w))
    guess = F.greatest(F.lit(100_000), F.least(F.lit(1_000_000), F.expr("ast_weight * ast + static_weight * static + catalog_weight * catalog + heuristic_weight * heuristic - 1000 * penalty")))
    by = ["ast_weight", "static_weight", "catalog_weight", "heuristic_weight"]
    return x.groupBy(*by).agg(F.sum(F.abs(guess - 1000 * F.col("truth"))).alias("error"), F.count(F.lit(1)).alias("files")).where("files >= 10").orderBy("error", *by[:3]).limit(1)


# The graph of a project
#: Kinds of edges that a project's views need.
KINDS = ("call", "extends", "implements", "import", "include", "use_table")
_COUNTS = f"{EDGES}, {COMPONENTS}, {FILES}, nc AS (SELECT project_id, count(*) FILTER (component_type = 'method') AS methods, count(*) FILTER (component_type = 'class') AS classes, count(*) FILTER (component_type = 'method' AND parent_component_id IS NOT NULL) AS owned, count(*) AS nodes FROM c GROUP BY 1), nf AS (SELECT project_id, count(*) AS files FROM f GROUP BY 1), ne AS (SELECT project_id, count(*) FILTER (src_type = 'method' AND dst_type = 'method' AND dst_id IS NOT NULL) AS mm, count(*) FILTER (src_type = 'method' AND edge_kind = 'call') AS calls, count(*) FILTER (src_type = 'method' AND edge_kind = 'call' AND dst_id IS NULL) AS lost, count(*) FILTER (src_type = 'file') AS ff, count(*) FILTER (edge_kind IN ('import', 'include', 'dependency', 'package_relation')) AS deps, count(DISTINCT CASE WHEN dst_type = 'table' THEN dst_id END) AS tables, count(*) FILTER (src_type = 'table' AND dst_type = 'table') AS tt, count(*) AS edges FROM e GROUP BY 1), full_classes AS (SELECT p.project_id, count(*) AS filled FROM c p WHERE p.component_type = 'class' AND p.component_id IN (SELECT parent_component_id FROM c WHERE component_type = 'method') GROUP BY 1), pc AS (SELECT nf.project_id, files, coalesce(methods, 0) AS methods, coalesce(classes, 0) AS classes, coalesce(owned, 0) AS owned, coalesce(nodes, 0) AS nodes, coalesce(mm, 0) AS mm, coalesce(calls, 0) AS calls, coalesce(lost, 0) AS lost, coalesce(ff, 0) AS ff, coalesce(deps, 0) AS deps, coalesce(tables, 0) AS tables, coalesce(tt, 0) AS tt, coalesce(edges, 0) AS edges, coalesce(filled, 0) AS filled FROM nf LEFT JOIN nc USING (project_id) LEFT JOIN ne USING (project_id) LEFT JOIN full_classes USING (project_id))"


def project_counts(m: Model) -> DataFrame:
    c, e = m.components("project_id", "component_type", "parent_component_id"), m.edges("project_id", "src_type", "dst_type", "dst_id", "edge_kind")
    n = F.count(F.lit(1))
    is_ = lambda col, v: F.col(col) == v
    nc = c.groupBy("project_id").agg(F.count_if(is_("component_type", "method")).alias("methods"), F.count_if(is_("component_type", "class")).alias("classes"), F.count_if(is_("component_type", "method") & F.col("parent_component_id").isNotNull()).alias("owned"), n.alias("nodes"))
    ne = e.groupBy("project_id").agg(
        F.count_if(is_("src_type", "method") & is_("dst_type", "method") & F.col("dst_id").isNotNull()).alias("mm"), F.count_if(is_("src_type", "method") & is_("edge_kind", "call")).alias("calls"),
        F.count_if(is_("src_type", "method") & is_("edge_kind", "call") & F.col("dst_id").isNull()).alias("lost"), F.count_if(is_("src_type", "file")).alias("ff"),
        F.count_if(F.col("edge_kind").isin("import", "include", "dependency", "package_relation")).alias("deps"), F.countDistinct(F.when(is_("dst_type", "table"), F.col("dst_id"))).alias("tables"),
        F.count_if(is_("src_type", "table") & is_("dst_type", "table")).alias("tt"), n.alias("edges"),
    )
    parents = c.where("component_type = 'method'").select(F.col("parent_component_id").alias("component_id")).distinct()
    filled = c.where("component_type = 'class'").select("project_id", "component_id").join(parents, "component_id", "left_semi").groupBy("project_id").agg(n.alias("filled"))
    out = m.files().groupBy("project_id").agg(n.alias("files"))
    for x in (nc, ne, filled):
        out = out.join(x, "project_id", "left")
    return out.na.fill(0, [x for x in out.columns if x != "project_id"])


@query(f"WITH {EDGES}, k AS (SELECT project_id, edge_kind, count(dst_id) AS have FROM e WHERE edge_kind IN {KINDS} GROUP BY 1, 2), x AS (SELECT project_id, count(*) FILTER (have > 0) AS available, count(*) FILTER (have = 0) AS fallbacks FROM k GROUP BY 1) SELECT project_id, available, fallbacks, greatest(0.0, 100.0 * available / {len(KINDS)} - 10 * fallbacks)::DOUBLE AS quality FROM x")
def ref_c8_relationship_quality(m):
    """Kinds of relations a project has, of those its views need; a kind with unresolved edges only needs a fallback."""
    k = m.edges("project_id", "dst_id", "edge_kind").where(F.col("edge_kind").isin(*KINDS)).groupBy("project_id", "edge_kind").agg(F.count("dst_id").alias("have"))
    x = k.groupBy("project_id").agg(F.count_if(F.col("have") > 0).alias("available"), F.count_if(F.col("have") == 0).alias("fallbacks"))
    return x.select("project_id", "available", "fallbacks", F.greatest(F.lit(0.0), F.lit(100.0) * F.col("available") / len(KINDS) - 10 * F.col("fallbacks")).alias("quality"))


_READY = lambda a, b: f"CASE WHEN {a} > 0 AND {b} > 0 THEN 1.0 WHEN {a} > 0 THEN 0.5 ELSE 0.0 END::DOUBLE"


@query(f"WITH {_COUNTS} SELECT project_id, greatest(CASE WHEN methods > 20 AND calls = 0 THEN 0.8 WHEN methods > 0 AND calls = 0 THEN 0.5 ELSE 0.1 END, CASE WHEN nodes > 100 AND edges < 50 THEN 0.6 ELSE 0.1 END, CASE WHEN methods > 0 AND calls > 0 AND files > 0 AND deps > 0 THEN 0.1 ELSE 0.4 END)::DOUBLE AS risk FROM pc")
def ref_c9_silent_failure_risk(m):
    no_calls = F.when(F.expr("methods > 20 and calls = 0"), 0.8).when(F.expr("methods > 0 and calls = 0"), 0.5).otherwise(0.1)
    views = F.when(F.expr("methods > 0 and calls > 0 and files > 0 and deps > 0"), 0.1).otherwise(0.4)
    return project_counts(m).select("project_id", F.greatest(no_calls, F.when(F.expr("nodes > 100 and edges < 50"), 0.6).otherwise(0.1), views).alias("risk"))


_PUBLIC = r"public [A-Za-z<>]+ ([a-z][A-Za-z]*)\(([^()]*)\)"


@query(f"WITH {EDGES}, {COMPONENTS}, {CONTENTS}, d AS (SELECT id, CAST(sum(i) AS BIGINT) AS inc, CAST(sum(o) AS BIGINT) AS out FROM (SELECT src_id AS id, 0 AS i, 1 AS o FROM e WHERE src_type = 'method' UNION ALL SELECT dst_id, 1, 0 FROM e WHERE dst_type = 'method' AND dst_id IS NOT NULL) GROUP BY 1), pub AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '{_PUBLIC}', 1)) AS name FROM t), v AS (SELECT c.component_id AS id, pub.name IS NOT NULL AS public FROM c LEFT JOIN pub ON pub.file_id = c.file_id AND pub.name = c.component_name WHERE c.component_type = 'method') SELECT d.id AS method_id, 2 * inc + out + CASE WHEN coalesce(public, false) THEN 2 ELSE 0 END AS centrality FROM d LEFT JOIN v USING (id) ORDER BY 2 DESC, 1 LIMIT 50")
def ref_c13_centrality(m):
    """Top methods; public as their file declares them."""
    public = X.method_signatures(m.contents(), "file_id", "content").select("file_id", F.col("name").alias("component_name"), F.lit(True).alias("public")).distinct()
    v = m.components("file_id", "component_name", "component_type").where("component_type = 'method'").join(public, ["file_id", "component_name"], "left").select(F.col("component_id").alias("node_id"), "public")
    x = R.degrees(m.edges("src_type", "src_id", "dst_type", "dst_id")).where("node_type = 'method'").join(v, "node_id", "left")
    return x.select(F.col("node_id").alias("method_id"), scoring.centrality("in_degree", "out_degree", F.coalesce("public", F.lit(False))).alias("centrality")).orderBy(F.desc("centrality"), "method_id").limit(50)


#: Rules of silent failures: name, severity, condition over the counts of a project (fixed values).
ALERTS = [
    ("no_method_interactions", "CASE WHEN methods >= 5 THEN 'high' ELSE 'medium' END", "methods > 0 AND mm = 0"),
    ("low_interaction_density", "'medium'", "methods > 0 AND mm * 10 < methods"),
    ("insufficient_dependencies", "'medium'", "files > 10 AND ff < 10"),
    ("isolated_tables", "'medium'", "tables > 5 AND tt < 3"),
    ("empty_classes", "'medium'", "classes > 0 AND filled * 10 < classes * 3"),
    ("low_quality_score", "CASE WHEN methods > 0 AND mm = 0 THEN 'high' ELSE 'medium' END", "methods + classes > 0 AND edges > 0 AND (edges - lost) * 10 < edges * 6"),
    ("high_unresolved_calls", "'medium'", "calls > 0 AND lost * 10 > calls * 8"),
]


@query(f"WITH {_COUNTS} " + " UNION ALL ".join(f"SELECT project_id, '{n}' AS alert, {s} AS severity FROM pc WHERE {c}" for n, s, c in ALERTS))
def ref_c17_alerts(m):
    hits = F.array_compact(F.array(*[F.when(F.expr(c), F.struct(F.lit(n).alias("alert"), F.expr(s).alias("severity"))) for n, s, c in ALERTS]))
    return project_counts(m).select("project_id", F.inline(hits))


@query(f"WITH {_COUNTS} SELECT project_id, {_READY('methods', 'calls')} AS sequence, {_READY('files', 'deps')} AS dependency, {_READY('tables', 'tt')} AS erd, {_READY('classes', 'owned')} AS class FROM pc")
def ref_c18_readiness(m):
    ready = lambda a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), 1.0).when(F.col(a) > 0, 0.5).otherwise(0.0)
    return project_counts(m).select("project_id", ready("methods", "calls").alias("sequence"), ready("files", "deps").alias("dependency"), ready("tables", "tt").alias("erd"), ready("classes", "owned").alias("class"))


# Bins of files ------------------------------------------------------------
@query(f"WITH {FILES} SELECT file_id, {findings.component_sql('path')} AS component FROM f")
def ref_f15_rule_groups(m):
    return m.files().select("file_id", findings.component_group(None, "path").alias("component"))


@query(f"WITH {COMPONENTS}, {FILES} SELECT component_id, {findings.component_sql('component_name', 'path')} AS component FROM c LEFT JOIN f USING (file_id)")
def ref_f15_component_groups(m):
    c = m.components("file_id", "component_name").select("component_id", "file_id", "component_name").join(m.files().select("file_id", "path"), "file_id", "left")
    return c.select("component_id", findings.component_group("component_name", "path").alias("component"))


@query(f"WITH {COMPONENTS}, x AS (SELECT component_id, component_type, component_name AS n, lower(component_name) AS low FROM c WHERE component_type IN ('class', 'method')) SELECT component_id, CASE WHEN component_type = 'class' THEN {findings.first_sql('low', findings.LAYERS, 'NULL')} END AS layer, CASE WHEN component_type = 'class' THEN {findings.first_sql('low', findings.DOMAINS, 'NULL')} END AS domain, CASE WHEN component_type = 'method' THEN {findings.priority_sql()} END AS priority FROM x")
def ref_f16_classifiers(m):
    low, of = F.lower("component_name"), lambda t: F.col("component_type") == t
    c = m.components("component_name", "component_type").where("component_type in ('class', 'method')")
    return c.select("component_id", F.when(of("class"), findings.first_match(low, findings.LAYERS)).alias("layer"), F.when(of("class"), findings.first_match(low, findings.DOMAINS)).alias("domain"), F.when(of("method"), findings.method_priority("component_name")).alias("priority"))


@query(f"WITH {_MEASURED}, y AS (SELECT file_id, cx, CASE WHEN loc <= 100 THEN 'low' WHEN loc <= 300 THEN 'med' WHEN loc <= 800 THEN 'high' ELSE 'crit' END AS base FROM p WHERE loc IS NOT NULL) SELECT file_id, CASE WHEN cx >= 20 AND base IN ('low', 'med') THEN 'high' ELSE base END AS bin FROM y")
def ref_f17_hotspot_bin(m):
    return measured(m).where("loc is not null").select("file_id", scoring.hotspot("loc", "cx").alias("bin"))


@query(f"WITH {_MEASURED}, {EDGES}, fr AS (SELECT id, count(*) AS n FROM (SELECT src_id AS id FROM e WHERE src_type = 'file' UNION ALL SELECT dst_id FROM e WHERE dst_type = 'file' AND dst_id IS NOT NULL) GROUP BY 1), x AS (SELECT file_id, 400 * least(cx, 20) * 50 + 300 * least(loc, 1000) + 300 * least(coalesce(n, 0), 10) * 100 AS score FROM p LEFT JOIN fr ON fr.id = p.file_id WHERE loc IS NOT NULL) SELECT file_id, CAST(score AS BIGINT) AS score, CASE WHEN score >= 800000 THEN 'critical' WHEN score >= 600000 THEN 'hot' WHEN score >= 400000 THEN 'warm' ELSE 'cool' END AS level FROM x")
def ref_f18_heat_level(m):
    """Complexity, lines and references of a file, each up to its full mark of 20, 1,000 and 10; in millionths."""
    n = R.degrees(m.edges("src_type", "src_id", "dst_type", "dst_id")).where("node_type = 'file'").select(F.col("node_id").alias("file_id"), F.col("degree").alias("n"))
    x = measured(m).where("loc is not null").join(n, "file_id", "left")
    s = F.expr("400 * least(cx, 20) * 50 + 300 * least(loc, 1000) + 300 * least(coalesce(n, 0), 10) * 100").cast("long")
    return x.select("file_id", s.alias("score"), scoring.heat_level(s / 1_000_000).alias("level"))


@query(f"WITH {FILES}, {CONTENTS}, x AS (SELECT f.file_id, lower(regexp_extract(path, '([^/]+)$', 1)) AS name, {findings.learning_sql()} AS points FROM f JOIN t USING (file_id) WHERE content IS NOT NULL), y AS (SELECT file_id, name, CASE WHEN points <= 2 THEN 'beginner' WHEN points <= 5 THEN 'intermediate' ELSE 'advanced' END AS level, {findings.base_priority_sql('name')} AS priority FROM x) SELECT file_id, level, priority, CASE WHEN level = 'beginner' AND priority >= 4 THEN 'overview' WHEN contains(name, 'controller') THEN 'controllers' WHEN contains(name, 'service') THEN 'services' WHEN contains(name, 'mapper') OR contains(name, 'repository') OR contains(name, 'model') THEN 'data' ELSE 'details' END AS phase FROM y")
def ref_f28_learning_priority(m):
    x = _texts(m).select("file_id", F.lower(F.regexp_extract("path", "([^/]+)$", 1)).alias("name"), findings.learning_points("content").alias("points"))
    x = x.withColumn("level", F.when(F.col("points") <= 2, "beginner").when(F.col("points") <= 5, "intermediate").otherwise("advanced")).withColumn("priority", findings.base_priority("name"))
    n = F.col("name")
    phase = F.when((F.col("level") == "beginner") & (F.col("priority") >= 4), "overview").when(n.contains("controller"), "controllers").when(n.contains("service"), "services").when(n.contains("mapper") | n.contains("repository") | n.contains("model"), "data").otherwise("details")
    return x.select("file_id", "level", "priority", phase.alias("phase"))


# Findings ---------------------------------------------------------------------
def _findings_sql() -> str:
    parts = []
    for i, (ext, kind, severity, pattern) in enumerate(findings.VULNERABILITIES, 1):
        p = ("(?is)" + pattern).replace("'", "''")
        conf = "CAST(least(950, 700 + 5 * length(m)) AS INTEGER)" if ext == ".jsp" and kind == "sql_injection" else "CASE WHEN contains(m, '${') THEN 950 ELSE 800 END" if kind == "sql_injection" else "700"
        parts.append(
            f"SELECT file_id, '{kind}' AS kind, {i} AS rule, '{severity}' AS severity, m, {conf} AS millis, 1 + length(list_aggregate(pieces[1:k], 'string_agg', '')) - length(replace(list_aggregate(pieces[1:k], 'string_agg', ''), chr(10), '')) AS line_no FROM "
            f"(SELECT file_id, string_split(regexp_replace(content, '{p}', chr(1) || '\\0', 'g'), chr(1)) AS pieces, unnest(regexp_extract_all(content, '{p}')) AS m, generate_subscripts(regexp_extract_all(content, '{p}'), 1) AS k FROM t JOIN f USING (file_id) WHERE content IS NOT NULL AND path LIKE '%{ext}')"
        )
    return f"{_T}, z AS ({' UNION ALL '.join(parts)}), o AS (SELECT *, row_number() OVER (PARTITION BY file_id, line_no, kind ORDER BY rule, m) AS rn FROM z)"


FOUND = _findings_sql()


@query(f"{FOUND} SELECT file_id, CAST(line_no AS INTEGER) AS line_no, kind, rule, severity, millis AS confidence FROM o WHERE rn = 1")
def ref_x22_vulnerability_scan(m):
    """All eleven rules over whole texts, matches over several lines included; per line and kind the first rule wins."""
    return findings.scan(_texts(m), "file_id", "content", "path").select("file_id", "line_no", "kind", "rule", "severity", "confidence")


@query(f"{FOUND} SELECT kind, severity, count(*) AS findings, count(DISTINCT file_id) AS files, CAST(sum(millis) AS BIGINT) AS confidence FROM o WHERE rn = 1 GROUP BY 1, 2")
def ref_c19_finding_confidence(m):
    return findings.scan(_texts(m), "file_id", "content", "path").groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("file_id").alias("files"), F.sum("confidence").cast("long").alias("confidence"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
