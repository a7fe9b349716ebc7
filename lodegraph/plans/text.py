"""Scalar functions, scoring models and text extraction over the metadata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import code, paths, scoring, sqltext
from lodegraph.model import COMPONENTS, CONTENTS, EDGES, FILES, HINTS, UNITS, Model
from lodegraph.operators import extract as X

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = lambda spark, d: f(Model(spark, d))
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


_T = f"WITH {FILES}, {CONTENTS}"
_CLEAN = r"regexp_replace(regexp_replace(content, '/\*[^*]*\*+([^/*][^*]*\*+)*/', ' ', 'g'), '--[^\n]*', ' ', 'g')"
_FLAT = rf"regexp_replace({_CLEAN}, '[ \t\r\n]+', ' ', 'g')"
_SQLFILES = f"x AS (SELECT f.file_id, content, {_CLEAN} AS clean, {_FLAT} AS flat FROM t JOIN f USING (file_id) WHERE f.path LIKE '%.sql' AND content IS NOT NULL)"


def _texts(m: Model, suffix: str | None = None) -> DataFrame:
    x = m.contents().where("content is not null").join(m.files().select("file_id", "path", "project_id", "language", "loc"), "file_id")
    return x.where(F.col("path").endswith(suffix)) if suffix else x


# F: scalar functions ------------------------------------------------------------
@query("SELECT table_id, upper(trim(table_name)) AS u, lower(coalesce(owner, '')) AS l, split_part(table_name, '_', 2) AS part, replace(table_name, 'T_', '') AS bare, length(table_name) AS n, substring(table_name, 1, 5) AS head FROM db_tables")
def ref_f1_string_functions(m):
    n = F.col("table_name")
    return m.tables().select("table_id", F.upper(F.trim(n)).alias("u"), F.lower(F.coalesce("owner", F.lit(""))).alias("l"), F.split_part(n, F.lit("_"), F.lit(2)).alias("part"), F.replace(n, F.lit("T_"), F.lit("")).alias("bare"), F.length(n).alias("n"), F.substring(n, 1, 5).alias("head"))


@query(f"WITH {FILES} SELECT file_id, regexp_extract(path, '([^/]+)$', 1) AS base, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\\.[^.]*$', '') AS stem FROM f")
def ref_f2_path_parts(m):
    return m.files().select("file_id", paths.basename("path").alias("base"), paths.dirname("path").alias("dir"), paths.extension("path").alias("ext"), paths.stem("path").alias("stem"))


@query(f"{_T}, l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM t WHERE content IS NOT NULL) SELECT file_id, CAST(line_no AS INTEGER) AS line_no FROM l WHERE contains(line, 'throw new')")
def ref_f3_line_of_match(m):
    return X.grep(m.contents(), "file_id", "content", "throw new").select("file_id", "line_no")


@query(f"{_T} SELECT file_id, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - CASE WHEN content LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS loc FROM t WHERE content IS NOT NULL")
def ref_f4_loc(m):
    return m.contents().where("content is not null").select("file_id", code.loc("content").alias("loc"))


@query(f"{_T} SELECT file_id, md5(content) AS m, sha256(content) AS h, substring(md5(content), 1, 8) AS short FROM t WHERE content IS NOT NULL")
def ref_f5_hashes(m):
    return m.contents().where("content is not null").select("file_id", F.md5("content").alias("m"), F.sha2("content", 256).alias("h"), F.substring(F.md5("content"), 1, 8).alias("short"))


@query(f"{_T}, {_SQLFILES} SELECT file_id, lower(trim(regexp_replace(regexp_replace(clean, '[#$]\\{{[^}}]*\\}}', '?', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS normal FROM x")
def ref_f6_normalised_sql(m):
    return _texts(m, ".sql").select("file_id", sqltext.normalised("content").alias("normal"))


@query(f"{_T}, {_SQLFILES} SELECT file_id, md5(regexp_replace(upper(regexp_replace(trim(flat), '''[^'']*''', '''S''', 'g')), '[0-9]+', 'N', 'g')) AS fp FROM x")
def ref_f7_fingerprint(m):
    return _texts(m, ".sql").select("file_id", sqltext.fingerprint("content").alias("fp"))


@query(f"{_T}, {_SQLFILES} SELECT file_id, trim(flat) AS base FROM x")
def ref_f8_base_normalised(m):
    return _texts(m, ".sql").select("file_id", F.trim(F.regexp_replace(sqltext.without_comments("content"), r"[ \t\r\n]+", " ")).alias("base"))


@query(f"{_T}, {_SQLFILES}, w AS (SELECT file_id, upper(regexp_extract(clean, '^\\s*([A-Za-z]+)', 1)) AS word FROM x) SELECT CASE WHEN word IN ('SELECT','INSERT','UPDATE','DELETE','MERGE','CREATE','ALTER','DROP','TRUNCATE','COMMENT') THEN lower(word) WHEN word = 'WITH' THEN 'select' ELSE 'unknown' END AS kind, count(*) AS n FROM w GROUP BY 1")
def ref_f9_statement_kind(m):
    return _texts(m, ".sql").groupBy(sqltext.kind("content").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {HINTS} SELECT hint_id, CASE WHEN json_valid(hint) THEN json_extract_string(hint, '$.called_name') END AS called_name, CASE WHEN json_valid(hint) THEN TRY_CAST(json_extract_string(hint, '$.line') AS BIGINT) END AS line FROM h")
def ref_f10_json_get(m):
    return m.hints().select("hint_id", F.get_json_object("hint", "$.called_name").alias("called_name"), F.expr("try_cast(get_json_object(hint, '$.line') as bigint)").alias("line"))


@query(f"WITH {UNITS} SELECT sql_id, regexp_extract(mapper_ns, '^(.*)\\.[^.]*$', 1) AS package, regexp_extract(mapper_ns, '([^.]+)$', 1) AS class, mapper_ns || '.' || stmt_id AS fqn FROM s WHERE mapper_ns IS NOT NULL")
def ref_f11_fqn_parts(m):
    n = "mapper_ns"
    return m.sql_units().where("mapper_ns is not null").select("sql_id", F.regexp_extract(n, r"^(.*)\.[^.]*$", 1).alias("package"), F.regexp_extract(n, r"([^.]+)$", 1).alias("class"), F.concat("mapper_ns", F.lit("."), "stmt_id").alias("fqn"))


@query(f"{_T}, g AS (SELECT file_id, unnest(regexp_extract_all(content, 'public [A-Za-z<>]+ ([a-z][A-Za-z]*)\\(', 1)) AS name, unnest(regexp_extract_all(content, 'public [A-Za-z<>]+ [a-z][A-Za-z]*\\(([^()]*)\\)', 1)) AS args FROM t) SELECT file_id, name, CASE WHEN trim(args) = '' THEN 0 ELSE len(string_split(args, ',')) END AS params, count(*) AS n FROM g WHERE name IS NOT NULL AND args IS NOT NULL GROUP BY ALL")
def ref_f12_parameter_count(m):
    x = X.method_signatures(m.contents(), "file_id", "content")
    return x.groupBy("file_id", "name", F.when(F.trim("args") == "", 0).otherwise(F.size(F.split("args", ","))).alias("params")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {COMPONENTS} SELECT regexp_replace(component_name, '(Service|Controller|Repository|DAO|DTO|VO|Impl|Test)$', '') AS base, count(*) AS n FROM c WHERE component_type = 'class' GROUP BY 1")
def ref_f13_suffix_strip(m):
    return m.components("component_name", "component_type").where("component_type = 'class'").groupBy(code.suffix_stripped("component_name").alias("base")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FILES} SELECT file_id, CASE WHEN lower(path) LIKE '%controller%' THEN 'web' WHEN lower(path) LIKE '%service%' THEN 'business' WHEN lower(path) LIKE '%mapper%' OR lower(path) LIKE '%dao%' OR path LIKE '%.sql' THEN 'data' WHEN path LIKE '%.jsp' OR path LIKE '%.js' OR path LIKE '%.css' THEN 'view' ELSE 'other' END AS grp FROM f")
def ref_f14_group_guess(m):
    p, low = F.col("path"), F.lower("path")
    g = F.when(low.contains("controller"), "web").when(low.contains("service"), "business").when(low.contains("mapper") | low.contains("dao") | p.endswith(".sql"), "data").when(p.endswith(".jsp") | p.endswith(".js") | p.endswith(".css"), "view").otherwise("other")
    return m.files().select("file_id", g.alias("grp"))


@query(f"WITH {FILES} SELECT DISTINCT regexp_replace(lower(regexp_extract(path, '^([^/]+)/', 1)), '[^a-z0-9]+', '_', 'g') AS cluster FROM f")
def ref_f19_sanitised_name(m):
    return m.files().select(F.regexp_replace(F.lower(F.regexp_extract("path", "^([^/]+)/", 1)), "[^a-z0-9]+", "_").alias("cluster")).distinct()


@query("WITH x AS (SELECT table_id, upper(table_name) AS n FROM db_tables), k AS (SELECT table_id, unnest(list_distinct([substring(n, 1, 1), list_aggregate(list_transform(string_split(n, '_'), lambda p: substring(p, 1, 1)), 'string_agg', ''), substring(n, 1, 3), substring(n, 1, 4), regexp_replace(n, 'S$', ''), n])) AS short FROM x) SELECT short, count(*) AS tables, min(table_id) AS first FROM k GROUP BY 1")
def ref_f20_abbreviations(m):
    x = m.tables().select("table_id", F.explode(code.abbreviations("table_name")).alias("short"))
    return x.groupBy("short").agg(F.count(F.lit(1)).alias("tables"), F.min("table_id").alias("first"))


@query(f"{_T}, {_SQLFILES}, k AS (SELECT DISTINCT unnest(regexp_extract_all(clean, '([a-z]+_id)\\b', 1)) AS col FROM x) SELECT col, regexp_matches(col, '_id$|^id_|^fk_|_fk$') AS fk, regexp_replace(col, '_id$|^id_|^fk_|_fk$', '') || 's' AS target FROM k WHERE col IS NOT NULL")
def ref_f21_fk_columns(m):
    cols = _texts(m, ".sql").select(F.explode(F.regexp_extract_all(sqltext.without_comments("content"), F.lit(r"([a-z]+_id)\b"), F.lit(1))).alias("col")).distinct()
    return cols.select("col", code.fk_column("col").alias("fk"), code.fk_target("col").alias("target"))


@query(f"{_T}, u AS (SELECT DISTINCT unnest(regexp_extract_all(content, 'action=\"(/[^\"]*)\"', 1)) AS url FROM t WHERE content IS NOT NULL), p AS (SELECT url, regexp_replace(lower(split_part(regexp_replace(url, '^/+', ''), '/', 1)), '\\..*$', '') AS part FROM u) SELECT url, upper(substring(part, 1, 1)) || substring(part, 2) || 'Controller' AS controller FROM p WHERE url IS NOT NULL")
def ref_f22_url_controller(m):
    u = m.contents().where("content is not null").select(F.explode(F.regexp_extract_all("content", F.lit('action="(/[^"]*)"'), F.lit(1))).alias("url")).distinct()
    return u.select("url", code.controller_of("url").alias("controller"))


@query(f"{_T} SELECT file_id, regexp_matches(content, 'append\\(\"SELECT|createQuery|executeQuery') AS dynamic_sql, regexp_matches(content, 'Class\\.forName|getMethod\\(|\\.invoke\\(') AS reflection, len(regexp_extract_all(content, '&&|\\|\\||\\?[^:?]*:')) AS expressions, len(regexp_extract_all(content, '->')) AS lambdas FROM t WHERE content IS NOT NULL")
def ref_f23_complexity_flags(m):
    c = F.col("content")
    return m.contents().where("content is not null").select(
        "file_id", c.rlike(r'append\("SELECT|createQuery|executeQuery').alias("dynamic_sql"), c.rlike(r"Class\.forName|getMethod\(|\.invoke\(").alias("reflection"),
        code.count_of("content", r"&&|\|\||\?[^:?]*:").alias("expressions"), code.count_of("content", "->").alias("lambdas"),
    )


@query(f"{_T}, b AS (SELECT file_id, string_split(regexp_replace(content, '[^{{}}]', '', 'g'), '') AS s FROM t WHERE content IS NOT NULL), r AS (SELECT file_id, list_reduce(list_prepend({{'ch': '', 'cur': 0, 'top': 0}}, list_transform(s, lambda x: {{'ch': x, 'cur': 0, 'top': 0}})), lambda a, x: {{'ch': x.ch, 'cur': CASE WHEN x.ch = '{{' THEN a.cur + 1 WHEN x.ch = '}}' THEN greatest(a.cur - 1, 0) ELSE a.cur END, 'top': greatest(a.top, CASE WHEN x.ch = '{{' THEN a.cur + 1 WHEN x.ch = '}}' THEN greatest(a.cur - 1, 0) ELSE a.cur END)}}) AS z FROM b) SELECT file_id, z.top AS nesting FROM r")
def ref_f24_nesting(m):
    return m.contents().where("content is not null").select("file_id", code.max_nesting("content").alias("nesting"))


@query("WITH x AS (SELECT doc_id, regexp_replace(text, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN s = '' THEN 0 ELSE len(regexp_split_to_array(s, '[ \\t\\r\\n]+')) END AS tokens FROM x")
def ref_f25_token_count(m):
    return m.raw("documents").where("text is not null").select("doc_id", code.token_count("text").alias("tokens"))


@query(f"WITH {COMPONENTS} SELECT CASE WHEN component_name IN ('toString', 'equals', 'hashCode') THEN 'object' WHEN starts_with(component_name, 'get') THEN 'getter' WHEN starts_with(component_name, 'set') THEN 'setter' WHEN starts_with(component_name, 'is') THEN 'predicate' ELSE 'other' END AS kind, count(*) AS n FROM c WHERE component_type = 'method' GROUP BY 1")
def ref_f26_summary_kind(m):
    return m.components("component_name", "component_type").where("component_type = 'method'").groupBy(code.summary_kind("component_name").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {COMPONENTS} SELECT component_id, CASE WHEN regexp_matches(component_name, '^(init|open|start|load)') THEN 0 WHEN regexp_matches(component_name, '^(check|find|select)') THEN 1 WHEN regexp_matches(component_name, '^(save|update|insert)') THEN 3 WHEN regexp_matches(component_name, '^(close|archive|notify)') THEN 4 ELSE 2 END AS pr FROM c WHERE component_type = 'method'")
def ref_f27_call_order(m):
    from lodegraph.operators.relational import call_order

    return m.components("component_name", "component_type").where("component_type = 'method'").select("component_id", call_order("component_name").alias("pr"))


@query("WITH a AS (SELECT DISTINCT table_name FROM db_tables) SELECT table_name, levenshtein(table_name, 'T_VENDOR_MST') AS distance FROM a ORDER BY distance, table_name LIMIT 5")
def ref_f30_close_matches(m):
    return X.close_matches(m.tables().select("table_name").distinct(), "table_name", "T_VENDOR_MST", 5)


@query(f"WITH {EDGES} SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM e GROUP BY 1")
def ref_f31_date_label(m):
    return m.edges("created_at").groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


# C: scoring models ---------------------------------------------------------------
@query(f"WITH {EDGES}, x AS (SELECT project_id, CASE WHEN confidence IS NULL THEN 'critical' WHEN confidence >= 0.8 THEN 'pass' WHEN confidence >= 0.6 THEN 'warning' ELSE 'error' END AS r FROM e) SELECT project_id, CAST(sum(CASE r WHEN 'pass' THEN 10 WHEN 'warning' THEN 7 WHEN 'error' THEN 3 ELSE 0 END) * 10 AS DOUBLE) / count(*) AS score FROM x GROUP BY 1")
def ref_c6_quality_score(m):
    c = F.col("confidence")
    r = F.when(c.isNull(), 0).when(c >= 0.8, 10).when(c >= 0.6, 7).otherwise(3)
    return m.edges("project_id", "confidence").groupBy("project_id").agg(((F.sum(r) * 10).cast("double") / F.count(F.lit(1))).alias("score"))


@query(f"WITH {FILES} SELECT project_id, count(*) AS files, CAST(count(language) + count(hash) + count(loc) AS DOUBLE) / (3 * count(*)) AS score, CASE WHEN (count(language) + count(hash) + count(loc)) * 10 >= 27 * count(*) THEN 'excellent' WHEN (count(language) + count(hash) + count(loc)) * 10 >= 21 * count(*) THEN 'good' WHEN (count(language) + count(hash) + count(loc)) * 10 >= 15 * count(*) THEN 'fair' ELSE 'poor' END AS status FROM f GROUP BY 1")
def ref_c7_completeness(m):
    x = m.files().groupBy("project_id").agg(F.count(F.lit(1)).alias("files"), (F.count("language") + F.count("hash") + F.count("loc")).alias("have"))
    return x.select("project_id", "files", (F.col("have").cast("double") / (3 * F.col("files"))).alias("score")).withColumn("status", scoring.completeness_status("score"))


@query(f"WITH {EDGES}, {COMPONENTS}, a AS (SELECT project_id, count(*) AS n FROM c GROUP BY 1), b AS (SELECT project_id, count(*) AS e FROM e GROUP BY 1) SELECT a.project_id, CASE WHEN n > 1 THEN CAST(e AS DOUBLE) / (CAST(n AS DOUBLE) * (n - 1) / 2) ELSE 0 END AS density, CAST(e AS DOUBLE) / n AS per_node FROM a JOIN b USING (project_id)")
def ref_c10_density(m):
    a = m.components("project_id").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    b = m.edges("project_id").groupBy("project_id").agg(F.count(F.lit(1)).alias("e"))
    return a.join(b, "project_id").select("project_id", scoring.density("e", "n").alias("density"), F.try_divide(F.col("e").cast("double"), F.col("n")).alias("per_node"))


@query(f"WITH {EDGES} SELECT edge_id, CASE edge_kind WHEN 'extends' THEN 90 WHEN 'implements' THEN 90 WHEN 'use_table' THEN 75 WHEN 'call' THEN 70 WHEN 'include' THEN 60 ELSE 50 END AS score FROM e WHERE src_id <> 0 AND dst_id <> 0")
def ref_c11_edge_relatedness(m):
    from lodegraph.operators.relational import edge_score

    return m.edges("src_id", "dst_id", "edge_kind").where("src_id <> 0 and dst_id <> 0").select("edge_id", edge_score().alias("score"))


@query(f"WITH {COMPONENTS}, b AS (SELECT project_id, regexp_replace(component_name, '(Service|Controller|Repository|DAO|DTO|VO|Impl|Test)$', '') AS base, count(*) AS n, min(component_id) AS first FROM c WHERE component_type = 'class' GROUP BY 1, 2) SELECT project_id, base, n AS classes, first, 80 AS score_pct FROM b WHERE n > 1")
def ref_c12_naming_relatedness(m):
    b = m.components("project_id", "component_name", "component_type").where("component_type = 'class'").groupBy("project_id", code.suffix_stripped("component_name").alias("base")).agg(F.count(F.lit(1)).alias("classes"), F.min("component_id").alias("first"))
    return b.where("classes > 1").withColumn("score_pct", F.lit(80))


_JOINS = r"""j AS (SELECT file_id, upper(unnest(regexp_extract_all(clean, '(?i)\bJOIN\s+([A-Za-z_][A-Za-z0-9_.]*)\s+(?:[A-Za-z_][A-Za-z0-9_]*\s+)?ON\s*\(?\s*([A-Za-z0-9_.]+)\s*=\s*([A-Za-z0-9_.]+)', 1))) AS target, unnest(regexp_extract_all(clean, '(?i)\bJOIN\s+([A-Za-z_][A-Za-z0-9_.]*)\s+(?:[A-Za-z_][A-Za-z0-9_]*\s+)?ON\s*\(?\s*([A-Za-z0-9_.]+)\s*=\s*([A-Za-z0-9_.]+)', 2)) AS l, unnest(regexp_extract_all(clean, '(?i)\bJOIN\s+([A-Za-z_][A-Za-z0-9_.]*)\s+(?:[A-Za-z_][A-Za-z0-9_]*\s+)?ON\s*\(?\s*([A-Za-z0-9_.]+)\s*=\s*([A-Za-z0-9_.]+)', 3)) AS r FROM x)"""


@query(f"{_T}, {_SQLFILES}, {_JOINS}, k AS (SELECT target, split_part(r, '.', 2) AS col, count(*) AS n FROM j GROUP BY 1, 2) SELECT target, col, n, n >= 2 AS inferred, CASE WHEN n >= 2 THEN 90 ELSE 70 END AS pct FROM k")
def ref_c14_keys_by_frequency(m):
    k = X.sql_joins(_texts(m, ".sql"), "file_id", "content").groupBy("target", F.split_part("right", F.lit("."), F.lit(2)).alias("col")).agg(F.count(F.lit(1)).alias("n"))
    return k.select("target", "col", "n", (F.col("n") >= 2).alias("inferred"), F.when(F.col("n") >= 2, F.least(F.lit(100), F.lit(70) + 20)).otherwise(70).alias("pct"))


_PK = r"""pk AS (SELECT DISTINCT upper(regexp_extract(s, '(?i)CREATE TABLE ([A-Za-z0-9_]+)', 1)) AS tab, lower(regexp_extract(s, '(?i)PRIMARY KEY \(([A-Za-z0-9_]+)\)', 1)) AS col FROM (SELECT unnest(string_split(flat, ';')) AS s FROM x) WHERE regexp_matches(s, '(?i)CREATE TABLE [A-Za-z0-9_]+') AND regexp_matches(s, '(?i)PRIMARY KEY \('))"""


@query(f"{_T}, {_SQLFILES}, {_JOINS} SELECT DISTINCT l, r, CASE WHEN regexp_matches(lower(l), '(^|\\.)id$|_id$') OR regexp_matches(lower(r), '(^|\\.)id$|_id$') THEN 90 ELSE 70 END AS pct FROM j")
def ref_c16_keys_by_name(m):
    j = X.sql_joins(_texts(m, ".sql"), "file_id", "content").select(F.col("left").alias("l"), F.col("right").alias("r")).distinct()
    named = F.lower("l").rlike(r"(^|\.)id$|_id$") | F.lower("r").rlike(r"(^|\.)id$|_id$")
    return j.select("l", "r", F.when(named, 90).otherwise(70).alias("pct"))


# X: extraction -------------------------------------------------------------------
@query(f"{_T}, {_SQLFILES}, s AS (SELECT file_id, unnest(regexp_split_to_array(clean, ';[ \\t\\r]*(?:\\n|$)')) AS st FROM x), n AS (SELECT file_id, trim(regexp_replace(st, '[ \\t\\r\\n]+', ' ', 'g')) AS statement FROM s) SELECT file_id, statement, count(*) AS n FROM n WHERE statement <> '' GROUP BY ALL")
def ref_x1_statements(m):
    return _texts(m, ".sql").select("file_id", F.explode(sqltext.statements("content")).alias("statement")).groupBy("file_id", "statement").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_T}, {_SQLFILES} SELECT DISTINCT file_id, upper(unnest(regexp_extract_all(clean, '(?i)\\b(?:FROM|JOIN|UPDATE|INTO)\\s+([A-Za-z_][A-Za-z0-9_$#.]*)', 1))) AS table_name FROM x")
def ref_x2_tables(m):
    return _texts(m, ".sql").select("file_id", F.explode(sqltext.tables("content")).alias("table_name"))


@query(f"{_T}, {_SQLFILES}, k AS (SELECT file_id, lower(unnest(regexp_extract_all(clean, '\\b[a-z]\\.([a-z_]+)\\b', 1))) AS col FROM x) SELECT file_id, col, count(*) AS n FROM k GROUP BY ALL")
def ref_x3_columns(m):
    return _texts(m, ".sql").select("file_id", F.explode(F.regexp_extract_all(sqltext.without_comments("content"), F.lit(r"\b[a-z]\.([a-z_]+)\b"), F.lit(1))).alias("col")).groupBy("file_id", F.lower("col").alias("col")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_T}, {_SQLFILES}, {_JOINS} SELECT file_id, target, l, r, count(*) AS n FROM j GROUP BY ALL")
def ref_x4_joins(m):
    return X.sql_joins(_texts(m, ".sql"), "file_id", "content").groupBy("file_id", "target", F.col("left").alias("l"), F.col("right").alias("r")).agg(F.count(F.lit(1)).alias("n"))


@query()
def ref_x5_implicit_joins(m):
    return X.implicit_joins(_texts(m, ".sql"), "file_id", "content")


@query(f"{_T}, {_SQLFILES}, s AS (SELECT file_id, unnest(string_split(flat, ';')) || ';' AS st FROM x), w AS (SELECT file_id, regexp_extract(st, '(?i)\\bWHERE (.*?)(?: GROUP BY| ORDER BY| HAVING|;|$)', 1) AS wh FROM s), k AS (SELECT file_id, trim(unnest(regexp_split_to_array(wh, '(?i) AND | OR '))) AS cond FROM w) SELECT file_id, cond, count(*) AS n FROM k WHERE cond <> '' GROUP BY ALL")
def ref_x6_filters(m):
    s = _texts(m, ".sql").select("file_id", F.explode(F.split(F.regexp_replace(sqltext.without_comments("content"), r"[ \t\r\n]+", " "), ";")).alias("st"))
    return s.select("file_id", F.explode(sqltext.conditions(F.concat("st", F.lit(";")))).alias("cond")).groupBy("file_id", "cond").agg(F.count(F.lit(1)).alias("n"))


@query()
def ref_x7_alias_map(m):
    return X.alias_map(_texts(m, ".sql"), "file_id", "content")


_XML = "x AS (SELECT f.file_id, content FROM t JOIN f USING (file_id) WHERE f.path LIKE '%.xml' AND content IS NOT NULL)"


@query(f"{_T}, {_XML} SELECT file_id, md5(regexp_replace(regexp_replace(content, '<(?:if|choose|when|otherwise|where|set|foreach|trim|bind)\\b[^>]*>|</(?:if|choose|when|otherwise|where|set|foreach|trim)>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS stripped FROM x")
def ref_x8_dynamic_tags(m):
    return _texts(m, ".xml").select("file_id", F.md5(X.without_dynamic_tags("content")).alias("stripped"))


_STMT = r"<(select|insert|update|delete)\s+id=\"([^\"]+)\"[^>]*>"


@query(f"{_T}, {_XML} SELECT file_id, unnest(regexp_extract_all(content, '{_STMT}', 1)) AS kind, unnest(regexp_extract_all(content, '{_STMT}', 2)) AS stmt_id, regexp_extract(content, '<mapper\\s+namespace=\"([^\"]+)\"', 1) AS ns FROM x")
def ref_x9_mapper_statements(m):
    return X.mapper_statements(_texts(m, ".xml"), "file_id", "content")


@query(f"{_T}, {_XML}, i AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '<include\\s+refid=\"([^\"]+)\"', 1)) AS refid FROM x), d AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '<sql\\s+id=\"([^\"]+)\"', 1)) AS refid FROM x) SELECT i.file_id, i.refid, d.refid IS NOT NULL AS resolved FROM i LEFT JOIN d ON d.file_id = i.file_id AND d.refid = i.refid")
def ref_x9_fragment_includes(m):
    return X.includes(_texts(m, ".xml"), "file_id", "content")


@query(f"{_T}, {_XML}, k AS (SELECT file_id, unnest(regexp_extract_all(content, '[#$]\\{{\\s*([A-Za-z_][A-Za-z0-9_.]*)', 1)) AS name FROM x) SELECT file_id, name, count(*) AS n FROM k GROUP BY ALL")
def ref_x10_placeholders(m):
    return _texts(m, ".xml").select("file_id", F.explode(F.regexp_extract_all("content", F.lit(sqltext.PLACEHOLDER), F.lit(1))).alias("name")).groupBy("file_id", "name").agg(F.count(F.lit(1)).alias("n"))


def _feature_sql() -> str:
    parts = ", ".join(f"CASE WHEN regexp_matches(clean, '{p}') THEN '{n}' END" for n, p in sorted(sqltext.FEATURES.items()))
    return f"{_T}, {_SQLFILES} SELECT file_id, list_aggregate(list_filter([{parts}], lambda v: v IS NOT NULL), 'string_agg', ',') AS features FROM x"


@query(_feature_sql())
def ref_x11_dialect_features(m):
    x = _texts(m, ".sql").select("file_id", sqltext.features("content").alias("f"))
    return x.select("file_id", F.when(F.size("f") > 0, F.array_join("f", ",")).alias("features"))


_JAVA = "x AS (SELECT f.file_id, content FROM t JOIN f USING (file_id) WHERE f.path LIKE '%.java' AND content IS NOT NULL)"


@query(f"{_T}, {_JAVA} SELECT file_id, regexp_extract(content, '(?m)^package ([a-z0-9_.]+);', 1) AS package, regexp_extract(content, '\\b(class|interface|enum) ([A-Z][A-Za-z0-9_]*)', 1) AS kind, regexp_extract(content, '\\b(class|interface|enum) ([A-Z][A-Za-z0-9_]*)', 2) AS name, len(regexp_extract_all(content, '(?m)^import [A-Za-z0-9_.*]+;')) AS imports FROM x")
def ref_x12_java_types(m):
    return X.java_types(_texts(m, ".java"), "file_id", "content")


@query(f"{_T}, {_JAVA} SELECT file_id, unnest(regexp_extract_all(content, '(?m)^import ([A-Za-z0-9_.]+);', 1)) AS target, 'import' AS kind FROM x UNION SELECT file_id, unnest(regexp_extract_all(content, '\\bnew ([A-Z][A-Za-z0-9_]*)', 1)), 'new' FROM x UNION SELECT file_id, unnest(regexp_extract_all(content, '\\bextends ([A-Z][A-Za-z0-9_]*)', 1)), 'extends' FROM x UNION SELECT file_id, unnest(regexp_extract_all(content, '\\bimplements ([A-Z][A-Za-z0-9_]*)', 1)), 'implements' FROM x")
def ref_x13_java_dependencies(m):
    return X.by_patterns(_texts(m, ".java"), "file_id", "content", {"import": r"(?m)^import ([A-Za-z0-9_.]+);", "new": r"\bnew ([A-Z][A-Za-z0-9_]*)", "extends": r"\bextends ([A-Z][A-Za-z0-9_]*)", "implements": r"\bimplements ([A-Z][A-Za-z0-9_]*)"})


@query(f"{_T}, {_JAVA}, k AS (SELECT file_id, unnest(regexp_extract_all(content, '\\b([a-z][A-Za-z0-9_]*)\\.([a-z][A-Za-z0-9_]*)\\(', 1)) AS receiver, unnest(regexp_extract_all(content, '\\b([a-z][A-Za-z0-9_]*)\\.([a-z][A-Za-z0-9_]*)\\(', 2)) AS method FROM x) SELECT file_id, receiver, method, count(*) AS calls FROM k GROUP BY ALL")
def ref_x14_java_calls(m):
    return X.java_calls(_texts(m, ".java"), "file_id", "content")


_JSP = "x AS (SELECT f.file_id, content FROM t JOIN f USING (file_id) WHERE f.path LIKE '%.jsp' AND content IS NOT NULL)"


@query(f"{_T}, {_JSP} SELECT file_id, len(regexp_extract_all(content, '<%@[^%]*%>')) AS directives, len(regexp_extract_all(content, '<%=[^%]*%>')) AS expressions, len(regexp_extract_all(content, '<%[^@=!%-][^%]*%>')) AS scriptlets, len(regexp_extract_all(content, '<c:[a-zA-Z]+')) AS jstl FROM x")
def ref_x15_jsp_parts(m):
    n = code.count_of
    return _texts(m, ".jsp").select("file_id", n("content", "<%@[^%]*%>").alias("directives"), n("content", "<%=[^%]*%>").alias("expressions"), n("content", "<%[^@=!%-][^%]*%>").alias("scriptlets"), n("content", "<c:[a-zA-Z]+").alias("jstl"))


@query(f"{_T}, {_JSP} SELECT file_id, len(regexp_extract_all(content, '<c:forEach\\b')) = len(regexp_extract_all(content, '</c:forEach>')) AS balanced, len(regexp_extract_all(content, '\\$\\{{[^}}]*\\}}')) AS el FROM x")
def ref_x16_jsp_validation(m):
    n = code.count_of
    return _texts(m, ".jsp").select("file_id", (n("content", r"<c:forEach\b") == n("content", "</c:forEach>")).alias("balanced"), n("content", r"\$\{[^}]*\}").alias("el"))


@query(f"{_T}, {_JSP}, u AS (SELECT file_id, unnest(regexp_extract_all(content, 'action=\"(/[^\"]*)\"', 1)) AS url FROM x) SELECT DISTINCT file_id, url, 'form' AS kind FROM u")
def ref_x17_jsp_relations(m):
    return X.by_patterns(_texts(m, ".jsp"), "file_id", "content", {"form": r'action="(/[^"]*)"'}).select("file_id", F.col("target").alias("url"), "kind")


@query(f"{_T}, {_XML} SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '<mapper\\s+namespace=\"([^\"]+)\"', 1)) AS target, 'namespace' AS kind FROM x UNION SELECT file_id, unnest(regexp_extract_all(content, 'resultType=\"([^\"]+)\"', 1)), 'result' FROM x UNION SELECT file_id, unnest(regexp_extract_all(content, '(?:FROM|JOIN|INTO|UPDATE|from)\\s+(T_[A-Z0-9_]+)', 1)), 'table' FROM x")
def ref_x18_mapper_relations(m):
    return X.by_patterns(_texts(m, ".xml"), "file_id", "content", {"namespace": r'<mapper\s+namespace="([^"]+)"', "result": r'resultType="([^"]+)"', "table": r"(?:FROM|JOIN|INTO|UPDATE|from)\s+(T_[A-Z0-9_]+)"})


@query(f"{_T}, {_SQLFILES}, s AS (SELECT file_id, trim(unnest(string_split(flat, ';'))) AS st FROM x), i AS (SELECT DISTINCT file_id, upper(regexp_extract(st, '(?i)^INSERT INTO ([A-Za-z0-9_]+)', 1)) AS tab FROM s WHERE regexp_matches(st, '(?i)^INSERT INTO ')), r AS (SELECT DISTINCT file_id, upper(unnest(regexp_extract_all(st, '(?i)\\b(?:FROM|JOIN) ([A-Za-z0-9_]+)', 1))) AS tab FROM s WHERE regexp_matches(st, '(?i)^SELECT ')) SELECT i.file_id, i.tab FROM i JOIN r ON r.file_id = i.file_id AND r.tab = i.tab")
def ref_x19_data_flow(m):
    return X.insert_to_select(_texts(m, ".sql"), "file_id", "content")


@query(f"{_T}, {_JAVA}, k AS (SELECT file_id, unnest(regexp_extract_all(content, '(?m)^[ \\t]*@([A-Z][A-Za-z]*)', 1)) AS annotation FROM x) SELECT annotation, count(*) AS n, count(DISTINCT file_id) AS files FROM k GROUP BY 1")
def ref_x21_annotations(m):
    k = _texts(m, ".java").select("file_id", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*@([A-Z][A-Za-z]*)"), F.lit(1))).alias("annotation"))
    return k.groupBy("annotation").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_id").alias("files"))


@query(f"{_T}, l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS pos FROM t WHERE content IS NOT NULL) SELECT file_id, CAST(pos // 40 AS INTEGER) AS chunk, md5(string_agg(line, chr(10) ORDER BY pos)) AS hash, count(*) AS lines FROM l GROUP BY 1, 2")
def ref_x23_line_chunks(m):
    return X.line_chunks(m.contents(), "file_id", "content", 40)


@query(f"{_T} SELECT t.file_id, CASE WHEN path LIKE '%.java' THEN 'java' WHEN path LIKE '%.jsp' THEN 'jsp' WHEN path LIKE '%.xml' AND contains(content, '<mapper') THEN 'mybatis' WHEN path LIKE '%.xml' AND contains(content, '<beans') THEN 'spring' WHEN path LIKE '%.xml' THEN 'xml' WHEN path LIKE '%.sql' THEN 'sql' ELSE 'none' END AS parser FROM t JOIN f USING (file_id) WHERE content IS NOT NULL")
def ref_x25_parser_choice(m):
    return _texts(m).select("file_id", X.parser_of("path", "content").alias("parser"))


@query(f"{_T}, l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM t WHERE content IS NOT NULL), h AS (SELECT file_id, min(line_no) AS at FROM l WHERE contains(line, 'catch (') GROUP BY 1) SELECT l.file_id, CAST(l.line_no AS INTEGER) AS line_no, l.line FROM l JOIN h USING (file_id) WHERE l.line_no BETWEEN h.at - 2 AND h.at + 2")
def ref_s13_context_window(m):
    return X.context(m.contents(), "file_id", "content", "catch (", 2)


@query(f"{_T}, l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM t WHERE content IS NOT NULL) SELECT file_id, CAST(line_no AS INTEGER) AS line_no, line AS content FROM l WHERE contains(line, 'INSERT INTO')")
def ref_s12_code_grep(m):
    return X.grep(m.contents(), "file_id", "content", "INSERT INTO").select("file_id", "line_no", F.col("line").alias("content"))


@query(f"{_T} SELECT CASE WHEN length(content) >= 5000 THEN 'huge' WHEN length(content) >= 1000 THEN 'large' ELSE 'normal' END AS size_class, count(*) AS n FROM t WHERE content IS NOT NULL GROUP BY 1")
def ref_s9_size_class(m):
    n = F.length("content")
    return m.contents().where("content is not null").groupBy(F.when(n >= 5000, "huge").when(n >= 1000, "large").otherwise("normal").alias("size_class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_T} SELECT file_id, len(regexp_extract_all(content, '//[^\\n]*')) + len(regexp_extract_all(content, '/\\*[^*]*\\*+(?:[^/*][^*]*\\*+)*/')) AS comments FROM t WHERE content IS NOT NULL")
def ref_y15_comment_count(m):
    return m.contents().where("content is not null").select("file_id", code.comments("content").alias("comments"))


@query(f"WITH {FILES}, {COMPONENTS}, k AS (SELECT file_id, count(*) AS classes FROM c WHERE component_type = 'class' GROUP BY 1) SELECT f.project_id, CASE WHEN coalesce(sum(classes), 0) = 0 THEN 0 ELSE CAST(sum(loc) AS DOUBLE) / CAST(sum(classes) AS DOUBLE) END AS lines_per_class FROM f LEFT JOIN k USING (file_id) GROUP BY 1")
def ref_y16_lines_per_class(m):
    k = m.components("project_id", "file_id", "component_type").where("component_type = 'class'").groupBy("file_id").agg(F.count(F.lit(1)).alias("classes"))
    return m.files().join(k, "file_id", "left").groupBy("project_id").agg(F.coalesce(F.try_divide(F.sum("loc").cast("double"), F.sum("classes").cast("double")), F.lit(0.0)).alias("lines_per_class"))


@query(f"WITH {FILES} SELECT project_id, CASE WHEN count(*) FILTER (loc > 100) * 10 > 3 * count(*) THEN 'complex' WHEN count(*) FILTER (loc > 100) * 10 > count(*) THEN 'moderate' ELSE 'simple' END AS complexity FROM f GROUP BY 1")
def ref_y17_complexity_rollup(m):
    x = m.files().groupBy("project_id").agg(F.count_if(F.col("loc") > 100).alias("big"), F.count(F.lit(1)).alias("n"))
    return x.select("project_id", F.when(F.col("big") * 10 > 3 * F.col("n"), "complex").when(F.col("big") * 10 > F.col("n"), "moderate").otherwise("simple").alias("complexity"))


@query(f"{_T} SELECT t.file_id, CASE WHEN regexp_matches(content, '@Controller|@RestController') THEN 'web' WHEN regexp_matches(content, '@Service') THEN 'service' WHEN regexp_matches(content, '@Repository') OR regexp_matches(path, '(Dao|Mapper)\\.java$') THEN 'data' ELSE 'other' END AS layer FROM t JOIN f USING (file_id) WHERE content IS NOT NULL AND path LIKE '%.java'")
def ref_y18_layer_by_content(m):
    c = F.col("content")
    layer = F.when(c.rlike("@Controller|@RestController"), "web").when(c.rlike("@Service"), "service").when(c.rlike("@Repository") | F.col("path").rlike(r"(Dao|Mapper)\.java$"), "data").otherwise("other")
    return _texts(m, ".java").select("file_id", layer.alias("layer"))


@query(f"{_T}, {_SQLFILES}, u AS (SELECT DISTINCT file_id, upper(unnest(regexp_extract_all(clean, '(?i)\\b(?:FROM|JOIN|UPDATE|INTO)\\s+([A-Za-z_][A-Za-z0-9_$#.]*)', 1))) AS tab FROM x) SELECT u.file_id, d.table_id, 90 AS pct FROM u JOIN db_tables d ON upper(d.table_name) = u.tab")
def ref_y11_sql_table_edges(m):
    u = _texts(m, ".sql").select("file_id", F.explode(sqltext.tables("content")).alias("tab"))
    return u.join(m.tables().select("table_id", F.upper("table_name").alias("tab")), "tab").select("file_id", "table_id", F.lit(90).alias("pct"))


@query(f"{_T}, {_SQLFILES}, {_JOINS}, k AS (SELECT target, l, r, count(*) AS n FROM j GROUP BY ALL) SELECT target, l, r, n, least(90, 60 + 10 * n) AS pct, 'N:1' AS cardinality FROM k")
def ref_y9_join_pattern_confidence(m):
    k = X.sql_joins(_texts(m, ".sql"), "file_id", "content").groupBy("target", F.col("left").alias("l"), F.col("right").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    return k.select("target", "l", "r", "n", F.least(F.lit(90), 60 + 10 * F.col("n")).alias("pct"), F.lit("N:1").alias("cardinality"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
