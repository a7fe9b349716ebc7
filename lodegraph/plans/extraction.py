"""Facts in source texts as rows: what stands where, with what it refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import code, sqltext
from lodegraph.functions.findings import matches
from lodegraph.model import COMPONENTS, CONTENTS, FILES, Model
from lodegraph.operators import chunks as C
from lodegraph.operators import extract as X
from lodegraph.plans.text import _SQLFILES, _T, _texts

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = lambda spark, d: f(Model(spark, d))
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _of(suffix: str, source: str = "content") -> str:
    return f"x AS (SELECT f.file_id, f.project_id, path, content FROM t JOIN f USING (file_id) WHERE f.path LIKE '%{suffix}' AND content IS NOT NULL)"


def _targets_sql(patterns: dict[str, str], text: str = "content") -> str:
    return " UNION ".join(f"SELECT DISTINCT file_id, unnest(regexp_extract_all({text}, '{_quoted(p)}', 1)) AS target, '{k}' AS kind FROM x" for k, p in patterns.items())


def _located_sql(patterns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT file_id, '{k}' AS kind, CAST(1 + length(list_aggregate(pieces[1:i], 'string_agg', '')) - length(replace(list_aggregate(pieces[1:i], 'string_agg', ''), chr(10), '')) AS INTEGER) AS line_no, m AS text FROM "
        f"(SELECT file_id, string_split(regexp_replace(content, '{_quoted(p)}', chr(1) || '\\0', 'g'), chr(1)) AS pieces, unnest(regexp_extract_all(content, '{_quoted(p)}')) AS m, generate_subscripts(regexp_extract_all(content, '{_quoted(p)}'), 1) AS i FROM x)"
        for k, p in patterns.items()
    )


def located(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(file_id, kind, line_no, text) of every match, in one pass over the texts."""

    def of(kind: str, pattern: str):
        return F.transform(matches("content", pattern), lambda z: F.struct(F.lit(kind).alias("kind"), z["line_no"].cast("int").alias("line_no"), z["text"].alias("text")))

    return df.select("file_id", F.inline(F.flatten(F.array_compact(F.array(*[of(k, p) for k, p in patterns.items()])))))


# Java ---------------------------------------------------------------------------------
MEMBERS = {
    "package": r"(?m)^package [a-z0-9_.]+;",
    "import": r"(?m)^import (?:static )?[A-Za-z0-9_.*]+;",
    "class": r"\bclass [A-Z][A-Za-z0-9_]*",
    "interface": r"\binterface [A-Z][A-Za-z0-9_]*",
    "enum": r"\benum [A-Z][A-Za-z0-9_]*",
    "method": r"(?m)^[ \t]+(?:(?:public|protected|private|static|final|abstract|synchronized) )+(?:[A-Za-z0-9_.<>,?\[\]]+ )+[a-z][A-Za-z0-9_]*\([^()]*\)",
    "constructor": r"(?m)^[ \t]+(?:public|protected|private) [A-Z][A-Za-z0-9_]*\([^()]*\)",
}


@query(f"{_T}, {_of('.java')} {_located_sql(MEMBERS)}")
def ref_x12_java_members(m):
    return located(_texts(m, ".java"), MEMBERS)


CALLS = {"object": r"\b([a-z][A-Za-z0-9_]*\.[a-z][A-Za-z0-9_]*)\(", "static": r"\b([A-Z][A-Za-z0-9_]*\.[a-z][A-Za-z0-9_]*)\(", "new": r"\bnew ([A-Z][A-Za-z0-9_]*)\("}
_CALLS = "k AS (" + " UNION ALL ".join(f"SELECT file_id, '{k}' AS kind, unnest(regexp_extract_all(content, '{p}', 1)) AS target FROM x" for k, p in CALLS.items()) + "), n AS (SELECT file_id, CASE WHEN starts_with(target, 'this.') THEN 'this' WHEN starts_with(target, 'super.') THEN 'super' ELSE kind END AS kind, CASE WHEN kind = 'new' THEN target ELSE split_part(target, '.', 1) END AS receiver, CASE WHEN kind = 'new' THEN '<init>' ELSE split_part(target, '.', 2) END AS method FROM k)"


def calls(df: DataFrame) -> DataFrame:
    """(file_id, project_id, kind, receiver, method) of each call: on this, super, an object or a class, or of a constructor."""

    def of(kind: str, pattern: str):
        return F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("target")))

    every = F.flatten(F.array(*[of(k, p) for k, p in CALLS.items()]))
    x = df.select("file_id", "project_id", F.inline(every))
    t, new, part = F.col("target"), F.col("kind") == "new", lambda i: F.split_part("target", F.lit("."), F.lit(i))
    kind = F.when(t.startswith("this."), "this").when(t.startswith("super."), "super").otherwise(F.col("kind"))
    return x.select("file_id", "project_id", kind.alias("kind"), F.when(new, t).otherwise(part(1)).alias("receiver"), F.when(new, "<init>").otherwise(part(2)).alias("method"))


@query(f"{_T}, {_of('.java')}, {_CALLS} SELECT file_id, kind, receiver, method, count(*) AS calls FROM n GROUP BY ALL")
def ref_x14_call_kinds(m):
    return calls(_texts(m, ".java")).groupBy("file_id", "kind", "receiver", "method").agg(F.count(F.lit(1)).alias("calls"))


_LAYERED = "(Service|Mapper|Repository|Dao|Controller)$"


@query(f"WITH {COMPONENTS}, {FILES}, {CONTENTS}, {_of('.java')}, {_CALLS}, r AS (SELECT n.file_id, x.project_id, upper(substring(receiver, 1, 1)) || substring(receiver, 2) AS name, count(*) AS calls FROM n JOIN x USING (file_id) WHERE kind IN ('object', 'static') AND regexp_matches(receiver, '{_LAYERED}') GROUP BY 1, 2, 3), d AS (SELECT project_id, component_name AS name, min(component_id) AS target FROM c WHERE component_type IN ('class', 'interface') GROUP BY 1, 2) SELECT r.file_id, r.name, regexp_extract(r.name, '{_LAYERED}', 1) AS layer, d.target, r.calls FROM r LEFT JOIN d ON d.project_id = r.project_id AND d.name = r.name")
def ref_x14_layer_edges(m):
    """Calls on services, mappers and the like, with the class of that name in the project; null where there is none."""
    c = calls(_texts(m, ".java")).where(F.col("kind").isin("object", "static") & F.col("receiver").rlike(_LAYERED))
    name = F.concat(F.upper(F.substring("receiver", 1, 1)), F.expr("substring(receiver, 2)"))
    r = c.groupBy("file_id", "project_id", name.alias("name")).agg(F.count(F.lit(1)).alias("calls"))
    d = m.components("project_id", "file_id", "component_name", "component_type").where("component_type in ('class', 'interface')").groupBy("project_id", F.col("component_name").alias("name")).agg(F.min("component_id").alias("target"))
    return r.join(d, ["project_id", "name"], "left").select("file_id", "name", F.regexp_extract("name", _LAYERED, 1).alias("layer"), "target", "calls")


JPA = {
    "entity": r"@Entity[^@]*?\bclass ([A-Z][A-Za-z0-9_]*)", "table": r"@Table\(\s*name\s*=\s*\"([^\"]+)\"", "column": r"@Column\([^)]*name\s*=\s*\"([^\"]+)\"", "join_column": r"@JoinColumn\([^)]*name\s*=\s*\"([^\"]+)\"",
    "relationship": r"@(OneToOne|OneToMany|ManyToOne|ManyToMany)\b", "query": r"@(?:Named)?Query\(\s*(?:value\s*=\s*)?\"([^\"]+)\"", "annotation": r"@(Entity|Table|Column|Id|Query|Repository|Transactional|GeneratedValue)\b",
}


@query(f"{_T}, {_of('.java')} {_targets_sql(JPA)}")
def ref_x20_jpa_facts(m):
    return X.by_patterns(_texts(m, ".java"), "file_id", "content", JPA)


SPRING = {
    "stereotype": r"@(Controller|RestController|Service|Repository|Component|Configuration)\b", "bean": r"@Bean[^{;]*?\b([a-z][A-Za-z0-9_]*)\(", "injected": r"@(?:Autowired|Resource|Inject)\b[^;]*?\b([A-Z][A-Za-z0-9_]*) [a-z]",
    "scan": r"@ComponentScan\([^\"]*\"([^\"]+)\"", "setting": r"@Value\(\"\$\{([A-Za-z0-9_.\-]+)", "endpoint": r"@(?:Request|Get|Post|Put|Delete|Patch)Mapping\((?:value\s*=\s*|path\s*=\s*)?\s*\"([^\"]+)\"",
}
SPRING_XML = {"bean": r"<bean\s+[^>]*?class=\"([^\"]+)\"", "bean_id": r"<bean\s+[^>]*?id=\"([^\"]+)\"", "scan": r"<context:component-scan\s+base-package=\"([^\"]+)\"", "setting": r"\$\{([A-Za-z0-9_.\-]+)\}", "property": r"<property\s+name=\"([^\"]+)\"", "datasource": r"<property\s+name=\"(?:url|driverClassName|jdbcUrl)\"\s+value=\"([^\"]+)\""}


@query(f"{_T}, {_of('.java')}, j AS ({_targets_sql(SPRING)}), y AS (SELECT f.file_id, content FROM t JOIN f USING (file_id) WHERE path LIKE '%.xml' AND content LIKE '%<bean%') SELECT * FROM j UNION " + _targets_sql(SPRING_XML).replace("FROM x", "FROM y"))
def ref_x21_spring_facts(m):
    java = X.by_patterns(_texts(m, ".java"), "file_id", "content", SPRING)
    return java.unionByName(X.by_patterns(_texts(m, ".xml").where(F.col("content").contains("<bean")), "file_id", "content", SPRING_XML))


CONTEXT = {
    "api_endpoint": SPRING["endpoint"], "setting": SPRING["setting"], "raises": r"throw new ([A-Z][A-Za-z]+)", "handles": r"catch \(([A-Z][A-Za-z]+)", "transaction": r"@(Transactional)\b", "schedule": r"@(Scheduled|Async)\b",
    "security": r"@(PreAuthorize|Secured|RolesAllowed)\b", "validation": r"@(Valid|NotNull|NotBlank|Size|Min|Max)\b", "cache": r"@(Cacheable|CacheEvict|CachePut)\b", "event": r"publishEvent\(new ([A-Z][A-Za-z]+)", "test": r"@(Test|BeforeEach|AfterEach)\b",
}


@query(f"{_T}, {_of('.java')} {_targets_sql(CONTEXT)}")
def ref_x24_context_facts(m):
    return X.by_patterns(_texts(m, ".java"), "file_id", "content", CONTEXT)


# JSP ------------------------------------------------------------------------------------
PARTS = {
    "directive": r"<%@[^%]*%>", "declaration": r"<%![^%]*%>", "expression": r"<%=[^%]*%>", "scriptlet": r"<%[^@=!%-][^%]*%>", "action": r"<jsp:[a-zA-Z]+", "jstl": r"<(?:c|fmt|fn|sql|x):[a-zA-Z]+", "el": r"[$#]\{[^}]*\}",
    "form": r"<form\b[^>]*>", "input": r"<(?:input|select|textarea|button)\b[^>]*>", "script": r"<script\b[^>]*>", "sql_text": r"\"[^\"\n]*\b(?:SELECT|INSERT|UPDATE|DELETE)\b[^\"\n]*\"", "sql_append": r"\.append\s*\(\s*\"[^\"\n]*\"",
}


@query(f"{_T}, {_of('.jsp')} {_located_sql(PARTS)}")
def ref_x15_jsp_rows(m):
    return located(_texts(m, ".jsp"), PARTS)


_PAIRED = ("c:forEach", "c:if", "c:choose", "c:when", "c:otherwise", "form", "table", "script")
_COUNT = lambda p: f"len(regexp_extract_all(content, '{p}'))"
_RULES = {**{f"unclosed {t}": (rf"<{t}\b", rf"</{t}>|<{t}\b[^>]*/>") for t in _PAIRED}, "unclosed scriptlet": ("<%", "%>"), "unclosed el": (r"\$\{", r"\$\{[^}]*\}")}


@query(f"{_T}, {_of('.jsp')}, r AS (" + " UNION ALL ".join(f"SELECT file_id, '{k}' AS rule, {_COUNT(a)} - {_COUNT(b)} AS missing FROM x" for k, (a, b) in _RULES.items()) + ") SELECT file_id, rule, CAST(missing AS INTEGER) AS missing FROM r WHERE missing <> 0")
def ref_x16_jsp_errors(m):
    n = code.count_of
    rows = F.array_compact(F.array(*[F.when(n("content", a) != n("content", b), F.struct(F.lit(k).alias("rule"), (n("content", a) - n("content", b)).alias("missing"))) for k, (a, b) in _RULES.items()]))
    return _texts(m, ".jsp").select("file_id", F.inline(rows))


LINKS = {"form": r"action=\"(/[^\"$<]*)", "c_url": r"<c:url\s+value=\"(/[^\"$]*)", "ajax": r"\burl\s*:\s*[\"'](/[^\"'$]*)", "href": r"href=\"(/[^\"$<]*\.do)\b", "include": r"<(?:jsp:include\s+page|%@\s*include\s+file)=\"([^\"$<]+)\""}


@query(f"{_T}, {_of('.jsp')}, l AS ({_targets_sql(LINKS)} UNION SELECT file_id, '/' || regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\\.jsp$', ''), 'file_name' FROM x), p AS (SELECT *, regexp_replace(lower(split_part(regexp_replace(target, '^/+', ''), '/', 1)), '\\..*$', '') AS part FROM l) SELECT file_id, target AS url, kind, CASE WHEN kind <> 'include' THEN upper(substring(part, 1, 1)) || substring(part, 2) || 'Controller' END AS controller FROM p")
def ref_x17_page_links(m):
    x = _texts(m, ".jsp")
    own = x.select("file_id", F.concat(F.lit("/"), F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.jsp$", "")).alias("target"), F.lit("file_name").alias("kind"))
    l = X.by_patterns(x, "file_id", "content", LINKS).unionByName(own)  # noqa: E741
    return l.select("file_id", F.col("target").alias("url"), "kind", F.when(F.col("kind") != "include", code.controller_of("target")).alias("controller"))


# Mapper files ----------------------------------------------------------------------------
MAPPER = {
    "namespace": r"<mapper\s+namespace=\"([^\"]+)\"", "fragment": r"<sql\s+id=\"([^\"]+)\"", "include": r"<include\s+refid=\"([^\"]+)\"", "result_map": r"<resultMap\s+[^>]*?id=\"([^\"]+)\"", "result_column": r"<(?:id|result)\s+[^>]*?column=\"([^\"]+)\"",
    "result_property": r"<(?:id|result)\s+[^>]*?property=\"([^\"]+)\"", "parameter_map": r"<parameterMap\s+[^>]*?id=\"([^\"]+)\"", "parameter_type": r"parameterType=\"([^\"]+)\"", "result_type": r"resultType=\"([^\"]+)\"", "dynamic": r"<(if|choose|when|otherwise|where|set|foreach|trim|bind)\b",
    "condition": r"<(?:if|when)\s+test=\"([^\"]+)\"", "table": r"(?:FROM|JOIN|INTO|UPDATE|from|join|into|update)\s+(T_[A-Z0-9_]+)",
}


@query(f"{_T}, {_of('.xml')} {_targets_sql(MAPPER)}")
def ref_x9_mapper_facts(m):
    return X.by_patterns(_texts(m, ".xml"), "file_id", "content", MAPPER)


@query()
def ref_x9_inlined_statements(m):
    return C.inlined_statements(_texts(m, ".xml").where(F.col("content").contains("<mapper")), "file_id", "content")


_CLASS_OF = {k: MAPPER[k] for k in ("namespace", "result_type", "parameter_type")}


@query(f"WITH {COMPONENTS}, {FILES}, {CONTENTS}, {_of('.xml')}, k AS ({_targets_sql(_CLASS_OF)}), d AS (SELECT project_id, component_name AS name, min(component_id) AS class_id FROM c WHERE component_type IN ('class', 'interface') GROUP BY 1, 2), tb AS (SELECT upper(table_name) AS tab, min(table_id) AS table_id FROM db_tables GROUP BY 1), w AS ({_targets_sql({'table': MAPPER['table']})}) SELECT k.file_id, k.target, k.kind, d.class_id AS target_id FROM k JOIN x USING (file_id) LEFT JOIN d ON d.project_id = x.project_id AND d.name = regexp_extract(k.target, '([^.]+)$', 1) UNION ALL SELECT w.file_id, w.target, w.kind, tb.table_id FROM w LEFT JOIN tb ON tb.tab = w.target")
def ref_x18_resolved_relations(m):
    """Mapper files to the classes and tables that they name; the id is null where the project or catalog has none."""
    x = _texts(m, ".xml")
    k = X.by_patterns(x, "file_id", "content", _CLASS_OF).join(x.select("file_id", "project_id"), "file_id").withColumn("name", F.regexp_extract("target", r"([^.]+)$", 1))
    d = m.components("project_id", "file_id", "component_name", "component_type").where("component_type in ('class', 'interface')").groupBy("project_id", F.col("component_name").alias("name")).agg(F.min("component_id").alias("target_id"))
    classes = k.join(d, ["project_id", "name"], "left").select("file_id", "target", "kind", "target_id")
    tables = m.tables().groupBy(F.upper("table_name").alias("target")).agg(F.min("table_id").alias("target_id"))
    w = X.by_patterns(x, "file_id", "content", {"table": MAPPER["table"]}).join(tables, "target", "left").select("file_id", "target", "kind", "target_id")
    return classes.unionByName(w)


# SQL --------------------------------------------------------------------------------------
CLAUSES = {
    "group_by": r"(?i)\bGROUP BY ([^;()]+?)(?: HAVING| ORDER BY|;|\)|$)", "order_by": r"(?i)\bORDER BY ([^;()]+?)(?: FETCH| FOR|;|\)|$)", "having": r"(?i)\bHAVING ([^;]+?)(?: ORDER BY|;|$)", "set_column": r"(?i)\bSET ([A-Za-z0-9_.]+) ?=", "start_with": r"(?i)\bSTART WITH ([^;]+?)(?: CONNECT|;|$)",
    "select_list": r"(?i)\bSELECT (?:DISTINCT )?([^;()]+?) FROM\b", "insert_columns": r"(?i)\bINSERT INTO [A-Za-z0-9_.]+ ?\(([^()]+)\)", "qualified": r"\b([A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*)\b",
}
HINTS = {"hint": r"/\*\+([^*]*)\*/"}


@query(f"{_T}, {_SQLFILES} {_targets_sql(CLAUSES, 'flat')} UNION {_targets_sql(HINTS)}")
def ref_x11_clauses(m):
    x = _texts(m, ".sql")
    flat = x.select("file_id", F.regexp_replace(sqltext.without_comments("content"), r"[ \t\r\n]+", " ").alias("flat"))
    return X.by_patterns(flat, "file_id", "flat", CLAUSES).unionByName(X.by_patterns(x, "file_id", "content", HINTS))


# Chunks -----------------------------------------------------------------------------------
@query()
def ref_x23_structural_chunks(m):
    return C.structural(_texts(m), "file_id", "path", "content")


@query(f"{_T} SELECT file_id, CAST(i AS INTEGER) AS chunk, md5(substring(content, CAST(i * 4096 + 1 AS BIGINT), 4096)) AS hash, CAST(length(substring(content, CAST(i * 4096 + 1 AS BIGINT), 4096)) AS INTEGER) AS chars FROM (SELECT file_id, content, unnest(range(0, greatest(1, (length(content) + 4095) // 4096))) AS i FROM t WHERE content IS NOT NULL)")
def ref_s8_size_chunks(m):
    return C.size_chunks(m.contents(), "file_id", "content", 4096)


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
