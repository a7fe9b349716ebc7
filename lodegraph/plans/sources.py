"""Scans, exports and the remaining catalog queries over the metadata tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from lodegraph.functions import sqltext
from lodegraph.model import COMPONENTS, CONTENTS, EDGES, FILES, Model
from lodegraph.operators import extract as X
from lodegraph.sources import scans
from lodegraph.streaming.monitor import shared_folder

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = lambda spark, d: f(Model(spark, d))
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


_CLEAN = r"regexp_replace(regexp_replace(content, '/\*[^*]*\*+([^/*][^*]*\*+)*/', ' ', 'g'), '--[^\n]*', ' ', 'g')"
_SQLT = f"{FILES}, {CONTENTS}, x AS (SELECT f.file_id, regexp_replace({_CLEAN}, '[ \\t\\r\\n]+', ' ', 'g') AS flat FROM t JOIN f USING (file_id) WHERE f.path LIKE '%.sql' AND content IS NOT NULL)"
_COLS = f"{_SQLT}, s AS (SELECT unnest(string_split(flat, ';')) AS st FROM x), c AS (SELECT DISTINCT upper(regexp_extract(st, '(?i)CREATE TABLE ([A-Za-z0-9_]+)', 1)) AS tab, unnest(regexp_extract_all(st, '[(,] ?([a-z_]+) (?:NUMBER|VARCHAR2|DATE)', 1)) AS col, regexp_extract(st, '(?i)PRIMARY KEY \\(([A-Za-z0-9_]+)\\)', 1) AS pk FROM s WHERE regexp_matches(st, '(?i)CREATE TABLE [A-Za-z0-9_]+'))"


def declared_columns(m: Model):
    """(tab, col, pk) of the columns that CREATE TABLE statements declare."""
    flat = F.regexp_replace(sqltext.without_comments("content"), r"[ \t\r\n]+", " ")
    texts = m.contents().where("content is not null").join(m.files().where("path like '%.sql'").select("file_id"), "file_id")
    s = texts.select(F.explode(F.split(flat, ";")).alias("st")).where(F.col("st").rlike("(?i)CREATE TABLE [A-Za-z0-9_]+"))
    return s.select(
        F.upper(F.regexp_extract("st", "(?i)CREATE TABLE ([A-Za-z0-9_]+)", 1)).alias("tab"), F.explode(F.regexp_extract_all("st", F.lit(r"[(,] ?([a-z_]+) (?:NUMBER|VARCHAR2|DATE)"), F.lit(1))).alias("col"),
        F.regexp_extract("st", r"(?i)PRIMARY KEY \(([A-Za-z0-9_]+)\)", 1).alias("pk"),
    ).distinct()


@query("SELECT upper(trim(coalesce(owner, ''))) AS owner, upper(trim(table_name)) AS table_name, table_comment AS comments FROM db_tables")
def ref_s3_schema_csv(m):
    """The catalog as a schema CSV in the shared folder, read back as text."""
    path = f"{shared_folder(m.spark, 'csv')}/ALL_TABLES.csv"
    m.tables().select(F.coalesce("owner", F.lit("")).alias("OWNER"), F.col("table_name").alias("TABLE_NAME"), F.col("table_comment").alias("COMMENTS")).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    x = scans.schema_csv(m.spark, path)
    return x.select(F.coalesce("OWNER", F.lit("")).alias("owner"), F.col("TABLE_NAME").alias("table_name"), F.col("COMMENTS").alias("comments"))


@query("WITH k AS (SELECT upper(trim(owner)) AS o, upper(trim(table_name)) AS t, 'C ' || min(table_id) AS c FROM db_tables WHERE table_comment IS NULL AND owner IS NOT NULL GROUP BY 1, 2) SELECT d.table_id, coalesce(k.c, d.table_comment) AS table_comment FROM db_tables d LEFT JOIN k ON k.o = upper(d.owner) AND k.t = upper(d.table_name)")
def ref_s4_comment_csv(m):
    c = m.tables().where("table_comment is null and owner is not null").groupBy(F.lower("owner").alias("OWNER"), F.lower("table_name").alias("TABLE_NAME")).agg(F.concat(F.lit("C "), F.min("table_id").cast("string")).alias("COMMENTS"))
    return scans.comment_csv(m.tables().select("table_id", "owner", "table_name", "table_comment"), c).select("table_id", "table_comment")


@query(f"WITH {_COLS}, fk AS (SELECT tab, col, upper(regexp_replace(col, '_id$', '')) AS target FROM c WHERE col LIKE '%\\_id' ESCAPE '\\') SELECT DISTINCT fk.tab AS table_name, fk.col AS column_name, fk.target AS foreign_table, fk.target NOT IN (SELECT tab FROM c) AS dummy FROM fk")
def ref_s5_column_list(m):
    fk = F.col("col").endswith("_id")
    rows = declared_columns(m).select(F.col("tab").alias("table_name"), F.col("col").alias("column_name"), F.when(fk, "Y").otherwise("N").alias("is_foreign_key"), F.when(fk, F.upper(F.regexp_replace("col", "_id$", ""))).alias("foreign_table"), F.lit("id").alias("foreign_column"))
    return scans.column_list_csv(rows)[1].select("table_name", "column_name", "foreign_table", "dummy")


@query(f"WITH {FILES} SELECT regexp_extract(path, '^([^/]+)/', 1) AS path, replace(regexp_replace(regexp_extract(path, 'src/main/java/(.*)$', 1), '\\.java$', ''), '/', '.') AS class_name FROM f WHERE path LIKE '%/src/main/java/%.java'")
def ref_s6_archive_classes(m):
    """Archives made of each project's classes, listed by their entries."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for i, name in enumerate(sorted(pdf["name"])):
                z.writestr(name, str(i))
        return pd.DataFrame({"path": [pdf["project"].iloc[0]], "content": [data.getvalue()]})

    x = m.files().where("path like '%/src/main/java/%.java'").select(F.regexp_extract("path", "^([^/]+)/", 1).alias("project"), F.concat(F.regexp_extract("path", r"src/main/java/(.*)\.java$", 1), F.lit(".class")).alias("name"))
    return scans.archive_classes(x.groupBy("project").applyInPandas(pack, "path string, content binary")).select("path", "class_name")


@query(f"WITH {CONTENTS} SELECT length(content) AS n, count(*) AS files FROM t WHERE content IS NOT NULL AND content <> '' GROUP BY 1")
def ref_s7_whole_texts(m):
    """Texts written to the shared folder, a tree with a folder per project, and read back whole."""
    root = shared_folder(m.spark, "tree")
    x = m.contents().where("content is not null and content <> ''").join(m.files().select("file_id", F.coalesce("project_id", F.lit(-1)).alias("project")), "file_id")
    x.select("content", "project").write.partitionBy("project").option("lineSep", "\x01").text(root)
    back = scans.whole_texts(m.spark, root, ["**/*.txt"], []).select(F.explode(F.split("content", "\x01")).alias("content"))
    return back.where("content <> ''").groupBy(F.length("content").alias("n")).agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {EDGES} SELECT CAST(to_json({{'id': edge_id, 'source': src_type || ':' || src_id, 'target': dst_type || ':' || dst_id, 'kind': edge_kind}}) AS VARCHAR) AS value FROM e WHERE dst_id IS NOT NULL")
def ref_k1_json_edges(m):
    e = m.edges().where("dst_id is not null")
    return e.select(F.to_json(F.struct(F.col("edge_id").alias("id"), F.concat_ws(":", "src_type", "src_id").alias("source"), F.concat_ws(":", "dst_type", "dst_id").alias("target"), F.col("edge_kind").alias("kind"))).alias("value"))


@query(f"WITH {_COLS}, p AS (SELECT DISTINCT tab, pk FROM c WHERE pk <> '') SELECT DISTINCT c.tab AS src_table, c.col AS src_column, p.tab AS dst_table FROM c JOIN p ON p.pk = c.col AND p.tab <> c.tab")
def ref_y2_fk_inference(m):
    c = declared_columns(m)
    p = c.where("pk <> ''").select(F.col("tab").alias("dst_table"), F.col("pk").alias("col")).distinct()
    return c.join(p, "col").where("dst_table <> tab").select(F.col("tab").alias("src_table"), F.col("col").alias("src_column"), "dst_table").distinct()


@query(f"WITH {_COLS} SELECT tab, col, row_number() OVER (PARTITION BY tab ORDER BY col = pk DESC, col, pk) AS position FROM c")
def ref_y4_column_order(m):
    from pyspark.sql import Window as W

    c = declared_columns(m)
    return c.select("tab", "col", F.row_number().over(W.partitionBy("tab").orderBy((F.col("col") == F.col("pk")).desc(), "col", "pk")).alias("position"))


_JAVA = "x AS (SELECT f.file_id, content FROM t JOIN f USING (file_id) WHERE f.path LIKE '%.java' AND content IS NOT NULL)"


@query(f"WITH {FILES}, {CONTENTS}, {_JAVA} SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '@(Entity|Table|Column|Id|OneToMany|ManyToOne|Query|Repository)\\b', 1)) AS target, 'jpa' AS kind FROM x UNION SELECT file_id, unnest(regexp_extract_all(content, '@Table\\(\\s*name\\s*=\\s*\"([^\"]+)\"', 1)), 'table' FROM x")
def ref_x20_jpa_mappings(m):
    x = m.contents().where("content is not null").join(m.files().where("path like '%.java'").select("file_id"), "file_id")
    return X.by_patterns(x, "file_id", "content", {"jpa": r"@(Entity|Table|Column|Id|OneToMany|ManyToOne|Query|Repository)\b", "table": r'@Table\(\s*name\s*=\s*"([^"]+)"'})


@query(f"WITH {FILES}, {CONTENTS}, {_JAVA} SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '@Value\\(\"\\$\\{{([a-z.]+)', 1)) AS target, 'setting' AS kind FROM x UNION SELECT file_id, unnest(regexp_extract_all(content, '@(?:Request|Get|Post)Mapping\\(\\s*\"([^\"]+)\"', 1)), 'api_endpoint' FROM x UNION SELECT file_id, unnest(regexp_extract_all(content, 'throw new ([A-Z][A-Za-z]+)', 1)), 'raises' FROM x")
def ref_x24_context_edges(m):
    x = m.contents().where("content is not null").join(m.files().where("path like '%.java'").select("file_id"), "file_id")
    return X.by_patterns(x, "file_id", "content", {"setting": r'@Value\("\$\{([a-z.]+)', "api_endpoint": r'@(?:Request|Get|Post)Mapping\(\s*"([^"]+)"', "raises": r"throw new ([A-Z][A-Za-z]+)"})


@query(f"WITH {COMPONENTS}, {FILES} SELECT c.component_id, c.component_name, f.path, p.name AS project, b.component_name AS parent FROM c JOIN f ON f.file_id = c.file_id JOIN projects p ON p.project_id = f.project_id LEFT JOIN c b ON b.component_id = c.parent_component_id WHERE c.component_type IN ('class', 'interface')")
def ref_j9_component_view(m):
    c = m.components("project_id", "file_id", "component_name", "component_type", "parent_component_id")
    b = c.select(F.col("component_id").alias("parent_component_id"), F.col("component_name").alias("parent"))
    x = c.where("component_type in ('class', 'interface')").drop("project_id").join(m.files().select("file_id", "path", "project_id"), "file_id").join(m.projects().select("project_id", F.col("name").alias("project")), "project_id")
    return x.join(b, "parent_component_id", "left").select("component_id", "component_name", "path", "project", "parent")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
