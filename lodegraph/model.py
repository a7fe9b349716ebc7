"""The metadata model: tables as frames without repeated rows, typed node keys, and D12-style views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.session import table

COMPONENT_COLUMNS = ("project_id", "file_id", "component_name", "component_type", "parent_component_id", "line_start", "line_end", "hash_value")
EDGE_COLUMNS = ("project_id", "src_type", "src_id", "dst_type", "dst_id", "edge_kind", "confidence", "meta", "created_at")
NODE_TYPES = ("file", "class", "interface", "method", "sql_unit", "table")


class Model:
    """Frames of one metadata store; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.directory, name)

    def files(self) -> DataFrame:
        cols = ("project_id", "path", "language", "loc", "hash")
        return self.raw("files").groupBy("file_id").agg(*[F.max(c).alias(c) for c in cols])

    def contents(self) -> DataFrame:
        return self.raw("file_contents").groupBy("file_id").agg(F.max("content").alias("content"))

    def edges(self, *columns: str) -> DataFrame:
        """Edges without repeated rows: ids and the named columns, or all. Repeated rows are equal, so they go whatever
        is named, and only what is named moves."""
        lower = {c: F.lower(c).alias(c) for c in ("src_type", "dst_type")}
        return self.raw("edges").select("edge_id", *[lower.get(c, c) for c in columns or EDGE_COLUMNS]).distinct()

    def hints(self) -> DataFrame:
        return self.raw("edge_hints").withColumn("src_type", F.lower("src_type")).distinct()

    def components(self, *columns: str) -> DataFrame:
        """As :meth:`edges`, for components."""
        return self.raw("components").select("component_id", *(columns or COMPONENT_COLUMNS)).distinct()

    def sql_units(self) -> DataFrame:
        return self.raw("sql_units").select("sql_id", "file_id", "origin", "mapper_ns", "stmt_id", "start_line", "end_line", "stmt_kind", "normalized_fingerprint").distinct()

    def tables(self) -> DataFrame:
        return self.raw("db_tables")

    def projects(self) -> DataFrame:
        return self.raw("projects")

    def nodes(self) -> DataFrame:
        """(node_type, node_id, label, file_id, project_id) of everything an edge can point at."""
        files = self.files()
        owner = files.select("file_id", F.col("project_id").alias("pid"))
        f = files.select(F.lit("file").alias("node_type"), F.col("file_id").alias("node_id"), F.col("path").alias("label"), "file_id", "project_id")
        c = self.components("project_id", "file_id", "component_name", "component_type").where(F.col("component_type").isin("class", "interface", "method")).select(F.col("component_type").alias("node_type"), F.col("component_id").alias("node_id"), F.col("component_name").alias("label"), "file_id", "project_id")
        s = self.sql_units().join(owner, "file_id", "left").select(F.lit("sql_unit").alias("node_type"), F.col("sql_id").alias("node_id"), F.coalesce("stmt_id", F.lit("?")).alias("label"), "file_id", F.col("pid").alias("project_id"))
        t = self.tables().select(F.lit("table").alias("node_type"), F.col("table_id").alias("node_id"), F.col("table_name").alias("label"), F.lit(None).cast("long").alias("file_id"), F.lit(None).cast("long").alias("project_id"))
        return f.unionByName(c).unionByName(s).unionByName(t)


#: The same frames as SQL.
FILES = "f AS (SELECT file_id, max(project_id) AS project_id, max(path) AS path, max(language) AS language, max(loc) AS loc, max(hash) AS hash FROM files GROUP BY file_id)"
CONTENTS = "t AS (SELECT file_id, max(content) AS content FROM file_contents GROUP BY file_id)"
EDGES = "e AS (SELECT DISTINCT edge_id, project_id, lower(src_type) AS src_type, src_id, lower(dst_type) AS dst_type, dst_id, edge_kind, confidence, meta, created_at FROM edges)"
HINTS = "h AS (SELECT DISTINCT hint_id, project_id, lower(src_type) AS src_type, src_id, hint_type, hint, confidence, created_at FROM edge_hints)"
COMPONENTS = "c AS (SELECT DISTINCT component_id, project_id, file_id, component_name, component_type, parent_component_id, line_start, line_end, hash_value FROM components)"
UNITS = "s AS (SELECT DISTINCT sql_id, file_id, origin, mapper_ns, stmt_id, start_line, end_line, stmt_kind, normalized_fingerprint FROM sql_units)"
NODES = f"""{FILES}, {COMPONENTS}, {UNITS}, n AS (
  SELECT 'file' AS node_type, file_id AS node_id, path AS label, file_id, project_id FROM f
  UNION ALL SELECT component_type, component_id, component_name, file_id, project_id FROM c WHERE component_type IN ('class', 'interface', 'method')
  UNION ALL SELECT 'sql_unit', sql_id, coalesce(stmt_id, '?'), s.file_id, f.project_id FROM s LEFT JOIN f USING (file_id)
  UNION ALL SELECT 'table', table_id, table_name, NULL, NULL FROM db_tables)"""
