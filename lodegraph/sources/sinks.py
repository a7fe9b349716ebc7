"""Graph, report and finding exports: rows ready to write, and the writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_rows(edges: DataFrame, least: float, keep: list[str]) -> DataFrame:
    """(id, source, target, kind, confidence): confident edges, and kinds that are always kept."""
    e = edges.where("dst_id is not null").where((F.col("confidence") >= least) | F.col("edge_kind").isin(*keep))
    return e.select(F.col("edge_id").alias("id"), F.concat_ws(":", "src_type", "src_id").alias("source"), F.concat_ws(":", "dst_type", "dst_id").alias("target"), F.col("edge_kind").alias("kind"), "confidence")


def node_rows(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.concat_ws(":", "node_type", "node_id").alias("id"), "label", F.col("node_type").alias("type"), F.coalesce("project_id", F.lit(-1)).cast("string").alias("grp"))


def _mermaid_id(kind: str, key: str):
    return F.regexp_replace(F.concat_ws("_", kind, key), "[^A-Za-z0-9_]", "_")


def mermaid_lines(edges: DataFrame) -> DataFrame:
    """One line per edge; ids are sanitised."""
    return edges.select(F.concat(F.lit("    "), _mermaid_id("src_type", "src_id"), F.lit(" -->|"), "edge_kind", F.lit("| "), _mermaid_id("dst_type", "dst_id")).alias("line"), "edge_id")


def write_json_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """``nodes`` and ``edges`` as JSON lines in two folders under ``path``."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def write_csv_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").option("header", True).csv(f"{path}/nodes")
    edges.write.mode("overwrite").option("header", True).csv(f"{path}/edges")


def write_mermaid(edges: DataFrame, path: str) -> None:
    """A diagram for people, so of few edges; lines in order of their edges."""
    head = edges.sparkSession.createDataFrame([("graph TD", -1)], "line string, edge_id long")
    head.unionByName(mermaid_lines(edges)).orderBy("edge_id").select("line").coalesce(1).write.mode("overwrite").text(path)


def sarif(findings: DataFrame, tool: str) -> DataFrame:
    """One JSON result per finding (rule_id, level, uri, line_no)."""
    location = F.array(F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_no").alias("startLine")).alias("region")).alias("physicalLocation")))
    return findings.select(F.to_json(F.struct(F.lit(tool).alias("tool"), F.col("rule_id").alias("ruleId"), "level", location.alias("locations"))).alias("value"))


def write_partitioned(df: DataFrame, path: str, key: str) -> None:
    """Replace only the partitions that ``df`` brings."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def diagram_lines(linked: DataFrame) -> DataFrame:
    """(diagram, line) of sequence, class and entity diagrams from (src_type, dst_type, edge_kind, a, b: labels)."""
    a, b = (F.regexp_replace(c, "[^A-Za-z0-9_]", "_") for c in ("a", "b"))
    k, pad = F.col("edge_kind"), F.lit("    ")
    both = lambda t: (F.col("src_type") == t) & (F.col("dst_type") == t)
    lines = [
        F.when(both("method"), F.struct(F.lit("sequence").alias("diagram"), F.concat(pad, a, F.lit("->>"), b, F.lit(": "), k).alias("line"))),
        F.when(k.isin("extends", "implements"), F.struct(F.lit("class").alias("diagram"), F.concat(pad, b, F.when(k == "extends", " <|-- ").otherwise(" <|.. "), a).alias("line"))),
        F.when(F.col("dst_type") == "table", F.struct(F.lit("erd").alias("diagram"), F.concat(pad, a, F.lit(" }o--|| "), b, F.lit(" : "), k).alias("line"))),
    ]
    return linked.select(F.inline(F.array_compact(F.array(*lines))))
