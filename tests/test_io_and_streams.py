import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import dml as D
from lodegraph.operators import extract as X
from lodegraph.sources import scans, sinks
from lodegraph.streaming import monitor


@pytest.fixture
def edges(spark):
    rows = [(1, "file", 1, "file", 2, "include", 0.9, "{}"), (2, "class", 3, "table", None, "use", 0.2, None), (3, "class", 3, "class", 4, "extends", 0.1, "x" * 900)]
    return spark.createDataFrame(rows, "edge_id long, src_type string, src_id long, dst_type string, dst_id long, edge_kind string, confidence double, meta string")


def test_exports(spark, edges, tmp_path):
    rows = sinks.edge_rows(edges, 0.5, ["extends"])
    assert {r.id for r in rows.collect()} == {1, 3}
    nodes = spark.createDataFrame([("file", 1, "a\"b,c", 7, None)], "node_type string, node_id long, label string, file_id long, project_id long")
    sinks.write_csv_graph(sinks.node_rows(nodes), rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv/edges"))
    assert back.count() == 2 and back.columns == ["id", "source", "target", "kind", "confidence"]
    sinks.write_json_graph(sinks.node_rows(nodes), rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/nodes")).first().label == 'a"b,c'
    sinks.write_mermaid(edges.where("dst_id is not null"), str(tmp_path / "m"))
    text = [r.value for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert text[0] == "graph TD" and "    file_1 -->|include| file_2" in text
    finding = spark.createDataFrame([("xss", "warning", "a.jsp", 3)], "rule_id string, level string, uri string, line_no int")
    assert json.loads(sinks.sarif(finding, "t").first().value)["locations"][0]["physicalLocation"]["region"]["startLine"] == 3
    parts = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.write_partitioned(parts, str(tmp_path / "p"), "k")
    sinks.write_partitioned(parts.where("k = 2").withColumn("v", F.lit("c")), str(tmp_path / "p"), "k")
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(1, "a"), (2, "c")}


def test_scans(spark, tmp_path):
    root = tmp_path / "src"
    (root / "a/target").mkdir(parents=True)
    (root / "a/X.java").write_text("class X { } // ü")
    (root / "a/target/Y.java").write_text("class Y { }")
    (root / "a/z.txt").write_text("z")
    with zipfile.ZipFile(root / "l.jar", "w") as z:
        z.writestr("p/Q.class", b"123")
    got = scans.whole_texts(spark, str(root), ["**/*.java"], ["**/target/"]).collect()
    assert [r.content for r in got] == ["class X { } // ü"]
    jars = scans.source_tree(spark, str(root), ["**/*.jar"], [])
    assert [(r.class_name, r.size) for r in scans.archive_classes(jars).collect()] == [("p.Q", 3)]
    (tmp_path / "ALL_TABLES.csv").write_bytes("﻿owner,table_name,comments,more\n app ,t_x,\"a, \"\"b\"\"\",1\n".encode())
    rows = scans.schema_csv(spark, str(tmp_path / "ALL_TABLES.csv")).collect()
    assert [(r.OWNER, r.TABLE_NAME, r.COMMENTS) for r in rows] == [("APP", "T_X", 'a, "b"')]
    (tmp_path / "OTHER.csv").write_text("a,b\n1,2\n")
    assert scans.schema_csv(spark, str(tmp_path / "OTHER.csv")).count() == 0
    assert scans.check_columns(["owner"], "PK_INFO") == (False, ["TABLE_NAME", "COLUMN_NAME", "POSITION"], [])
    catalog = spark.createDataFrame([("APP", "T_X", None)], "owner string, table_name string, table_comment string")
    comments = spark.createDataFrame([(" app", "t_x ", "hi")], "OWNER string, TABLE_NAME string, COMMENTS string")
    assert scans.comment_csv(catalog, comments).first().table_comment == "hi"
    cols = spark.createDataFrame([("o", "u_id", "Y", "u", "id"), ("o", "x", "N", None, None), ("o", "g_id", "y", "gone", "id"), ("u", "id", "N", None, None)], "table_name string, column_name string, is_foreign_key string, foreign_table string, foreign_column string")
    tables, fk = scans.column_list_csv(cols)
    assert {(r.table_name, r.columns) for r in tables.collect()} == {("o", 3), ("u", 1)}
    assert {(r.foreign_table, r.dummy) for r in fk.collect()} == {("u", False), ("gone", True)}
    assert scans.filter_config({})[1] == []


def test_maintenance(spark, edges):
    known = edges.where("edge_id = 1")
    nodes = spark.createDataFrame([("class", 4)], "node_type string, node_id long")
    new = edges.withColumn("confidence", F.lit(0.5)).unionByName(edges.withColumn("confidence", F.lit(0.4)))
    out = D.upsert_edges(known, new, nodes).collect()
    assert [(r.dst_id, r.confidence, len(r.meta), r.dummy) for r in out] == [(4, 0.5, 500, False)]
    a = spark.createDataFrame([(1, "x"), (2, "y"), (4, None)], "k long, h string")
    b = spark.createDataFrame([(2, "z"), (3, "w"), (4, None)], "k long, h string")
    assert {(r.k, r.change) for r in D.changed_files(a, b, "k", "h").collect()} == {(1, "deleted"), (2, "modified"), (3, "added")}


def test_text_facts(spark):
    sql = "SELECT a.x FROM t1 a, (SELECT 1 FROM t9) q, t2 b WHERE a.id = b.t1_id AND a.n = 'x, y = z' -- c\n; SELECT * FROM t3 c LEFT JOIN t4 d ON c.i = d.i"
    df = spark.createDataFrame([(1, sql), (2, None), (3, "")], "k long, t string")
    assert [(r.l_table, r.l_col, r.r_table, r.r_col) for r in X.implicit_joins(df, "k", "t").collect()] == [("T1", "id", "T2", "t1_id")]
    got = {(r.statement_no, r.alias, r.table_name) for r in X.alias_map(df, "k", "t").collect()}
    assert {(0, "A", "T1"), (0, "B", "T2"), (1, "C", "T3"), (1, "D", "T4")} <= got
    lines = spark.createDataFrame([(1, "a\nb hit\nc\nd\nhit"), (2, None)], "k long, t string")
    assert [(r.line_no, r.line) for r in X.context(lines, "k", "t", "hit", 1).collect()] == [(1, "a"), (2, "b hit"), (3, "c")]
    assert [(r.chunk, r.lines) for r in X.line_chunks(lines, "k", "t", 2).orderBy("chunk").collect()] == [(0, 2), (1, 2), (2, 1)]


def test_streaming_upsert(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k long, v string, at long").write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema

    def run():
        stream = spark.readStream.schema(schema).parquet(src)
        q = monitor.upsert_stream(stream, str(tmp_path / "out"), ["k"], "at", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    spark.createDataFrame([(2, "d", 5), (3, "e", 1)], "k long, v string, at long").write.mode("append").parquet(src)
    run()
    got = {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out/v=1")).collect()}
    assert got == {(1, "b"), (2, "d"), (3, "e")}
