import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodegraph.functions import findings
from lodegraph.operators import chunks as C
from lodegraph.operators import graph as G
from lodegraph.operators import relational as R
from lodegraph.sources import scans

JAVA = """package a.b;
import c.D;

public class Shop {
    private int n;

    public int total(List<Item> items) {
        for (Item i : items) {
            n += i.price(); // }
        }
        return n;
    }

    private void log(String s) {
        System.out.println("{" + s);
    }

    static class Inner {
        void run() {
        }
    }
}
"""


def test_java_chunks_follow_braces():
    got = {(k, n): (a, b) for k, n, a, b in C.java_chunks(JAVA)}
    assert got == {("import", "imports"): (1, 3), ("class", "Shop"): (4, 22), ("method", "total"): (7, 12), ("method", "log"): (14, 16), ("class", "Inner"): (18, 21), ("method", "run"): (19, 20)}
    assert ("class", "A", 1, 2) in C.java_chunks("class A {\n  int x;")  # never closed: ends with the file
    assert C.java_chunks("") == []


def test_page_and_mapper_chunks():
    page = "<html>\n<% String q = \"SELECT 1\";\n%>\n<% int x = 1; %>"
    assert C.page_chunks(page) == [("scriptlet", "scriptlet_0", 2, 3)]
    assert C.page_chunks("x" * 1001) == [("page", "page", 1, 1)] and C.page_chunks("x") == []
    mapper = '<mapper>\n<select id="one">\nSELECT 1\n</select>\n<update id="two">U</update>\n</mapper>'
    assert C.mapper_chunks(mapper) == [("mapper_select", "one", 2, 4), ("mapper_update", "two", 5, 5)]


def test_structural_chunks_of_odd_rows(spark):
    rows = [(1, "a/Shop.java", JAVA, "x"), (2, None, "text", "x"), (3, "a.jsp", None, "x"), (4, "b.xml", "", "x")]
    df = spark.createDataFrame(rows, "file_id long, path string, content string, name string")
    got = C.structural(df, "file_id", "path", "content").collect()
    assert {r.file_id for r in got} == {1} and len(got) == 6
    assert C.size_chunks(df, "file_id", "content", 100).where("file_id = 4").count() == 1
    assert C.size_chunks(df, "file_id", "content", 100).where("file_id = 1").agg(F.sum("chars")).first()[0] == len(JAVA)
    assert C.structural(df.where("false"), "file_id", "path", "content").count() == 0


def test_includes_are_put_in():
    parts = {"cols": "a, <include refid='more'/>", "more": "b", "self": "x <include refid=\"self\"/>"}
    assert C.inline('SELECT <include refid="cols"/> FROM t', parts) == "SELECT a, b FROM t"
    assert C.inline('<include refid="none"/>', parts) == '<include refid="none"/>'
    assert C.inline('<include refid="self"/>', parts) == 'x <include refid="self"/>'


def test_scan_places_matches_over_lines(spark):
    page = 'a\n<%= x %>\n<script>\nvar a = <% y %>;\n</script>\n${z}\n<% String sql = "SELECT * FROM t WHERE a = " +\n id; %>'
    xml = "<mapper>\n<select id='q'>SELECT * FROM ${t}\n ORDER BY ${c}</select></mapper>"
    df = spark.createDataFrame([(1, "p.jsp", page), (2, "m.xml", xml), (3, "n.jsp", None), (4, None, page)], "file_id long, path string, content string")
    got = {(r.file_id, r.line_no, r.kind): (r.rule, r.severity, r.confidence) for r in findings.scan(df, "file_id", "content", "path").collect()}
    assert got[1, 2, "xss"] == (9, "high", 700) and got[1, 3, "xss"] == (11, "high", 700) and got[1, 6, "xss"] == (10, "medium", 700)
    assert got[1, 7, "sql_injection"][0] == 2
    assert got[2, 2, "sql_injection"] == (5, "critical", 950) and got[2, 3, "sql_injection"] == (5, "critical", 950)
    assert {k[0] for k in got} == {1, 2}


def test_overloads_and_tiers_by_minima(spark):
    c = spark.createDataFrame([(1, 1, 1, "run", "method", 9), (2, 1, 1, "run", "method", 9), (3, 1, 2, "run", "method", 8), (4, 2, 3, "run", "method", 7), (5, 1, 1, "go", "method", 9)], "component_id long, project_id long, file_id long, component_name string, component_type string, parent_component_id long")
    s = spark.createDataFrame([(1, "run", 2), (2, "run", 0), (3, "run", 1)], "file_id long, component_name string, params int")
    h = spark.createDataFrame([(1, "method", 5, '{"called_name": "run", "arg_count": 0}'), (2, "method", 5, '{"called_name": "none"}'), (3, "method", 4, '{"called_name": "run", "arg_count": 1}'), (4, "method", 5, "bad")], "hint_id long, src_type string, src_id long, hint string")
    assert {r.hint_id: (r.component_id, r.score) for r in R.best_overload(h, c, s).collect()} == {1: (3, 10), 3: (4, 10)}
    assert {r.hint_id: (r.target, r.tier) for r in R.resolve_calls(h, c).collect()} == {1: (1, 1), 3: (4, 1)}


def test_communities_by_modularity(spark):
    cliques = [[f"{g}{i}" for i in range(5)] for g in "abcd"]
    rows = [(a, b) for c in cliques for a in c for b in c if a < b] + [("a0", "b0"), ("b1", "c0"), ("c1", "d0"), ("d1", "a1"), ("x", None), ("a2", "a2")]
    e = spark.createDataFrame(rows, "src string, dst string")
    got = {r.node: r.community for r in G.modularity_communities(e).collect()}
    assert sorted(got) == sorted(n for c in cliques for n in c)
    assert all(len({got[n] for n in c}) == 1 for c in cliques) and len(set(got.values())) == 4
    assert G.modularity_communities(e.where("dst is null")).count() == 0


def test_settings():
    text = "# c\ninclude:\n  - \"**/*.java\"\n  - '**/*.xml' # all\n\nexclude:\n  - **/test/**\n"
    assert scans.read_settings(text) == {"include": ["**/*.java", "**/*.xml"], "exclude": ["**/test/**"]}
    with pytest.raises(ValueError):
        scans.read_settings("- x")


def test_directed_joins_and_inheritance(spark, tmp_path):
    from __spark_entry__ import queries

    sql = "CREATE TABLE T_A (a_id NUMBER, PRIMARY KEY (a_id));\nCREATE TABLE T_B (b_id NUMBER, a_id NUMBER, PRIMARY KEY (b_id));\nSELECT * FROM T_B b JOIN T_A a ON (b.a_id = a.a_id);"
    java = "package x;\npublic class Sub extends Base implements Face {\n}\n"
    contents = pd.DataFrame({"file_id": [1, 2, 3, 4], "content": [sql, java, '<%@ include file="../inc/top.jsp" %>', ""]})
    files = pd.DataFrame({"file_id": [1, 2, 3, 4], "project_id": [1] * 4, "path": ["p/a.sql", "p/Sub.java", "p/web/a.jsp", "p/web/inc/top.jsp"], "language": [None] * 4, "loc": [1] * 4, "hash": [None] * 4}).astype({"language": "string", "hash": "string"})
    comps = pd.DataFrame({"component_id": [1, 2, 3], "project_id": [1] * 3, "file_id": [2, 9, 8], "component_name": ["Sub", "Base", "Face"], "component_type": ["class", "class", "interface"], "parent_component_id": pd.array([None] * 3, dtype="Int64"), "line_start": [1] * 3, "line_end": [2] * 3, "hash_value": ["h"] * 3})
    for name, df in (("file_contents", contents), ("files", files), ("components", comps)):
        df.to_parquet(tmp_path / f"{name}.parquet")
    q, d = queries(), str(tmp_path)
    assert [tuple(r) for r in q["ref_g12_erd_directed_edges"](spark, d).collect()] == [("T_A", "T_B", 1, 80)]
    assert {tuple(r) for r in q["ref_g13_inheritance"](spark, d).collect()} == {(1, 2, "extends"), (1, 3, "implements")}
    assert [tuple(r) for r in q["ref_g18_page_includes"](spark, d).collect()] == [(3, "../inc/top.jsp", 4)]
