import pytest

from lodegraph.llm import parsing as P
from lodegraph.llm.syntax.chart import Recogniser

VALID = {
    "java": [
        "package a.b;\nimport static x.Y.*;\n@Svc(name = \"x\", v = {1, 2})\npublic abstract class A<T extends B & C> extends D<T> implements E {\n  private Map<String, List<? extends T>> m = new HashMap<>();\n  static { x = 1; }\n  A() { super(); this.y = 2; }\n  <R> R f(final int a, String... b) throws E, F { for (int i = 0, j = 1; i < 3; i++) { if (a > b) continue; else break; } return (R) g(a -> { return a; }, A::new).h()[0]; }\n}",
        "enum K { A(1) { int f() { return 2; } }, B(2); private final int v; K(int v) { this.v = v; } }",
        "record P(int x, int y) { P { if (x < 0) throw new X(\"<<<<<<<\"); } }",
        "class S { int f(Object o) { return switch (o) { case 1 -> 2; case 3, 4 -> { yield 5; } default -> throw new X(); }; } }",
        "class T { void f() { try (var a = b(); c) { } catch (E | F e) { } finally { } do { x >>>= 2; } while (x > 1); synchronized (this) { } int[][] q = new int[3][]; lbl: while (true) break lbl; } }",
        "class U { String t = \"\"\"\n  { text \"x\" \n\"\"\"; char c = '\\''; int n = 0x1F + 1_000; /* { */ // }\n}",
        "",
    ],
    "javascript": [
        "'use strict'\nconst a = async ({ id, ...rest }, [b = 1]) => { await f(`x${id + `y${b}`}`) }\nlet r = /[/]\\//g.test(a) ? b : c\nexport default class extends B { static #x = 1; get v() { return this.#x } }\n",
        "!function(){var d=1;window.x=d}();x=(a)=>a?.b??1;for(var i=0;i<3;i++)if(a[i].b)return1();",
        "import d, { e as f } from 'g';\nswitch (x) { case 1: y(); break; default: z() }\nif (a) b(); else if (c) { d() } else e()\nfor (const [k, v] of m) { }\nlabel: while (1) { continue label }",
    ],
    "json": ['{"a": [1, -2.5e3, null, {"b": "\\u00e9"}]}', "[]"],
    "xml": ['<?xml version="1.0"?>\n<!-- a -->\n<a x="1"><b/>t &amp; &#38;<![CDATA[ <x ]]></a>\n'],
    "sql": [
        "SELECT a.x, COUNT(*) AS n FROM t a LEFT JOIN u b ON (a.i = b.i) WHERE a.y IN ('A', 'it''s') AND b.z IS NOT NULL GROUP BY a.x HAVING COUNT(*) > 1 ORDER BY 1 DESC;\n-- c\nCOMMENT ON COLUMN t.x IS 'open (';",
        "CREATE TABLE t (id NUMBER(12) NOT NULL, d DATE DEFAULT SYSDATE, CONSTRAINT pk PRIMARY KEY (id));\nMERGE INTO t USING u ON (t.i = u.i) WHEN MATCHED THEN UPDATE SET t.a = u.a WHEN NOT MATCHED THEN INSERT (a) VALUES (1);\nCREATE USER x IDENTIFIED BY \"p\";",
        "BEGIN\n  x := 1;\n  IF x > 1 THEN\n    UPDATE t SET a = NVL(b, 2) WHERE c < TO_DATE('2024', 'YYYY');\n  END IF;\nEND;\n/\n",
    ],
    "python": ["import a.b as c\nfrom . import (d,\n  e)\n@f(1)\nclass G(H, metaclass=I):\n    x: int = 1\n    def j(self, *a, k=1, **kw) -> None:\n        '''doc'''\n        for i, (m, n) in enumerate(x):\n            yield [q for q in r if q], {**s, 't': u[1:2]}, lambda: 0\n        try:\n            pass\n        except (A, B) as e:\n            raise X('%r' % (e,)) from e\n        else: y = 1 if z else 2\n"],
    "css": ["/* } */\n@media (max-width: 3px) { .a-b > c:hover, #d[e=f]::before { color: #fff; margin: 0 2px !important } }\n@import url(x.css);\n"],
    "yaml": ["# c\na:\n  b: 'x: y'\n  c:\n    - d: 1\n      e: [1, {f: 2}]\n    - g\n  k: |\n    raw: text\n     more\nl: \"m\"\n"],
    "properties": ["a=b\n# c\n<<<<<<< key\nd : \\u00e9\n"],
    "jsp": ['<%@ page language="java" %>\n<% for (int i = 0; i < 3; i++) { %><li><%= x.get(i) %></li><% } %>\n<c:if test="${a > b}"><p></c:if>\n<%-- <% --%><p>don\'t'],
}
INVALID = {
    "java": ["class A { void f() { g(; } }", "class A { void f() { throw now X(); } }", "class A { int x = 1;", "class A {\n<<<<<<< HEAD\n int a;\n}", "class A { String s = \"open; }", "/* open", "}", "class A { void f() { try { } } }", "import a\nclass B { }", "def f(): pass"],
    "javascript": ["function f( { }", "const a = ;", "x = [1, 2", "a b", "package a.b;", "'open", "if (a { }", "=======\n", "let t = `open"],
    "json": ['{"a": 1,}', "{'a': 1}", "", '{"a" 1}', "[1] 2"],
    "xml": ["<a><b></a>", "<a>", "text", "<a/><b/>", "<a>&x</a>", ""],
    "sql": ["SELECT a FROM t WHERE;", "INSERT INTO t (a VALUES (1);", "SELECT a FROM t LEFT JOIN u ON", "COMMENT ON COLUMN t.x IS 'open", "{\"a\": 1}", "DELETE FROM;", "import csv"],
    "python": ["def f(:\n  pass", "if x:\ny = 1", "x = (1,\n", "a b", "<?xml version='1.0'?>"],
    "css": [".a { color: red;", ".a } ", "function f(x) { return 1; }", ".a { b c }", "<<<<<<< HEAD\n.a { }"],
    "yaml": ["a:\n  b: 1\n c: 2\n", "a: 'open\nb: 1\n", "a: [1, 2\n", "a:\n=======\n  b: 1\n"],
    "properties": ["a=\\u12"],
    "jsp": ["<% for (;;) { %>", "<%= a", "<c:if test='x'>", "<% int x = %>"],
}


@pytest.mark.parametrize("language", sorted(VALID))
def test_valid(language):
    for text in VALID[language]:
        assert P.first_error(text, language) is None, text
        if language not in ("python", "yaml") and text:
            assert P.first_error(text.replace("\n", "\r\n"), language) is None, text


@pytest.mark.parametrize("language", sorted(INVALID))
def test_invalid(language):
    for text in INVALID[language]:
        assert P.first_error(text, language) is not None, text


def test_chart_against_brute_force():
    r = Recogniser("s : 'a' s 'b' | 'c'? | s s ;")
    seen = {""}
    for _ in range(4):
        seen |= {"a" + x + "b" for x in seen if len(x) < 5} | {"c"} | {x + y for x in seen for y in seen if len(x + y) < 7}
    import itertools

    for n in range(6):
        for w in itertools.product("abc", repeat=n):
            assert (r.parse("s", w) < 0) == ("".join(w) in seen), w


def test_rows(spark):
    rows = [(1, "class A { }"), (2, "class A {"), (3, None), (4, ""), (5, "x"), (6, '{"a": 1}'), (7, "a" * 100_000), (2, "class A {")]
    contents = spark.createDataFrame(rows, "file_id long, content string")
    info = [(1, "a.java", "JAVA", 1), (2, "b.txt", "Java", 1), (3, "c.java", None, 1), (4, "d.js", None, 2), (5, "e.unknown", None, 2), (6, "f.json", "", 2), (7, "g.py", "py", None)]
    files = spark.createDataFrame(info, "file_id long, path string, language string, project_id long")
    got = {r.file_id: (r.valid, r.checked, r.error_line) for r in P.parse_files(contents, files).collect()}
    assert got == {1: (True, True, None), 2: (False, True, 1), 4: (True, True, None), 5: (True, False, None), 6: (True, True, None), 7: (True, True, None)}
    rates = {(r.project_id, r.language): (r.files, r.invalid) for r in P.error_rates(P.parse_files(contents, files)).collect()}
    assert rates[(1, "java")] == (2, 1)
    assert P.parse_files(contents.where("false"), files).collect() == []


@pytest.mark.parametrize(("language", "around"), [("javascript", "%s"), ("java", "class A { void f() { %s } }")])
def test_wrong_cuts_before_long_rests(language, around):
    rest = "a = b(c);\n" * 1500  # 6 symbols each
    for start, valid in [("do x(); while (y);\n", True), ("do do x(); while (y); while (z);\n", True), ("do if (q) x(); else z(); while (y);\n", True), ("do x(); y();\n", False), ("do x();\n", False)]:
        for n in (0, 1, 1500):
            text = around % (rest[: 10 * n] + start + rest[: 10 * n])
            assert (P.first_error(text, language) is None) == valid, (start, n)
    text = around % ("do x(); while (y);\n" + rest + "a = = b;\n" + rest)
    assert P.first_error(text, language) is not None


BAD = {
    "sql": [
        "CREATE OR REPLACE PROCEDURE p IS BEGIN UPDATE t SET a = 1; IF x > 1 THEN y := 2;", "BEGIN x := 1;", "END; END;", "BEGIN LOOP x := 1; END IF; END;", "CREATE SEQUENCE s = = = ;", "ALTER SYSTEM = , . = ,;",
        "BEGIN IF a THEN b; END LOOP; END;", "DECLARE x NUMBER BEGIN NULL; END;", "BEGIN NULL END;", "CREATE OR REPLACE PACKAGE b AS PROCEDURE p(; END;",
    ],
    "yaml": ["a: {x: 1, , y}\n", "a: *nope\n", "a: [1, 2\n"],
    "jsp": ["<c:if test='${'a'>x</c:if>", "<p>${a +}</p>", '<c:if test="${empty a.b and}">x</c:if>'],
    "javascript": ["return 5;", "if (a) { return 1; }", "var f = 1; { return f }"],
}
PACKAGE = """CREATE OR REPLACE PACKAGE BODY emp_pkg AS
  g_count NUMBER(10) := 0;
  TYPE t_rec IS RECORD (id NUMBER, name VARCHAR2(30));
  TYPE t_tab IS TABLE OF emp%ROWTYPE INDEX BY PLS_INTEGER;
  e_bad EXCEPTION;
  PRAGMA EXCEPTION_INIT(e_bad, -20001);
  CURSOR c_emp (p_dept NUMBER) IS SELECT id, name FROM emp WHERE dept = p_dept ORDER BY id;
  FUNCTION total(p_id IN NUMBER, p_x IN OUT NOCOPY VARCHAR2, p_d DATE DEFAULT SYSDATE) RETURN NUMBER IS
    v_sum emp.sal%TYPE;
  BEGIN
    SELECT SUM(sal) INTO v_sum FROM emp WHERE id = p_id;
    IF v_sum IS NULL THEN RETURN 0; ELSIF v_sum > 100 THEN v_sum := v_sum * 2; ELSE NULL; END IF;
    FOR r IN c_emp(10) LOOP
      CASE r.id WHEN 1 THEN log_it('a'); ELSE log_it('b'); END CASE;
    END LOOP;
    FOR i IN REVERSE 1 .. 10 LOOP EXIT WHEN i = 3; CONTINUE; END LOOP;
    WHILE v_sum > 0 LOOP v_sum := v_sum - 1; END LOOP;
    <<outer>>
    LOOP EXIT outer WHEN v_sum < 0; END LOOP outer;
    EXECUTE IMMEDIATE 'delete from t where id = :1' USING p_id;
    OPEN c_emp(1); FETCH c_emp BULK COLLECT INTO a LIMIT 100; CLOSE c_emp;
    FORALL i IN 1 .. a.COUNT SAVE EXCEPTIONS UPDATE emp SET sal = a(i) WHERE id = b(i);
    DECLARE x NUMBER; BEGIN x := CASE WHEN a = 1 THEN 2 ELSE 3 END; END;
    RETURN v_sum;
  EXCEPTION
    WHEN NO_DATA_FOUND THEN RETURN NULL;
    WHEN e_bad OR TOO_MANY_ROWS THEN ROLLBACK; RAISE;
    WHEN OTHERS THEN raise_application_error(-20002, SQLERRM);
  END total;
  PROCEDURE init IS BEGIN NULL; END;
BEGIN
  init;
END emp_pkg;
/
SELECT 1 FROM dual;
"""
GOOD = {
    "sql": [
        PACKAGE, PACKAGE * 3, "CREATE OR REPLACE TRIGGER trg BEFORE INSERT OR UPDATE OF a, b ON emp FOR EACH ROW WHEN (new.id > 1) BEGIN :new.id := seq.NEXTVAL; END;\n/\n", "CREATE SEQUENCE s START WITH 1 INCREMENT BY 1 NOCACHE;",
        "ALTER SYSTEM SET open_cursors = 300;", "CREATE TYPE t AS OBJECT (a NUMBER, b VARCHAR2(3));", "GRANT SELECT, INSERT ON a.b TO c, d;", "BEGIN NULL; END;\n/\nBEGIN p(1, b => 2); END;\n/",
    ],
    "yaml": ['a: {x: 1, y: [1, 2, {b: c d}], z: "q"}\n', "b: &x 1\na: *x\n", "a: [1,\n  2, 'x: y']\nb: {}\nc: [http://a/b?c=1, x]\n", "on: [push, pull_request]\n"],
    "jsp": ['<c:if test="${not empty user and user.age >= 18 ? true : false}">x</c:if>', "<p>${a['b'].c + fn:length(x)}</p>", "<c:out value='${item[\"x\"]}'/>"],
    "javascript": ["function f(){ if (a) { return 1; } return; }", "const g = (a) => { return a; };", "class A { get x() { return 1; } static async m(a) { for (const b of c) { return b; } } }", "(function(){ return 1 })();"],
}


@pytest.mark.parametrize("language", sorted(BAD))
def test_what_only_a_nested_grammar_sees(language):
    for text in BAD[language]:
        assert P.first_error(text, language) is not None, text
    for text in GOOD[language]:
        assert P.first_error(text, language) is None, text
    cut = PACKAGE[: PACKAGE.index("EXCEPTION\n    WHEN")]
    assert P.first_error(cut, "sql") is not None
