import hashlib
import random

import numpy as np

from lodegraph.llm import provenance as P

WORDS = "amber birch cedar delta ember flint grove haven inlet jetty knoll ledge marsh north ocean plume quill ridge stone thorn".split()


def bean(rnd, head):
    name = rnd.choice(WORDS).title()
    body = "".join(
        f"    private {t} {f}_;\n    public {t} get{f.title()}() {{ return {f}_; }}\n    public {name} set{f.title()}({t} value) {{ {f}_ = value; return this; }}\n"
        for f in rnd.sample(WORDS, rnd.randrange(4, 12))
        for t in [rnd.choice(["int", "long", "String"])]
    )
    return f"{head}package a.{name};\n\npublic final class {name} {{\n{body}}}\n"


def hand(rnd):
    out = [f"package b.{rnd.choice(WORDS)};\n\npublic class {rnd.choice(WORDS).title()}{rnd.randrange(999)} {{\n"]
    for _ in range(rnd.randrange(2, 6)):
        a, b, c = rnd.sample(WORDS, 3)
        out.append(
            rnd.choice(
                [
                    f"    void {a}(int {b}) {{\n        if ({b} > {rnd.randrange(99)}) {{\n            log.warn(\"{c} {a}\", {b});\n        }}\n    }}\n",
                    f"    int {a}() {{\n        for (Item {b} : {c}List) {{\n            total += {b}.get{a.title()}({rnd.randrange(99)});\n        }}\n        return total;\n    }}\n",
                    f"    // files generated by the {a} export\n    String {b} = map.get(\"{c}\") + {rnd.randrange(99)};\n",
                    f"    try {{\n        {a}Dao.save({b}, {rnd.randrange(99)});\n    }} catch (Error e) {{ throw new {c.title()}(e); }}\n",
                ]
            )
        )
    return "".join(out) + "}\n"


def fixture():
    rnd = random.Random(11)
    rows, want = [], {}
    for i in range(60):
        marked = i % 4 != 0
        rows.append((i, bean(rnd, "// Code generated by loom 1. DO NOT EDIT.\n" if marked else ""), f"src/B{i}.java", i % 7))
        want[i] = "generated"
    for i in range(100, 220):
        rows.append((i, hand(rnd), f"src/H{i}.java", i % 9))
    lib = "".join(hand(rnd) for _ in range(4))
    for k, i in enumerate(range(300, 306)):
        text = lib if k == 0 else lib.replace(rnd.choice(WORDS), "changed") if k % 2 else "// renamed\n" + lib
        rows.append((i, text, f"vendor/x{i}.java", k))
        want[i] = "third_party"
    rows.append((400, ";".join(f"function {a}(b){{return b>{n}?b-{n}:b*{n}}}" for n, a in enumerate(WORDS * 4)), "js/app.js", 1))
    want[400] = "minified"
    rows.append((401, "K = [\n" + "".join(f"    0x{rnd.randrange(256):02x}, 0x{rnd.randrange(256):02x},\n" for _ in range(200)) + "]\n", "tools/k.py", 1))
    want[401] = "data"
    rows.append((402, 'class R { String RAW = "' + "".join(rnd.choice("ABCDEFabcdef0123456789+/") for _ in range(3000)) + '"; }', "R.java", 1))
    want[402] = "data"
    rows += [(500, None, "a.java", 1), (501, "", "b.java", 1), (502, '{"a": [' + "1, " * 300 + "1]}", "c.json", 1), (503, "x", None, None)]
    return rows, want, lib


def test_kinds(spark):
    rows, want, lib = fixture()
    contents = spark.createDataFrame([(i, t, "z") for i, t, _, _ in rows + rows[:9]], "file_id long, content string, project_id string")
    files = spark.createDataFrame([(i, p, j) for i, _, p, j in rows], "file_id long, path string, project_id long")
    library = spark.createDataFrame([(1, hashlib.sha256(lib.encode()).hexdigest()), (2, None)], "lib_file_id long, sha256 string")
    got = {r.file_id: r for r in P.provenance(contents, files, library).collect()}
    for i, kind in want.items():
        assert got[i][kind], (i, kind)
    flagged = {r.file_id for r in P.found(contents, files, library).collect()}
    assert flagged == set(want)
    assert P.found(contents.where("false"), files, library).collect() == []


def test_rules_do_not_depend_on_the_batch():
    rnd = np.random.default_rng(3)
    a = rnd.integers(0, 9, 500).astype(np.uint64)
    b = rnd.integers(0, 9, 300).astype(np.uint64)
    for by_count in (True, False):
        alone = P.re_pair(a, np.zeros(500, dtype=np.int64), 8, by_count)
        both = P.re_pair(np.concatenate([b, a]), np.repeat([0, 1], [300, 500]), 8, by_count)
        assert sorted(alone[1].tolist()) == sorted(both[1][both[0] == 1].tolist())


def test_equal_stretches_give_equal_rules():
    rnd = np.random.default_rng(4)
    core = rnd.integers(0, 1000, 400).astype(np.uint64)
    x = np.concatenate([rnd.integers(0, 1000, 37).astype(np.uint64), core])
    y = np.concatenate([core, rnd.integers(0, 1000, 90).astype(np.uint64)])
    one = P.re_pair(x, np.zeros(len(x), dtype=np.int64), 24, False)
    two = P.re_pair(y, np.zeros(len(y), dtype=np.int64), 24, False)
    shared = set(one[1].tolist()) & set(two[1].tolist())
    assert sum(w for n, w in zip(one[1].tolist(), one[2].tolist()) if n in shared) > 250


def test_markers_behind_long_banners():
    banner = "/*\n" + " * All rights reserved.\n" * 200 + " */\n"
    code, mark = "package a;\n" + "import b.C;\n" * 400 + "class A {\n", "// Code generated by loom 1. DO NOT EDIT.\n"

    def said(text, ext="java"):
        got = P.describe(text, ext, P.Lexicon())[0]
        return got[6], got[7]  # marked, headed

    assert said(banner + mark + code) == (True, True)
    assert said(banner[:-4] + " * Generated by loom\n */\n" + code) == (True, True)
    assert said("<?xml version='1.0'?>\n<!--" + "x " * 2000 + "\nDo not edit -->\n<a/>", "xml") == (True, True)
    assert said(code + mark + "}") == (True, False)
    assert said(code + "@javax.Generated(\"x\")\nvoid f() { } }") == (True, False)
    assert said(code + 'String s = "' + mark.strip() + '"; int n; // generated by the database\n}') == (False, False)


def test_long_files_stay_whole(monkeypatch):
    parts = [np.arange(50, dtype=np.uint64), np.arange(500, dtype=np.uint64), np.arange(30, dtype=np.uint64), np.zeros(0, dtype=np.uint64)]
    monkeypatch.setattr(P, "BATCH_TOKENS", 100)
    got = [(len(s), sorted(set(o.tolist()))) for s, o in P._segments(parts)]
    assert got == [(50, [0]), (500, [1]), (30, [2])]
