import random

import pytest

import __spark_entry__ as entry
from lodegraph.operators import graph as G


def frame(spark, links):
    return spark.createDataFrame([(i, "k", a, b, 0.5) for i, (a, b) in enumerate(links)], "edge_id long, edge_kind string, src string, dst string, confidence double")


def rand(seed, n=60, m=110):
    rnd = random.Random(seed)
    return [(f"n{rnd.randrange(n):02d}", None if rnd.random() < 0.1 else f"n{rnd.randrange(n):02d}") for _ in range(m)]


def bfs(start, links, depth):
    seen, front = {start: 0}, [start]
    for d in range(1, depth + 1):
        front = sorted({b for a, b in links if a in front and b not in seen})
        seen.update(dict.fromkeys(front, d))
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_and_trace(spark, seed):
    links = rand(seed)
    e = frame(spark, links)
    pairs = [(a, b) for a, b in links if b]
    start = spark.createDataFrame([(links[0][0],)], "node string")
    got = {r.node: r.depth for r in G.reach(start, e.where("dst is not null").select("src", "dst"), 3).collect()}
    assert got == bfs(links[0][0], pairs, 3)
    visited = bfs(links[0][0], pairs, 2)
    rows = {(r.edge_id, r.depth, r.src, r.dst) for r in G.trace(e, start, 3).collect()}
    assert rows == {(i, visited[a], a, b or f"unresolved:{i}") for i, (a, b) in enumerate(links) if a in visited}
    assert len(G.trace(e, start, 3, unresolved=False).collect()) == sum(1 for a, b in links if a in visited and b)
    both = pairs + [(b, a) for a, b in pairs]
    near = bfs(links[0][0], both, 2)
    assert {r.edge_id for r in G.focus(e, start, 2).collect()} == {i for i, (a, b) in enumerate(links) if b and a in near and b in near}


@pytest.mark.parametrize("seed", [3, 4])
def test_components(spark, seed):
    links = [(a, b) for a, b in rand(seed, 80, 50)] + [("hub", f"x{i}") for i in range(40)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in G.components(frame(spark, links)).collect()}
    low = {}
    for n in parent:
        low.setdefault(find(n), []).append(n)
    assert got == {n: min(g) for g in low.values() for n in g}


def test_levels_and_cycles(spark):
    links = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z"), ("q", "q"), ("q", "r")]
    e = frame(spark, links)
    assert {r.node: r.level for r in G.topological_levels(e).collect()} == {"a": 0, "b": 1, "c": 2, "x": -1, "y": -1, "z": -1, "q": 0, "r": 1}
    assert [(r.node1, r.node2) for r in G.mutual(e).collect()] == [("x", "y")]
    labels = {r.node: r.label for r in G.label_propagation(frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("p", "q"), ("q", "r"), ("r", "p")])).collect()}
    assert len({labels[n] for n in "abc"}) == 1 and len({labels[n] for n in "pqr"}) == 1 and labels["a"] != labels["p"]


def test_empty(spark):
    e = frame(spark, [])
    assert G.components(e).collect() == [] and G.topological_levels(e).collect() == [] and G.mutual(e).collect() == []


def test_chains_to_their_end(spark):
    links = rand(5) + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(21)] + [("c21", "c10")]
    pairs = [(a, b) for a, b in links if b]
    starts = ["c00", "c05", links[0][0]]
    frame_of = spark.createDataFrame([(s,) for s in starts], "node string")
    for depth in (None, 4):
        want = {s: (max(v.values()), len(v)) for s in starts for v in [bfs(s, pairs, depth or len(links))]}
        assert {r.start: (r.depth, r.nodes) for r in G.chain_depth(frame(spark, links), frame_of, depth).collect()} == want


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Edges of two kinds: calls in a chain of 12 methods, with files that join it."""
    d = str(tmp_path_factory.mktemp("store"))
    rows = [(i, 1, "METHOD", i, "method", i + 1, "call", 0.5, None, None) for i in range(11)]
    rows += [(20, 1, "file", 1, "method", 0, "import", 0.5, None, None), (21, 1, "class", 7, "class", 8, "implements", 0.5, None, None), (22, 1, "class", 9, None, None, "extends", 0.5, None, None)]
    columns = "edge_id long, project_id long, src_type string, src_id long, dst_type string, dst_id long, edge_kind string, confidence double, meta string, created_at timestamp"
    spark.createDataFrame(rows + rows[:2], columns).write.parquet(f"{d}/edges.parquet")
    return d


def test_full_chain_depth_query(spark, store):
    got = {r.start: (r.depth, r.nodes) for r in entry.queries()["ref_g6_full_chain_depth"](spark, store).collect()}
    assert got == {f"method:{i}": (11 - i, 12 - i) for i in range(11)}


def test_components_and_communities_take_all_edges(spark, store):
    nodes = {f"method:{i}" for i in range(12)} | {"file:1", "class:7", "class:8"}
    got = {r.node: r.component for r in entry.queries()["ref_g9_all_components"](spark, store).collect()}
    assert got == {n: "class:7" if n.startswith("class") else "file:1" for n in nodes}
    labels = {r.node: r.label for r in entry.queries()["ref_g9_communities"](spark, store).collect()}
    assert set(labels) == nodes and {labels[n] for n in ("class:7", "class:8")} <= {"class:7", "class:8"}


def test_levels_of_a_long_chain(spark):
    links = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(64)] + [("x", "y"), ("y", "x"), ("c03", "x")]
    got = {r.node: r.level for r in G.topological_levels(frame(spark, links)).collect()}
    assert got == {f"c{i:02d}": i for i in range(65)} | {"x": -1, "y": -1}
