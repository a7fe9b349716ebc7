import random

import pytest

from lodegraph.operators import hierarchy as H


def brute(rows):
    parent = {}
    for i, p in rows:
        if i is None:
            continue
        old = parent.get(i)
        parent[i] = p if old is None else (old if p is None else max(old, p))
    out = {}
    for i in parent:
        seen, at = [i], parent[i]
        while at is not None and at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at is None:
            out[i] = ("ok", tuple(reversed(seen)))
        elif at not in parent:
            out[i] = ("broken", tuple(reversed(seen)))
        else:
            out[i] = ("loop" if at == i else "under_loop", None)
    return out


def solve(spark, rows, bits, cols="id long, up long, id2 string"):
    df = spark.createDataFrame([(i, p, "x") for i, p in rows], cols)
    h = H.resolve(df, "id", "up", bits)
    return {r.id: (r.state, tuple(r.path) if r.path else None) for r in h.paths().collect()}, h


def forest(seed, n, loops=True):
    rnd = random.Random(seed)
    ids = rnd.sample(range(-50, 40 * n), n)
    rows = []
    for k, i in enumerate(ids):
        u = rnd.random()
        if u < 0.1 or k == 0:
            rows.append((i, None))
        elif u < 0.13:
            rows.append((i, 10**9 + i))
        elif u < 0.2 and loops:
            rows.append((i, rnd.choice(ids)))
        else:
            rows.append((i, ids[max(0, k - 1 - int(rnd.random() * 3))]))
    return rows + rows[:5] + [(None, 3)]


@pytest.mark.parametrize("seed,bits", [(1, 3), (2, 6), (3, 20)])
def test_random_forests(spark, seed, bits):
    rows = forest(seed, 300)
    got, h = solve(spark, rows, bits)
    assert got == brute(rows)
    check_numbers(h, got)


def check_numbers(h, got):
    below = {}
    for state, path in got.values():
        for i in (path or ())[:-1]:
            below[i] = below.get(i, 0) + 1
    for r in h.summary().collect():
        state, path = got[r.id]
        assert (r.state, r.depth, r.root_id) == (state, len(path) - 1 if path else None, path[0] if state == "ok" else None)
        assert r.n_descendants == (below.get(r.id, 0) if path else None)


def test_many_levels_and_doubling(spark, monkeypatch):
    rows = forest(7, 250)
    monkeypatch.setattr(H, "BLOCK_ROWS", 40)
    monkeypatch.setattr(H, "PATH_IDS", 50)
    got, h = solve(spark, rows, 8)
    assert got == brute(rows)
    check_numbers(h, got)


def test_cycle_across_blocks_with_branches(spark):
    rows = [(1, 100), (2, 1), (100, 200), (101, 100), (200, 2), (201, 200), (202, 201), (3, 3), (4, 3), (300, None), (301, 300)]
    got, h = solve(spark, rows, 4)
    assert got == brute(rows)
    below = {(r.id, r.descendant_id, r.distance) for r in h.descendants().collect()}
    assert below == {(300, 301, 1)}
    top = {r.id: (r.depth, r.root_id, r.n_descendants) for r in h.paths().collect()}
    assert top[300] == (0, 300, 1) and top[301] == (1, 300, 0) and top[1] == (None, None, None)


def test_deep_chain_and_empty(spark):
    rows = [(i, i - 1 if i else None) for i in range(700)]
    got, h = solve(spark, rows, 5)
    check_numbers(h, got)
    assert got[699][0] == "ok" and len(got[699][1]) == 700
    assert solve(spark, [], 5)[0] == {}


@pytest.mark.parametrize("shuffled", [False, True])
def test_chain_longer_than_any_block_in_little_memory(shuffled):
    """One block of a chain takes memory by its nodes, not by their paths."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    n = 1 << 17
    ids = np.arange(n)
    order = np.random.default_rng(3).permutation(n) if shuffled else ids
    pdf = pd.DataFrame({"id": order, "parent": pd.Series(np.concatenate([[0], order[:-1]]), dtype="Int64").mask(np.arange(n) == 0), "w": 1})
    tracemalloc.start()
    out = H._contract_block(pdf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["dist"].max() == n - 1 and out["exit"].isna().all() and peak < 300 * n
