import datetime as dt
import random

from lodegraph.operators import references as R

T0 = dt.datetime(2024, 1, 1)


def day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def run(spark, refs, nodes, gone):
    r = spark.createDataFrame(refs, "eid long, t string, k long, created_at timestamp, id long")
    n = spark.createDataFrame(nodes, "t string, key long, loaded timestamp, id string")
    g = spark.createDataFrame(gone, "t string, key long")
    out = R.orphan_references([R.Reference("e", r, "eid", "t", "k", "k")], R.records([(n, None, "key", "t", "loaded")]), R.records([(g, None, "key", "t", None)]))
    rows = [(x.ref_id, x.state) for x in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def brute(refs, nodes, gone):
    first, log = {}, {(t.lower(), k) for t, k in gone}
    for t, k, at, _ in nodes:
        if k is not None:
            old = first.setdefault((t.lower(), k), at)
            first[t.lower(), k] = min([x for x in (old, at) if x], default=None)
    out = set()
    for e, t, k, at, _ in refs:
        if k is None:
            continue
        key = ((t or "").lower(), k)
        if key in first:
            if first[key] and at and first[key] > at:
                out.add((e, "late"))
        else:
            out.add((e, "deleted" if key in log else "missing"))
    return out


def test_small_cases(spark):
    nodes = [("File", 1, day(3), "a"), ("file", 1, day(1), "a"), ("method", 0, day(1), "b"), ("method", -5, None, "b"), ("method", None, day(1), "b")]
    gone = [("FILE", 9), ("file", 1)]
    refs = [(1, "FILE", 1, day(2), 0), (2, "file", 1, day(0), 0), (3, "method", 1, day(2), 0), (4, "file", 9, day(2), 0), (5, "method", 0, day(2), 0), (6, "method", -5, day(0), 0), (7, "file", None, day(2), 0), (8, None, 1, day(2), 0), (9, "method", 0, None, 0), (2, "file", 1, day(0), 0), (10, "method", -70000, day(1), 0)]
    assert run(spark, refs, nodes, gone) == brute(refs, nodes, gone)
    assert run(spark, refs, [], []) == {(e, "missing") for e, _, k, _, _ in refs if k is not None}
    assert run(spark, [], nodes, gone) == set()


def test_random_with_hot_range(spark, monkeypatch):
    monkeypatch.setattr(R, "CELL_ROWS", 100)
    monkeypatch.setattr(R, "HOT_RANGES", 8)
    rnd = random.Random(5)
    nodes = [(rnd.choice(["a", "B"]), rnd.randrange(-40000, 60000), day(rnd.randrange(50)), "") for _ in range(3000)]
    keys = [(t, k) for t, k, _, _ in nodes]
    gone = [rnd.choice(keys) for _ in range(20)] + [("a", rnd.randrange(60000)) for _ in range(400)]
    pick = lambda: rnd.choice(keys) if rnd.random() < 0.6 else ("A", 7) if rnd.random() < 0.6 else rnd.choice(gone)
    refs = [(i, *pick(), day(rnd.randrange(60)), 0) for i in range(4000)]
    assert run(spark, refs, nodes, gone) == brute(refs, nodes, gone)
