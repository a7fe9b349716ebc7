import random

import pytest

from lodegraph.llm import packing, queries, tokens


@pytest.fixture(scope="module")
def enc():
    return tokens.load()


def samples():
    rnd = random.Random(4)
    words = ["alpha", "Ünïcode", "한국어", " ", "  ", "\n", "\t\n", "don't", "12345", "…", "👩‍💻", "x" * 50, "　", "\x1c", "'ll"]
    out = ["", " ", "a", "x" * 5000, " " * 3000, "한" * 2000]
    return out + ["".join(rnd.choice(words) + (" " if rnd.random() < 0.4 else "") for _ in range(rnd.randrange(1, 400))) for _ in range(40)]


def test_tree_equals_plain_encoding(enc):
    tree = tokens.TreeEncoder(enc.encoding, leaf_chars=37, window=2)
    for t in samples():
        ids = tree.encode(t)
        assert ids == enc.encoding.encode_ordinary(t)
        assert tree.decode(ids) == t


def test_matches_the_other_library(enc):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{tokens.TOKENIZERS}/{tokens.NAME}.json")
    other.encode_special_tokens = True
    for t in samples() + ["<|endoftext|> text"]:
        assert enc.encode(t) == other.encode(t, add_special_tokens=False).ids


def test_rows(spark):
    rows = [(1, "hello world", 5), (2, None, 6), (3, "", 7), (None, "x", 8), (1, "hello world", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = [(r.doc_id, r.ids) for r in tokens.token_ids(df, "doc_id", "text").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(1, [31373, 995]), (2, []), (3, []), (None, [87]), (1, [31373, 995])]))
    assert tokens.token_ids(df.where("false"), "doc_id", "text").collect() == []


def naive_ffd(sizes, capacity):
    bins, out = [], []
    for s in sizes:
        for i, free in enumerate(bins):
            if free >= s:
                bins[i] -= s
                out.append(i)
                break
        else:
            bins.append(capacity - s)
            out.append(len(bins) - 1)
    return out


def test_tournament_equals_naive():
    rnd = random.Random(9)
    for _ in range(30):
        sizes = sorted((rnd.randrange(0, 60) for _ in range(rnd.randrange(0, 200))), reverse=True)
        assert packing.first_fit_decreasing(sizes, 60) == naive_ffd(sizes, 60)


def test_pack_keeps_everything(spark):
    rnd = random.Random(2)
    items = [(i, rnd.choice([0, 3, 10, 50, 99, 100, 101, 250, 1000])) for i in range(500)] + [(7, 42), (7, 42)]
    df = spark.createDataFrame(items, "doc_id long, n_tokens long")
    rows = packing.pack(df, "doc_id", [(1, 100), (2, 512), (3, None)], len(items), group_items=100).collect()
    for window, capacity in ((1, 100), (2, 512)):
        mine = [r for r in rows if r.window_id == window]
        load = {}
        for r in mine:
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        assert max(load.values()) <= capacity
        assert sum(load.values()) == sum(n for _, n in items)
        for doc, n in set(items):
            copies = items.count((doc, n))
            own = [r for r in mine if r.doc_id == doc]
            if n <= capacity and doc != 7:
                assert len(own) == copies
            elif doc != 7:
                assert sorted((r.token_start, r.n_tokens) for r in own) == [(a, min(capacity, n - a)) for a in range(0, n, capacity)]
    assert packing.pack(df, "doc_id", [], 0).collect() == []


def test_every_window_gets_containers(spark, tmp_path):
    spark.createDataFrame([(1, "a b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 8 + i) for i in range(1005)], "window_id int, capacity_tokens int").write.parquet(f"{tmp_path}/context_windows.parquet")
    assert {r.window_id for r in queries.p7_packing(spark, str(tmp_path)).select("window_id").collect()} == set(range(1005))
