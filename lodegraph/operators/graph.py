"""Graph operators on edge frames (src, dst, ...): frontiers are frames, rounds are joins.

Visited sets and frontiers stay distributed; each round is cut from its lineage through the
checkpoint folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.session import cut

MERGE = 8  # rounds after which what was seen is written as one frame


def keyed(edges: DataFrame) -> DataFrame:
    """Edges between node keys ``type:id``; dst is null where unresolved."""
    return edges.select("edge_id", "edge_kind", F.concat_ws(":", "src_type", "src_id").alias("src"), F.when(F.col("dst_id").isNotNull(), F.concat_ws(":", "dst_type", "dst_id")).alias("dst"), "confidence")


def reach(starts: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """(node, depth): breadth-first from ``starts`` (node) along ``links`` (src, dst), at most ``depth`` steps."""
    seen = cut(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        nxt = front.join(links, front["node"] == links["src"]).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        front = cut(nxt)
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.where("dst is not null").select("src", "dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def focus(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Subgraph within ``depth`` undirected steps of the starts."""
    near = reach(starts, both_ways(edges), depth).select("node")
    e = edges.where("dst is not null")
    return e.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")


def trace(edges: DataFrame, starts: DataFrame, depth: int, unresolved: bool = True) -> DataFrame:
    """Interactions in order of a directed trace: every out-edge of a visited node is one.

    Unresolved calls get a virtual participant and go no further; without ``unresolved`` they are left out.
    """
    visited = reach(starts, edges.where("dst is not null").select("src", "dst").distinct(), depth - 1)
    x = edges.join(visited.withColumnRenamed("node", "src"), "src")
    if not unresolved:
        x = x.where("dst is not null")
    return x.select("edge_id", "depth", "src", F.coalesce("dst", F.concat(F.lit("unresolved:"), F.col("edge_id").cast("string"))).alias("dst"))


def chain_depth(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """Longest distance reached from each start: (start, depth, nodes); without ``depth`` until no new node is found."""
    links = cut(edges.where("dst is not null").select("src", "dst").distinct())
    front = cut(starts.select(F.col("node").alias("start"), "node").distinct().withColumn("depth", F.lit(0)))
    seen, d = front, 0
    while depth is None or d < depth:
        d += 1
        nxt = front.join(links, front["node"] == links["src"]).select("start", F.col("dst").alias("node")).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(d))
        front = cut(nxt)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if d % MERGE == 0:
            seen = cut(seen)
    return seen.groupBy("start").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("nodes"))


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level): level 0 has no incoming edges; nodes on or behind cycles get level -1."""
    links = cut(edges.where("dst is not null and src <> dst").select("src", "dst").distinct())
    left = cut(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct())
    out = None
    for level in count():  # ends when what is left is empty, or on or behind a cycle
        free = cut(left.join(links.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        if free.isEmpty():
            break
        done = free.withColumn("level", F.lit(level))
        out = done if out is None else out.unionByName(done)
        if level % MERGE == MERGE - 1:
            out = cut(out)
        left = cut(left.join(free, "node", "left_anti"))
        links = cut(links.join(free.withColumnRenamed("node", "src"), "src", "left_anti"))
    rest = left.withColumn("level", F.lit(-1))
    return rest if out is None else out.unionByName(rest)


def mutual(edges: DataFrame) -> DataFrame:
    """Pairs that refer to each other, each pair once."""
    e = edges.where("dst is not null and src <> dst").select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"], "left_semi").where("src < dst").select(F.col("src").alias("node1"), F.col("dst").alias("node2"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each undirected component.

    Large-star and small-star rounds: every node links to the smallest of its neighbourhood, so
    the number of rounds grows with the logarithm of the graph and hubs don't multiply edges.
    Rounds end only when one changes nothing.
    """
    e = cut(edges.where("dst is not null").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    links = e.where("u <> v")
    before = None
    while True:
        both = links.union(links.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        links = cut(large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small_low.select("u", F.col("m").alias("v"))).distinct())
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return nodes.join(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Communities by weighted label propagation; ties go to the smallest label.

    Not modularity optimisation: a deterministic stand-in that needs one join per round.
    """
    w = edges.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    links = cut(w.union(w.select(F.col("dst"), F.col("src"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    labels = cut(links.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    for _ in range(rounds):
        votes = links.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("b")).select(F.col("src").alias("node"), F.col("b.label").alias("label"))
        labels = cut(best)
    return labels


def positional_flow(views: DataFrame, units: DataFrame, uses: DataFrame, n_views: int, n_units: int) -> DataFrame:
    """i-th page to i-th statement, and the tables that the statement uses."""
    v = views.orderBy("view").limit(n_views).withColumn("i", F.row_number().over(W.orderBy("view")))  # a handful of rows
    u = units.orderBy("unit").limit(n_units).withColumn("i", F.row_number().over(W.orderBy("unit")))
    return v.join(u, "i").join(uses, "unit", "left").select("view", "unit", "used")


def grid_positions(nodes: DataFrame, key: str, columns: int, groups: str) -> DataFrame:
    """Row and column of each node in its group's grid."""
    i = F.row_number().over(W.partitionBy(groups).orderBy(key)) - 1
    return nodes.select(groups, key, i.alias("_i")).select(groups, key, F.floor(F.col("_i") / columns).cast("int").alias("y"), (F.col("_i") % columns).alias("x"))


#: Gain in modularity below which a level is the last; share of nodes that move below which, and share of those two rounds
#: before above which, the rounds of a level end.
LEAST_GAIN, LEAST_MOVES, STEADY = 1e-4, 0.01, 0.9


def modularity(links: DataFrame, labels: DataFrame) -> float:
    """Of weighted links in both directions (src, dst, w; loops once, with twice their weight) and labels (node, label)."""
    a, b = labels.select(F.col("node").alias("src"), F.col("label").alias("a")), labels.select(F.col("node").alias("dst"), F.col("label").alias("b"))
    x = links.join(a, "src").join(b, "dst").groupBy("a").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0)).alias("inside"))
    r = x.agg(F.sum("k").alias("m"), F.sum("inside").alias("i"), F.sum(F.col("k").cast("double") * F.col("k")).alias("kk")).first()
    return r["i"] / r["m"] - r["kk"] / (float(r["m"]) * r["m"]) if r["m"] else 0.0


def _moved(links: DataFrame) -> DataFrame:
    """(node, label) after rounds of local moves: nodes go where modularity gains most, half of them in each round."""
    degree = cut(links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")))
    total = float(degree.agg(F.sum("k")).first()[0] or 0)
    labels = cut(degree.select("node", F.col("node").alias("label")))
    moves: list[int] = []
    nodes = labels.count()
    for r in count():
        sizes = labels.join(degree, "node").groupBy("label").agg(F.sum("k").alias("size"))
        near = links.where("src <> dst").join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.sum("w").alias("w"))
        own = labels.join(degree, "node").select("node", F.col("label").alias("own"), "k")
        stay = own.select("node", F.col("own").alias("label"), F.lit(0).cast("long").alias("w"))
        x = near.unionByName(stay).groupBy("node", "label").agg(F.sum("w").alias("w")).join(own, "node").join(sizes, "label")
        others = F.col("size") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0)
        gain = F.col("w") - others * F.col("k") / F.lit(total)
        choice = x.groupBy("node", "own").agg(F.max(F.struct(gain.alias("gain"), (F.col("label") == F.col("own")).alias("stays"), F.col("label"))).alias("c"))
        turn = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0  # neighbours that swap sides together would never settle
        goes = turn & (F.col("c.label") != F.col("own"))
        now = cut(choice.select("node", F.when(goes, F.col("c.label")).otherwise(F.col("own")).alias("label"), goes.alias("goes")))
        moves.append(now.where("goes").count())
        labels = now.drop("goes")
        if moves[-1] <= LEAST_MOVES * nodes or (r >= 4 and moves[-1] >= STEADY * moves[-3]):
            return labels


def modularity_communities(edges: DataFrame) -> DataFrame:
    """(node, community): local moves, then the same over communities as nodes, as long as modularity gains.

    Every step is a join or aggregation over links; a community is named by one of its nodes. Edges
    count by number, in either direction; nodes without resolved edges have none and are left out.
    """
    w = edges.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    links = cut(w.union(w.select(F.col("dst"), F.col("src"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    if links.isEmpty():
        return links.select(F.col("src").alias("node"), F.col("src").alias("community"))
    whole, quality = None, None
    level = links
    while True:
        moved = _moved(level)
        up = moved if whole is None else whole.withColumnRenamed("label", "mid").join(moved.withColumnRenamed("node", "mid"), "mid").select("node", "label")
        up = cut(up)
        now = modularity(links, up)
        if quality is not None and now - quality < LEAST_GAIN:
            break
        whole, quality = up, now
        a, b = moved.select(F.col("node").alias("src"), F.col("label").alias("a")), moved.select(F.col("node").alias("dst"), F.col("label").alias("b"))
        level = cut(level.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
    return whole.withColumnRenamed("label", "community")
