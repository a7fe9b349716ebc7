"""Relational operators on metadata frames; all declarative, so Catalyst picks the physical plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Relatedness of directly linked nodes by kind of edge, in percent (fixed values).
EDGE_SCORES = {"extends": 90, "implements": 90, "use_table": 75, "call": 70, "include": 60}
OTHER_EDGE = 50
PROXIMITY_PCT = 60


def scoped(df: DataFrame, key: str, scope: DataFrame, scope_key: str) -> DataFrame:
    """Rows whose key is in scope: a semi join, the ids never leave the cluster."""
    return df.join(scope.select(F.col(scope_key).alias(key)), key, "left_semi")


def confident(edges: DataFrame, default: float, by_kind: dict[str, float]) -> DataFrame:
    least = F.lit(default)
    for kind, value in by_kind.items():
        least = F.when(F.col("edge_kind") == kind, value).otherwise(least)
    return edges.where(F.col("confidence") >= least)


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    src = nodes.select(F.col("node_type").alias("src_type"), F.col("node_id").alias("src_id"))
    dst = nodes.select(F.col("node_type").alias("dst_type"), F.col("node_id").alias("dst_id"))
    return edges.join(src, ["src_type", "src_id"], "left_semi").join(dst, ["dst_type", "dst_id"], "left_semi")


def later_duplicates(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """All rows but the first of each key."""
    first = df.groupBy(*keys).agg(F.min(id_col).alias(id_col))
    return df.join(first.select(id_col), id_col, "left_anti")


def external_call(name: str, prefixes: list[str], exact: list[str], suffixes: list[str], shortest: int = 3) -> Column:
    n = F.col(name)
    out = n.isin(*exact) | n.rlike("(" + "|".join(suffixes) + ")$") | (F.length(n) < shortest)
    for p in prefixes:
        out = out | n.startswith(p)
    return out


def project_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the project that they start in; catalog tables belong to none."""
    own = nodes.where(F.col("project_id").isNotNull()).select(F.col("node_type").alias("src_type"), F.col("node_id").alias("src_id"), "project_id")
    return edges.where("src_type <> 'table'").drop("project_id").join(own, ["src_type", "src_id"])


def polymorphic(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    return refs.join(nodes, ["node_type", "node_id"])


def counted(left: DataFrame, right: DataFrame, key: str, keep: list[str], count: str, name: str) -> DataFrame:
    """Left rows with the number of right rows, zero included; the right side is counted before it moves."""
    n = right.groupBy(key).agg(F.count(count).alias(name))
    return left.join(n, key, "left").select(key, *keep, F.coalesce(name, F.lit(0)).alias(name))


def touching(edges: DataFrame, items: DataFrame, kind: str) -> DataFrame:
    """(item, edge) pairs for edges that touch an item at either end: two equi-joins instead of an OR."""
    key = items.columns[0]
    ends = (
        edges.where(F.col("src_type") == kind).select("edge_id", F.col("src_id").alias(key)).union(edges.where(F.col("dst_type") == kind).select("edge_id", F.col("dst_id").alias(key))).distinct()
    )
    return ends.join(items, key)


def relationship_view(edges: DataFrame, nodes: DataFrame, files: DataFrame, projects: DataFrame) -> DataFrame:
    a = nodes.select(F.col("node_type").alias("src_type"), F.col("node_id").alias("src_id"), F.col("label").alias("src_label"), "file_id")
    b = nodes.select(F.col("node_type").alias("dst_type"), F.col("node_id").alias("dst_id"), F.col("label").alias("dst_label"))
    x = edges.drop("project_id").join(a, ["src_type", "src_id"]).join(b, ["dst_type", "dst_id"])
    x = x.join(files.select("file_id", F.col("path").alias("src_path"), "project_id"), "file_id").join(projects.select("project_id", "root_path"), "project_id")
    return x.select("edge_id", "src_label", "edge_kind", "dst_label", "src_path", "root_path")


def proximity(files: DataFrame, directory: Column) -> DataFrame:
    """Files of one directory are related; a directory stands for its pairs, which are only counted."""
    g = files.groupBy(directory.alias("directory")).agg(F.count(F.lit(1)).alias("files")).where("files > 1")
    return g.select("directory", "files", F.expr("files * (files - 1) div 2").alias("pairs"), F.lit(PROXIMITY_PCT).alias("score_pct"))


def resolve_calls(hints: DataFrame, components: DataFrame) -> DataFrame:
    """Target of each method-call hint: same parent, then same file, same project, anywhere."""
    x = hints.where("src_type = 'method'").select("hint_id", "src_id", F.get_json_object("hint", "$.called_name").alias("component_name")).where("component_name is not null")
    src = components.select(F.col("component_id").alias("src_id"), F.col("project_id").alias("sp"), F.col("file_id").alias("sf"), F.col("parent_component_id").alias("sc"))
    # per tier the least target of each key: a name that thousands of methods bear is one row, not a product
    m = components.where("component_type = 'method' and component_name is not null")
    x = x.join(src, "src_id").select("hint_id", "component_name", F.col("sc").alias("parent_component_id"), F.col("sf").alias("file_id"), F.col("sp").alias("project_id"))
    tiers = ("parent_component_id", "file_id", "project_id", None)
    for i, key in enumerate(tiers, 1):
        keys = ["component_name"] + ([key] if key else [])
        x = x.join(m.groupBy(*keys).agg(F.min("component_id").alias(f"t{i}")), keys, "left")
    best = F.coalesce(*[F.when(F.col(f"t{i}").isNotNull(), F.struct(F.lit(i).alias("tier"), F.col(f"t{i}").alias("target"))) for i in range(1, 5)])
    one = x.where(best.isNotNull()).groupBy("hint_id").agg(F.min(best).alias("best"))
    return one.select("hint_id", "best.target", "best.tier")


def default_first(df: DataFrame, keys: list[str], column: str, default: str, id_col: str) -> DataFrame:
    """One row per key, rows with the default value first."""
    return first_per_key(df, keys, F.when(F.col(column) == default, 0).otherwise(1), F.col(id_col))


def by_suffix(wanted: DataFrame, target: str, files: DataFrame, path: str) -> DataFrame:
    """Files whose path ends with a wanted one: an equi-join on the base name, then the rest is compared."""
    name = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    return files.withColumn("_b", name(path)).join(wanted.withColumn("_b", name(target)), "_b").where(F.col(path).endswith(F.concat(F.lit("/"), F.col(target)))).drop("_b")


def project_summary(projects: DataFrame, files: DataFrame, components: DataFrame, units: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    f = files.groupBy("project_id").agg(n.alias("files"))
    c = components.groupBy("project_id").agg(F.count_if(F.col("component_type") == "class").alias("classes"), F.count_if(F.col("component_type") == "method").alias("methods"))
    s = units.join(files.select("file_id", "project_id"), "file_id").groupBy("project_id").agg(n.alias("sql_units"))
    out = projects.select("project_id")
    for x in (f, c, s):
        out = out.join(x, "project_id", "left")
    return out.na.fill(0)


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def pair_rollup(edges: DataFrame, nodes: DataFrame, group: str, src: str, dst: str) -> DataFrame:
    a = nodes.where(F.col(group).isNotNull()).select(F.col("node_type").alias("src_type"), F.col("node_id").alias("src_id"), F.col(group).alias(src))
    b = nodes.where(F.col(group).isNotNull()).select(F.col("node_type").alias("dst_type"), F.col("node_id").alias("dst_id"), F.col(group).alias(dst))
    x = edges.join(a, ["src_type", "src_id"]).join(b, ["dst_type", "dst_id"])
    return x.groupBy(src, dst).agg(
        F.count(F.lit(1)).alias("edges"), F.sum(F.round(F.col("confidence") * 100).cast("long")).alias("confidence_pct"),
        F.when(F.min("edge_kind") != F.max("edge_kind"), "mixed").otherwise(F.min("edge_kind")).alias("kind"),
    )


def _ends(edges: DataFrame, *extra: str) -> DataFrame:
    out = edges.select(F.col("src_type").alias("node_type"), F.col("src_id").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i"), *extra)
    return out.unionByName(edges.where("dst_id is not null").select(F.col("dst_type").alias("node_type"), F.col("dst_id").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i"), *extra))


def degrees(edges: DataFrame) -> DataFrame:
    return _ends(edges).groupBy("node_type", "node_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count(F.lit(1)).alias("degree"))


def incident_confidence(edges: DataFrame) -> DataFrame:
    x = _ends(edges.where("confidence is not null"), "confidence").groupBy("node_type", "node_id")
    return x.agg((F.sum(F.round(F.col("confidence") * 100).cast("long")).cast("double") / F.count("confidence")).alias("mean_pct"))


def edge_score() -> Column:
    out = F
    for kind, score in EDGE_SCORES.items():
        out = out.when(F.col("edge_kind") == kind, score)
    return out.otherwise(OTHER_EDGE)


def best_per_pair(edges: DataFrame) -> DataFrame:
    """Best score of each unordered pair of linked nodes; ties go to the first kind by name."""
    a, b = F.concat_ws(":", "src_type", "src_id"), F.concat_ws(":", "dst_type", "dst_id")
    x = edges.where("dst_id is not null").select(F.least(a, b).alias("node1"), F.greatest(a, b).alias("node2"), edge_score().alias("score"), "edge_kind")
    best = x.groupBy("node1", "node2").agg(F.min(F.struct((-F.col("score")).alias("s"), "edge_kind")).alias("best"))
    return best.select("node1", "node2", (-F.col("best.s")).alias("score"), F.col("best.edge_kind").alias("reason"))


def confidence_bin(column: str) -> Column:
    c = F.col(column)
    return F.when(c >= 0.9, "high").when(c >= 0.7, "medium").when(c >= 0.5, "low").when(c.isNull(), "none").otherwise("very_low")


def ratio(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


def severity_rank(loc: str) -> Column:
    c = F.col(loc)
    return F.when(c <= 100, 1).when(c <= 300, 2).when(c <= 800, 3).otherwise(4)


def relationship_quality(edges: DataFrame) -> DataFrame:
    c = F.col("confidence")
    x = edges.where(c.isNotNull()).groupBy("project_id").agg(F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low"), F.count(F.lit(1)).alias("n"))
    return x.select("project_id", "high", "medium", "low", (F.expr("high * 10 + medium * 7 + low * 3").cast("double") / (10 * F.col("n"))).alias("quality"))


def first_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_k(df: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def best_overload(hints: DataFrame, components: DataFrame, signatures: DataFrame) -> DataFrame:
    """Overload whose number of parameters is nearest: 10, 5 or 1 points, then the smallest id.

    ``signatures`` is (file_id, component_name, params) as the sources declare them. Of a name's
    methods with equally many parameters only the smallest id can win, so a popular name is a few rows.
    """
    x = hints.select("hint_id", F.get_json_object("hint", "$.called_name").alias("component_name"), F.expr("try_cast(get_json_object(hint, '$.arg_count') as bigint)").alias("args")).where("args is not null")
    d = components.where("component_type = 'method'").join(signatures, ["file_id", "component_name"]).groupBy("component_name", "params").agg(F.min("component_id").alias("component_id"))
    gap = F.abs(F.col("args") - F.col("params"))
    score = F.when(gap == 0, 10).when(gap == 1, 5).otherwise(1)
    best = x.join(d, "component_name").groupBy("hint_id").agg(F.min(F.struct((-score).alias("s"), "component_id")).alias("b"))
    return best.select("hint_id", "b.component_id", (-F.col("b.s")).alias("score"))


def entry_points(components: DataFrame, rules: list[tuple[Column, int, str]]) -> DataFrame:
    """Entry points by rule; of several rules the one of highest priority, one pass over the table."""
    hits = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(-p).alias("p"), F.lit(r).alias("r"))) for cond, p, r in rules]))
    x = components.select("component_id", F.array_min(hits).alias("best")).where("best is not null")
    return x.select("component_id", (-F.col("best.p")).alias("priority"), F.col("best.r").alias("reason"))


def call_order(name: str) -> Column:
    n = F.col(name)
    return F.when(n.rlike("^(init|open|start|load)"), 0).when(n.rlike("^(check|find|select)"), 1).when(n.rlike("^(save|update|insert)"), 3).when(n.rlike("^(close|archive|notify)"), 4).otherwise(2)


def consecutive(components: DataFrame) -> DataFrame:
    """Inferred edges between methods of a class that follow each other in the usual order of calls."""
    x = components.where("component_type = 'method' and parent_component_id is not null").select(F.col("parent_component_id").alias("class_id"), F.col("component_id").alias("src"), call_order("component_name").alias("pr"))
    return x.withColumn("dst", F.lead("src").over(W.partitionBy("class_id").orderBy("pr", "src"))).where("dst is not null").select("class_id", "src", "dst")


def top_subgraph(edges: DataFrame, k: int) -> DataFrame:
    """Edges among the k nodes of highest degree; k bounds what is broadcast."""
    a, b = F.concat_ws(":", "src_type", "src_id"), F.concat_ws(":", "dst_type", "dst_id")
    keys = edges.select(a.alias("k")).union(edges.select(b.alias("k")))
    top = F.broadcast(keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k").limit(k).select("k"))
    return edges.withColumn("_a", a).withColumn("_b", b).join(top.withColumnRenamed("k", "_a"), "_a", "left_semi").join(top.withColumnRenamed("k", "_b"), "_b", "left_semi").drop("_a", "_b")


def compare_sets(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    key = a.columns[0]
    x = a.distinct().withColumn("l", F.lit(1)).join(b.distinct().withColumn("r", F.lit(1)), key, "full")
    return x.select(key, F.when(F.col("r").isNull(), left).when(F.col("l").isNull(), right).otherwise("both").alias("side"))


def related(parts: list[tuple[DataFrame, str, str, str, int]], pattern: str) -> DataFrame:
    """A few texts per source that match a pattern: each part is (df, origin, text, id, how many)."""
    out = None
    for df, origin, text, key, k in parts:
        one = df.where(F.col(text).ilike(pattern)).orderBy(key).limit(k).select(F.lit(origin).alias("origin"), F.col(text).alias("label"))
        out = one if out is None else out.unionByName(one)
    return out
