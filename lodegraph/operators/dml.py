"""Table maintenance as new frames: upserts, cascades, de-duplication, synthesis of missing rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names in joins that look like aliases, never tables (fixed values).
ALIAS_NAMES = ["A", "B", "C", "T", "T1", "T2", "U", "P", "M"]
META_CHARS = 500
LEAST_CONFIDENCE = 0.3


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` outside the keys that ``new`` brings, and ``new``: delete and insert per key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def cascade_delete(files: DataFrame, components: DataFrame, edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that survive the removal of files and of everything in them."""
    dead = gone.select(F.lit("file").alias("t"), F.col("file_id").alias("id"))
    dead = dead.unionByName(components.join(gone, "file_id", "left_semi").select(F.col("component_type").alias("t"), F.col("component_id").alias("id")))
    src, dst = dead.select(F.col("t").alias("src_type"), F.col("id").alias("src_id")), dead.select(F.col("t").alias("dst_type"), F.col("id").alias("dst_id"))
    return edges.join(src, ["src_type", "src_id"], "left_anti").join(dst, ["dst_type", "dst_id"], "left_anti")


def repointed(parents: DataFrame, children: DataFrame, keys: list[str], id_col: str, ref: str) -> DataFrame:
    """Children of duplicate parents go to the parent that is kept, the one of smallest id."""
    keep = parents.groupBy(*keys).agg(F.min(id_col).alias("_keep"))
    moved = parents.join(keep, keys).select(F.col(id_col).alias(ref), "_keep")
    return children.join(moved, ref, "left").withColumn(ref, F.coalesce("_keep", ref)).drop("_keep")


def upsert_edges(known: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """New edges worth keeping: confident, not there yet, each once; ends without a node are marked."""
    keys = ["src_type", "src_id", "dst_type", "dst_id", "edge_kind"]
    x = new.where(F.col("confidence") >= LEAST_CONFIDENCE).where("dst_id is not null").join(known.select(*keys).distinct(), keys, "left_anti")
    x = x.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.max(F.substring("meta", 1, META_CHARS)).alias("meta"))
    ends = nodes.select(F.col("node_type").alias("dst_type"), F.col("node_id").alias("dst_id"), F.lit(False).alias("dummy"))
    return x.join(ends, ["dst_type", "dst_id"], "left").withColumn("dummy", F.coalesce("dummy", F.lit(True)))


def inferred_tables(used: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tables that statements name and the catalog lacks."""
    return used.select("table_name").distinct().where(~F.col("table_name").isin(*ALIAS_NAMES)).join(catalog.select(F.upper("table_name").alias("table_name")).distinct(), "table_name", "left_anti").withColumn("status", F.lit("INFERRED"))


def merged_catalog(catalog: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Load catalog rows: inferred entries are overwritten, valid ones get the comment only, new ones are added."""
    a, b = catalog.alias("a"), rows.alias("b")
    cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    x = a.join(b, cond, "full")
    fresh = F.col("a.status").isNull() | F.col("a.status").startswith("INFERRED")
    hit = F.col("b.status").isNotNull()
    return x.select(
        *[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys],
        F.when(hit & fresh, F.col("b.status")).otherwise(F.col("a.status")).alias("status"),
        F.when(hit, F.coalesce(F.col("b.table_comment"), F.col("a.table_comment"))).otherwise(F.col("a.table_comment")).alias("table_comment"),
    )


def orphan_column_tables(columns: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tables that only their columns speak of."""
    return columns.select("table_name").distinct().join(catalog.select("table_name"), "table_name", "left_anti").withColumn("status", F.lit("INFERRED_FROM_COLUMNS"))


def changed_files(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, deleted or modified by hash; unchanged ones are left out."""
    a, b = before.select(key, F.col(digest).alias("_a"), F.lit(True).alias("_x")), after.select(key, F.col(digest).alias("_b"), F.lit(True).alias("_y"))
    x = a.join(b, key, "full")
    change = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return x.select(key, change.alias("change")).where("change is not null")


def regenerated(old: DataFrame, new: DataFrame) -> DataFrame:
    """The table after all old rows were deleted and new ones put in: the new rows in the old one's columns."""
    return new.select(*[F.col(c).cast(old.schema[c].dataType).alias(c) for c in old.columns])
