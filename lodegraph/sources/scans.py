"""Scans: source trees, schema CSV files, archives, whole texts."""

from __future__ import annotations

import fnmatch
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the schema CSV files by name; all are read as text, more columns are allowed.
SCHEMAS = {
    "ALL_TABLES": ["OWNER", "TABLE_NAME", "COMMENTS"],
    "ALL_TAB_COLUMNS": ["OWNER", "TABLE_NAME", "COLUMN_NAME", "DATA_TYPE", "NULLABLE", "COLUMN_COMMENTS"],
    "PK_INFO": ["OWNER", "TABLE_NAME", "COLUMN_NAME", "POSITION"],
    "ALL_VIEWS": ["OWNER", "VIEW_NAME", "TEXT"],
}


def _glob(pattern: str) -> str:
    """A glob's regular expression, without the wrapping that only Python understands."""
    return re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"\1", fnmatch.translate(pattern.removeprefix("**/")), flags=re.S)


def included(path: str, include: list[str], exclude: list[str]) -> Column:
    """Paths that match an include glob and no exclude; an exclude without ``**/`` also counts as a part of the path."""
    p = F.col(path)
    keep = F.lit(False)
    for g in include:
        tail = g.removeprefix("**/")
        keep = keep | (p.endswith(tail[1:]) if tail.startswith("*.") else p.rlike(_glob(g) + "$"))
    for g in exclude:
        keep = keep & ~p.contains(g.removeprefix("**").rstrip("*"))
    return keep


def source_tree(spark: SparkSession, root: str, include: list[str], exclude: list[str]) -> DataFrame:
    """(path, length, modificationTime, content) of a tree's files; filters come before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(included("path", include, exclude)).dropDuplicates(["path"])


def whole_texts(spark: SparkSession, root: str, include: list[str], exclude: list[str]) -> DataFrame:
    """(path, content): whole files as text; bytes that aren't UTF-8 are replaced."""
    return source_tree(spark, root, include, exclude).select("path", F.decode("content", "UTF-8").alias("content"))


def filter_config(entries: dict) -> tuple[list[str], list[str]]:
    """Include and exclude globs of a project's settings, with defaults."""
    return list(entries.get("include", ["**/*.java", "**/*.jsp", "**/*.xml", "**/*.sql"])), list(entries.get("exclude", []))


def check_columns(columns: list[str], name: str) -> tuple[bool, list[str], list[str]]:
    """(valid, missing, extra) of a schema CSV: missing columns make it invalid, extra ones don't."""
    want = SCHEMAS.get(name, [])
    have = [c.lstrip("﻿").upper() for c in columns]
    missing = [c for c in want if c not in have]
    return not missing and bool(want), missing, [c for c in have if c not in want]


def schema_csv(spark: SparkSession, path: str) -> DataFrame:
    """A schema CSV as text columns, a byte-order mark tolerated; unknown names give no rows."""
    name = re.sub(r"\.csv$", "", path.rsplit("/", 1)[-1], flags=re.I).upper()
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip().upper() for c in df.columns])
    if not check_columns(df.columns, name)[0]:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in SCHEMAS.get(name, ["NAME"])))
    keys = [c for c in ("OWNER", "TABLE_NAME", "COLUMN_NAME") if c in df.columns]
    return df.withColumns({c: F.upper(F.trim(c)) for c in keys})


def comment_csv(catalog: DataFrame, comments: DataFrame) -> DataFrame:
    """Catalog tables with the comments of a CSV (OWNER, TABLE_NAME, COMMENTS); keys compare in upper case."""
    c = comments.select(F.upper(F.trim("OWNER")).alias("_o"), F.upper(F.trim("TABLE_NAME")).alias("_t"), F.col("COMMENTS").alias("_c")).dropDuplicates(["_o", "_t"])
    x = catalog.join(c, (F.upper("owner") == F.col("_o")) & (F.upper("table_name") == F.col("_t")), "left")
    return x.withColumn("table_comment", F.coalesce("_c", "table_comment")).drop("_o", "_t", "_c")


def column_list_csv(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables and foreign-key edges of a column list (table_name, column_name, is_foreign_key, foreign_table, ...)."""
    tables = rows.groupBy("table_name").agg(F.count(F.lit(1)).alias("columns"))
    fk = rows.where(F.upper("is_foreign_key").isin("Y", "YES", "TRUE", "1")).select("table_name", "column_name", "foreign_table", "foreign_column").distinct()
    known = tables.select(F.col("table_name").alias("foreign_table"), F.lit(False).alias("dummy"))
    return tables, fk.join(known, "foreign_table", "left").withColumn("dummy", F.coalesce("dummy", F.lit(True)))


def archive_classes(archives: DataFrame) -> DataFrame:
    """(path, class_name, size) of the ``.class`` entries of archives (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        rows += [(path, i.filename[:-6].replace("/", "."), i.file_size) for i in z.infolist() if i.filename.endswith(".class")]
                except (zipfile.BadZipFile, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "class_name", "size"])

    return archives.select("path", "content").mapInPandas(run, "path string, class_name string, size long")


def read_settings(text: str) -> dict:
    """Lists by key of a project's settings (a YAML mapping of lists of scalars); comments and blank lines don't count."""
    out: dict[str, list[str]] = {}
    key = None
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        if bare.lstrip().startswith("- "):
            if key is None:
                raise ValueError(f"settings: an entry without a key: {line}")
            out[key].append(bare.lstrip()[2:].strip().strip("\"'"))
        elif bare.endswith(":"):
            key = bare.strip()[:-1].strip("\"'")
            out[key] = []
        else:
            raise ValueError(f"settings: neither a key nor an entry: {line}")
    return out
