"""Extraction: one text in, any number of rows out.

Patterns run as built-in expressions; only what needs bracket depth (comma lists of FROM clauses,
alias maps) runs in Arrow batches of Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import sqltext


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line)."""
    x = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("_p", "line"))
    return x.select(key, (F.col("_p") + 1).alias("line_no"), "line")


def grep(df: DataFrame, key: str, text: str, literal: str) -> DataFrame:
    """Lines that hold a literal; texts without it are dropped before they are split."""
    return lines(df.where(F.col(text).contains(literal)), key, text).where(F.col("line").contains(literal))


def context(df: DataFrame, key: str, text: str, literal: str, around: int) -> DataFrame:
    """Lines around the first match of each text."""
    src = df.where(F.col(text).contains(literal)).withColumn("_s", F.split(text, "\n"))
    hit = F.array_position(F.transform("_s", lambda x: x.contains(literal)), True)
    first = F.greatest(hit - around, F.lit(1))
    x = src.select(key, first.alias("_f"), F.posexplode(F.slice("_s", first.cast("int"), (hit + around - first + 1).cast("int"))).alias("_p", "line"))
    return x.select(key, (F.col("_f") + F.col("_p")).cast("int").alias("line_no"), "line")


def line_chunks(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Blocks of so many lines, with a hash of each; blocks are cut within a row, nothing is shuffled."""
    s = F.split(text, "\n")
    n = F.ceil(F.size(s) / size).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(s, i * size + 1, size))
    x = df.where(F.col(text).isNotNull()).select(key, F.posexplode(blocks).alias("chunk", "b"))
    return x.select(key, "chunk", F.md5(F.array_join("b", "\n")).alias("hash"), F.size("b").alias("lines"))


def method_signatures(df: DataFrame, key: str, text: str) -> DataFrame:
    pattern = r"public [A-Za-z<>]+ ([a-z][A-Za-z]*)\(([^()]*)\)"
    name, args = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return df.select(key, F.explode(F.arrays_zip(name.alias("name"), args.alias("args"))).alias("m")).select(key, "m.name", "m.args")


def by_rules(column: str, rules: list[tuple[str, int | str]], other: str) -> Column:
    """First matching pattern gives its group (or a fixed name)."""
    out = F
    for pattern, take in rules:
        out = out.when(F.col(column).rlike(pattern), F.regexp_extract(column, pattern, take) if isinstance(take, int) else F.lit(take))
    return out.otherwise(other)


def close_matches(names: DataFrame, column: str, wanted: str, k: int) -> DataFrame:
    """Nearest names by edit distance."""
    return names.select(column, F.levenshtein(F.col(column), F.lit(wanted)).alias("distance")).orderBy("distance", column).limit(k)


def sql_joins(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    x = df.select(key, *more, F.explode(sqltext.joins(text)).alias("j"))
    return x.select(key, F.upper("j.target").alias("target"), "j.left", "j.right", *more)


def primary_keys(df: DataFrame, text: str) -> DataFrame:
    """(tab, col) of single-column primary keys declared in CREATE TABLE statements."""
    flat = F.regexp_replace(sqltext.without_comments(text), r"[ \t\r\n]+", " ")
    s = df.select(F.explode(F.split(flat, ";")).alias("s")).where(F.col("s").rlike(r"(?i)CREATE TABLE [A-Za-z0-9_]+") & F.col("s").rlike(r"(?i)PRIMARY KEY \("))
    return s.select(F.upper(F.regexp_extract("s", r"(?i)CREATE TABLE ([A-Za-z0-9_]+)", 1)).alias("tab"), F.lower(F.regexp_extract("s", r"(?i)PRIMARY KEY \(([A-Za-z0-9_]+)\)", 1)).alias("col")).distinct()


def without_dynamic_tags(text: str) -> Column:
    tags = r"<(?:if|choose|when|otherwise|where|set|foreach|trim|bind)\b[^>]*>|</(?:if|choose|when|otherwise|where|set|foreach|trim)>"
    return F.regexp_replace(F.regexp_replace(text, tags, " "), r"[ \t\r\n]+", " ")


def mapper_statements(df: DataFrame, key: str, text: str) -> DataFrame:
    p = r"<(select|insert|update|delete)\s+id=\"([^\"]+)\"[^>]*>"
    z = F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("kind"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("stmt_id"))
    x = df.select(key, F.regexp_extract(text, r"<mapper\s+namespace=\"([^\"]+)\"", 1).alias("ns"), F.explode(z).alias("s"))
    return x.select(key, "s.kind", "s.stmt_id", "ns")


def includes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Fragments that mapper statements include, and whether the same file defines them."""
    names = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(1)))
    x = df.select(key, names(r"<sql\s+id=\"([^\"]+)\"").alias("_d"), F.explode(names(r"<include\s+refid=\"([^\"]+)\"")).alias("refid"))
    return x.select(key, "refid", F.array_contains("_d", F.col("refid")).alias("resolved"))


def java_types(df: DataFrame, key: str, text: str) -> DataFrame:
    decl = r"\b(class|interface|enum) ([A-Z][A-Za-z0-9_]*)"
    return df.select(
        key, F.regexp_extract(text, r"(?m)^package ([a-z0-9_.]+);", 1).alias("package"), F.regexp_extract(text, decl, 1).alias("kind"), F.regexp_extract(text, decl, 2).alias("name"),
        F.size(F.regexp_extract_all(text, F.lit(r"(?m)^import [A-Za-z0-9_.*]+;"), F.lit(0))).alias("imports"),
    )


def by_patterns(df: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, target, kind): different targets of each pattern's first group, in one pass over the text."""

    def targets(kind: str, pattern: str) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), lambda t: F.struct(t.alias("target"), F.lit(kind).alias("kind")))

    found = F.flatten(F.array(*[targets(k, p) for k, p in patterns.items()]))
    return df.select(key, F.inline(found))


def java_calls(df: DataFrame, key: str, text: str) -> DataFrame:
    p = r"\b([a-z][A-Za-z0-9_]*)\.([a-z][A-Za-z0-9_]*)\("
    z = F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("receiver"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("method"))
    return df.select(key, F.explode(z).alias("c")).groupBy(key, F.col("c.receiver").alias("receiver"), F.col("c.method").alias("method")).agg(F.count(F.lit(1)).alias("calls"))


def insert_to_select(df: DataFrame, key: str, text: str) -> DataFrame:
    """Tables of a file that one statement fills and another reads."""
    flat = F.regexp_replace(sqltext.without_comments(text), r"[ \t\r\n]+", " ")
    s = df.select(key, F.transform(F.split(flat, ";"), lambda x: F.trim(x)).alias("_s"))
    filled = F.transform(F.filter("_s", lambda x: x.rlike("(?i)^INSERT INTO ")), lambda x: F.upper(F.regexp_extract(x, r"(?i)^INSERT INTO ([A-Za-z0-9_]+)", 1)))
    read = F.flatten(F.transform(F.filter("_s", lambda x: x.rlike("(?i)^SELECT ")), lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(?i)\b(?:FROM|JOIN) ([A-Za-z0-9_]+)"), F.lit(1)), lambda t: F.upper(t))))
    return s.select(key, F.explode(F.array_intersect(filled, read)).alias("tab"))


def parser_of(path: str, text: str) -> Column:
    p, c = F.col(path), F.col(text)
    return (
        F.when(p.endswith(".java"), "java").when(p.endswith(".jsp"), "jsp").when(p.endswith(".xml") & c.contains("<mapper"), "mybatis").when(p.endswith(".xml") & c.contains("<beans"), "spring")
        .when(p.endswith(".xml"), "xml").when(p.endswith(".sql"), "sql").otherwise("none")
    )


# What needs the depth of brackets ---------------------------------------------------
_COMMENTS = re.compile(r"/\*.*?\*/|--[^\n]*", re.S)
_STRING = re.compile(r"'(?:[^']|'')*'")
_FROM = re.compile(r"\bFROM\b(.*?)(?=\bWHERE\b|\bGROUP\s+BY\b|\bORDER\s+BY\b|\bCONNECT\s+BY\b|\bHAVING\b|\bUNION\b|$)", re.I | re.S)
_WHERE = re.compile(r"\bWHERE\b(.*?)(?=\bGROUP\s+BY\b|\bORDER\s+BY\b|$)", re.I | re.S)
_TABLE = re.compile(r"^\s*([A-Za-z_][\w.$#]*)(?:\s+(?:AS\s+)?([A-Za-z_]\w*))?\s*$", re.I)
_JOIN_PART = re.compile(r"\b(?:(?:LEFT|RIGHT|FULL)(?:\s+OUTER)?|INNER|CROSS)?\s*JOIN\s+([A-Za-z_][\w.$#]*)(?:\s+(?:AS\s+)?(?!ON\b|USING\b)([A-Za-z_]\w*))?", re.I)
_EQUAL = re.compile(r"([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*=\s*([A-Za-z_]\w*)\.([A-Za-z_]\w*)")


def _top_level(text: str, separator: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, ch in enumerate(text):
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth = max(0, depth - 1)
        elif ch == separator and not depth:
            parts.append(text[last:i])
            last = i + 1
    return [*parts, text[last:]]


def aliases_of(statement: str) -> tuple[dict[str, str], list[str]]:
    """Alias -> table of a statement, and the tables of a comma list in its FROM clause."""
    text = _STRING.sub("''", _COMMENTS.sub(" ", statement))
    found: dict[str, str] = {}
    listed: list[str] = []
    for clause in _FROM.findall(text):
        for part in _top_level(clause, ","):
            head = re.split(r"\b(?:LEFT|RIGHT|FULL|INNER|CROSS|JOIN|NATURAL)\b", part, maxsplit=1, flags=re.I)[0]
            m = _TABLE.match(head)
            if m:
                name = m.group(1).upper()
                found[(m.group(2) or name.rpartition(".")[2]).upper()] = name
                listed.append(name)
            for j in _JOIN_PART.finditer(part):
                name = j.group(1).upper()
                found[(j.group(2) or name.rpartition(".")[2]).upper()] = name
    return found, listed


def _split(sql: str) -> list[str]:
    return [s for s in _top_level(_COMMENTS.sub(" ", sql), ";") if s.strip()]


def alias_map(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, statement_no, alias, table_name)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, a, t) for k, sql in zip(pdf["k"], pdf["t"]) for i, s in enumerate(_split(sql)) for a, t in sorted(aliases_of(s)[0].items())]
            yield pd.DataFrame(rows, columns=[key, "statement_no", "alias", "table_name"])

    x = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return x.mapInPandas(run, f"{key} long, statement_no int, alias string, table_name string")


def implicit_joins(df: DataFrame, key: str, text: str) -> DataFrame:
    """Joins written as equalities in WHERE between tables of a FROM list, aliases resolved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, sql in zip(pdf["k"], pdf["t"]):
                for i, s in enumerate(_split(sql)):
                    names, _ = aliases_of(s)
                    for w in _WHERE.findall(_STRING.sub("''", s)):
                        for a, ac, b, bc in _EQUAL.findall(w):
                            left, right = names.get(a.upper(), a.upper()), names.get(b.upper(), b.upper())
                            if left != right:
                                rows.append((k, i, left, ac.lower(), right, bc.lower()))
            yield pd.DataFrame(rows, columns=[key, "statement_no", "l_table", "l_col", "r_table", "r_col"])

    x = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return x.mapInPandas(run, f"{key} long, statement_no int, l_table string, l_col string, r_table string, r_col string")
