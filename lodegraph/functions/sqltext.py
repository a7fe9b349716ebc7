"""Column functions over SQL text: normal form, fingerprints, tables, joins, filters, placeholders.

Patterns avoid look-around and back-references, so that any SQL engine with RE2 can run the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_COMMENT = r"/\*[^*]*\*+([^/*][^*]*\*+)*/"
LINE_COMMENT = r"--[^\n]*"
TABLES = r"(?i)\b(?:FROM|JOIN|UPDATE|INTO)\s+([A-Za-z_][A-Za-z0-9_$#.]*)"
JOIN = r"(?i)\bJOIN\s+([A-Za-z_][A-Za-z0-9_.]*)\s+(?:[A-Za-z_][A-Za-z0-9_]*\s+)?ON\s*\(?\s*([A-Za-z0-9_.]+)\s*=\s*([A-Za-z0-9_.]+)"
PLACEHOLDER = r"[#$]\{\s*([A-Za-z_][A-Za-z0-9_.]*)"


def without_comments(sql) -> Column:
    """Comments go before blanks are collapsed, or a line comment would swallow the rest."""
    return F.regexp_replace(F.regexp_replace(sql, BLOCK_COMMENT, " "), LINE_COMMENT, " ")


def normalised(sql) -> Column:
    x = F.regexp_replace(without_comments(sql), r"[#$]\{[^}]*\}", "?")
    return F.lower(F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " ")))


def fingerprint(sql) -> Column:
    """MD5 of the statement's form: upper case, digits as N, quoted text as 'S'."""
    x = F.regexp_replace(F.trim(F.regexp_replace(without_comments(sql), r"[ \t\r\n]+", " ")), "'[^']*'", "'S'")
    return F.md5(F.regexp_replace(F.upper(x), "[0-9]+", "N"))


KINDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "CREATE", "ALTER", "DROP", "TRUNCATE", "COMMENT")


def kind(sql) -> Column:
    word = F.upper(F.regexp_extract(without_comments(sql), r"^\s*([A-Za-z]+)", 1))
    return F.when(word.isin(*KINDS), F.lower(word)).when(word == "WITH", "select").otherwise("unknown")


def tables(sql) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(without_comments(sql), F.lit(TABLES), F.lit(1)), lambda t: F.upper(t)))


def joins(sql) -> Column:
    """array<struct<target, left, right>> of explicit equi-joins."""
    clean = without_comments(sql)
    parts = [F.regexp_extract_all(clean, F.lit(JOIN), F.lit(i)) for i in (1, 2, 3)]
    return F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("target", "left", "right"))])


def statements(sql) -> Column:
    """Statements of a script: split at semicolons that end a line, comment lines left out."""
    clean = without_comments(sql)
    return F.filter(F.transform(F.split(clean, r";[ \t\r]*(?:\n|$)"), lambda s: F.trim(F.regexp_replace(s, r"[ \t\r\n]+", " "))), lambda s: s != "")


def placeholders(sql) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(sql, F.lit(PLACEHOLDER), F.lit(1))))


def conditions(sql) -> Column:
    """Conditions of the WHERE clause, split at AND and OR."""
    where = F.regexp_extract(F.regexp_replace(without_comments(sql), r"[ \t\r\n]+", " "), r"(?i)\bWHERE (.*?)(?: GROUP BY| ORDER BY| HAVING|;|$)", 1)
    return F.filter(F.transform(F.split(where, r"(?i) AND | OR "), lambda c: F.trim(c)), lambda c: c != "")


#: Features of Oracle's dialect by pattern (fixed values).
FEATURES = {
    "dual": r"(?i)\bFROM\s+DUAL\b", "rownum": r"(?i)\bROWNUM\b", "connect_by": r"(?i)\bCONNECT\s+BY\b", "analytic": r"(?i)\)\s*OVER\s*\(", "decode": r"(?i)\bDECODE\s*\(",
    "nvl": r"(?i)\bNVL2?\s*\(", "to_char": r"(?i)\bTO_(CHAR|DATE|NUMBER)\s*\(", "sysdate": r"(?i)\bSYSDATE\b", "case_when": r"(?i)\bCASE\s+WHEN\b", "subquery": r"(?i)\(\s*SELECT\b",
    "distinct": r"(?i)\bSELECT\s+DISTINCT\b", "group_by": r"(?i)\bGROUP\s+BY\b", "order_by": r"(?i)\bORDER\s+BY\b", "outer_join": r"(?i)\b(LEFT|RIGHT|FULL)\s+(OUTER\s+)?JOIN\b",
}


def features(sql) -> Column:
    """Sorted names of the dialect features a text uses."""
    clean = without_comments(sql)
    return F.array_compact(F.array(*[F.when(clean.rlike(p), F.lit(n)) for n, p in sorted(FEATURES.items())]))
