"""Ordered rule tables over names, paths and texts, as column expressions and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Component groups by pattern, first match wins, names before paths (fixed values; case doesn't count).
COMPONENTS = [
    ("Controller", r"controller"),
    ("Service", r"service"),
    ("Repository", r"repository|dao"),
    ("Mapper", r"mapper"),
    ("Model", r"model|entity|dto|vo"),
    ("View", r"\.jsp$|\.html$|\.ftl$|/jsp/|/view/|/template/"),
    ("Config", r"config|\.properties$|\.yml$|\.yaml$"),
    ("Util", r"util|helper"),
]
OTHER = "Other"
#: Layers and domains of a class, priority words of a method (fixed values).
LAYERS = [("controller", r"controller$"), ("service", r"service$"), ("dao", r"dao|repository"), ("entity", r"entity|model|vo|dto"), ("util", r"utils?$")]
DOMAINS = [("user", r"user|member|account"), ("order", r"order|cart|purchase"), ("product", r"product|item|goods"), ("payment", r"payment|billing"), ("auth", r"auth|login|security")]
BUSY = r"process|execute|handle|create|update|delete|search|find"
#: Learning priority of a file by its name (fixed values).
PRIORITIES = [(r"controller", 5), (r"service", 4), (r"mapper|repository", 3), (r"model|entity", 4), (r"config", 1)]
UTILITY = 2
#: (file name ends with, kind, severity, pattern) of vulnerability rules, in order (fixed values; case doesn't count, a dot is any character).
VULNERABILITIES = [
    (".jsp", "sql_injection", "high", r"""\.append\s*\(\s*["'][^"']*["'].*?\)\.append\s*\([^)]*\w+[^)]*\)"""),
    (".jsp", "sql_injection", "high", r"""["'][^"']*(?:SELECT|INSERT|UPDATE|DELETE)[^"']*["'].*?\+.*?\w+"""),
    (".jsp", "sql_injection", "high", r"""\$\{[^}]*(?:SELECT|INSERT|UPDATE|DELETE)[^}]*\}"""),
    (".jsp", "sql_injection", "medium", r"""<%.*?String.*?sql.*?=.*?["'][^"']*(?:SELECT|INSERT|UPDATE|DELETE)[^"']*["'].*?\+.*?%>"""),
    (".xml", "sql_injection", "critical", r"""\$\{[^}]+\}"""),
    (".xml", "sql_injection", "high", r"""ORDER\s+BY\s+\$\{[^}]+\}"""),
    (".xml", "sql_injection", "critical", r"""FROM\s+\$\{[^}]+\}|JOIN\s+\$\{[^}]+\}"""),
    (".xml", "sql_injection", "critical", r"""<(?:select|insert|update|delete)[^>]*>\s*\$\{sql\}\s*</(?:select|insert|update|delete)>"""),
    (".jsp", "xss", "high", r"""<%=\s*[^%]*%>"""),
    (".jsp", "xss", "medium", r"""\$\{[^}]*\}"""),
    (".jsp", "xss", "high", r"""<script[^>]*>.*?<%[^%]*%>.*?</script>"""),
]


def first_match(text: Column, rules: list[tuple], other=None) -> Column:
    out = F
    for name, pattern in rules:
        out = out.when(text.rlike("(?i)" + pattern), F.lit(name))
    return out.otherwise(F.lit(other))


def first_sql(text: str, rules: list[tuple], other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '(?i){p}') THEN '{n}'" for n, p in rules) + f" ELSE {other} END"


def component_group(name: str | None, path: str) -> Column:
    by_path = first_match(F.col(path), COMPONENTS, OTHER)
    return by_path if name is None else F.coalesce(first_match(F.col(name), COMPONENTS), by_path)


def component_sql(*columns: str) -> str:
    return "coalesce(" + ", ".join(first_sql(c, COMPONENTS, "NULL") for c in columns) + f", '{OTHER}')"


def method_priority(name: str) -> Column:
    """1 is high: what does work comes before constructors, accessors come last."""
    n = F.col(name)
    return F.when(n.rlike("^[A-Z]"), 3).when(F.lower(name).rlike("^(get|set|is)"), 4).when(F.lower(name).rlike(BUSY) | (n == "main"), 1).otherwise(3)


def priority_sql() -> str:
    return f"CASE WHEN regexp_matches(n, '^[A-Z]') THEN 3 WHEN regexp_matches(low, '^(get|set|is)') THEN 4 WHEN regexp_matches(low, '{BUSY}') OR n = 'main' THEN 1 ELSE 3 END"


def base_priority(name: str) -> Column:
    out = F
    for pattern, p in PRIORITIES:
        out = out.when(F.col(name).rlike(pattern), p)
    return out.otherwise(UTILITY)


def base_priority_sql(name: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({name}, '{p}') THEN {k}" for p, k in PRIORITIES) + f" ELSE {UTILITY} END"


_METHODS, _LOOPS, _THROWS, _GENERICS, _BRANCHES = r"public\s+\w+\s+\w+\s*\(", r"\b(for|while|do)\b", r"\b(try|catch|throw)\b", r"<\w+>", r"\b(if|else|switch)\b"


def learning_points(text: str) -> Column:
    """Complexity of a text for a reader: lines, methods, loops, exceptions, generics, branches."""
    t = F.col(text)
    count = lambda p: F.size(F.regexp_extract_all(t, F.lit(p), F.lit(0)))
    lines, methods = F.size(F.split(t, "\n")), count(_METHODS)
    one = lambda c: F.when(c, 1).otherwise(0)
    return F.when(lines > 100, 3).when(lines > 50, 2).when(lines > 20, 1).otherwise(0) + F.when(methods > 10, 2).when(methods > 5, 1).otherwise(0) + one(t.rlike(_LOOPS)) + one(t.rlike(_THROWS)) + one(t.rlike(_GENERICS)) + one(count(_BRANCHES) > 5)


def learning_sql() -> str:
    n = "len(string_split(content, chr(10)))"
    k = lambda p: f"len(regexp_extract_all(content, '{p}'))"
    one = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"
    has = lambda p: one(f"regexp_matches(content, '{p}')")
    return f"CASE WHEN {n} > 100 THEN 3 WHEN {n} > 50 THEN 2 WHEN {n} > 20 THEN 1 ELSE 0 END + CASE WHEN {k(_METHODS)} > 10 THEN 2 WHEN {k(_METHODS)} > 5 THEN 1 ELSE 0 END + {has(_LOOPS)} + {has(_THROWS)} + {has(_GENERICS)} + {one(k(_BRANCHES) + ' > 5')}"


def matches(text: str, pattern: str) -> Column:
    """array<struct<text, line_no>> of a pattern's matches; the line is that on which each begins."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # a mark before each match cuts the text into pieces; line ends up to a mark give its line
    pieces = F.split(F.regexp_replace(text, pattern, "\u0001$0"), "\u0001")
    ends = F.transform(pieces, lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))))
    lines = F.transform(F.sequence(F.lit(1), F.size(found)), lambda i: F.aggregate(F.slice(ends, F.lit(1), i), F.lit(1), lambda a, x: a + x))
    some = F.transform(F.arrays_zip(found.alias("text"), lines.alias("line_no")), lambda z: F.struct(z["text"].alias("text"), z["line_no"].alias("line_no")))
    return F.when(F.size(found) > 0, some)


def scan(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Findings (key, line_no, kind, rule, severity, confidence in thousandths) of all rules; null texts have none.

    Matches run over whole texts and may span lines. Of several on a line of one kind the first rule
    counts, of one rule's the first text.
    """
    out = None
    for i, (ext, kind, severity, pattern) in enumerate(VULNERABILITIES, 1):
        x = df.where(F.col(path).endswith(ext) & F.col(text).rlike("(?is)" + pattern)).select(key, F.inline(matches(text, "(?is)" + pattern)))
        sure = F.least(F.lit(950), 700 + 5 * F.length("text")) if ext == ".jsp" and kind == "sql_injection" else F.when(F.col("text").contains("${"), 950).otherwise(800) if kind == "sql_injection" else F.lit(700)
        one = x.select(key, F.col("line_no").cast("int").alias("line_no"), F.lit(kind).alias("kind"), F.struct(F.lit(i).alias("rule"), "text", F.lit(severity).alias("severity"), sure.alias("confidence")).alias("f"))
        out = one if out is None else out.unionByName(one)
    first = out.groupBy(key, "line_no", "kind").agg(F.min("f").alias("f"))
    return first.select(key, "line_no", "kind", "f.rule", "f.severity", "f.confidence")
