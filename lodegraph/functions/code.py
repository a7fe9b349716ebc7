"""Column functions over source text: lines, tokens, nesting, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def loc(text) -> Column:
    """Lines as splitlines counts them: a final line end opens no new line."""
    t = _c(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, "\n")) - F.when(t.endswith("\n"), 1).otherwise(0))


def token_count(text) -> Column:
    """Words between blanks; none in a blank text."""
    t = F.regexp_replace(_c(text), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"[ \t\r\n]+")))


def max_nesting(text) -> Column:
    """Deepest nesting of braces; closing braces never take the level below zero."""
    braces = F.split(F.regexp_replace(_c(text), r"[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("top"))

    def step(acc, ch):
        cur = F.when(ch == "{", acc["cur"] + 1).when(ch == "}", F.greatest(acc["cur"] - 1, F.lit(0))).otherwise(acc["cur"])
        return F.struct(cur.alias("cur"), F.greatest(acc["top"], cur).alias("top"))

    return F.aggregate(braces, start, step, lambda acc: acc["top"])


def count_of(text, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(0)))


def comments(text) -> Column:
    return count_of(text, r"//[^\n]*") + count_of(text, r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/")


def suffix_stripped(name) -> Column:
    return F.regexp_replace(_c(name), "(Service|Controller|Repository|DAO|DTO|VO|Impl|Test)$", "")


def summary_kind(name) -> Column:
    """Heuristic kind of a method by its name."""
    n = _c(name)
    return F.when(n.isin("toString", "equals", "hashCode"), "object").when(n.startswith("get"), "getter").when(n.startswith("set"), "setter").when(n.startswith("is"), "predicate").otherwise("other")


def controller_of(url) -> Column:
    """Controller a URL's first segment stands for; the rest of the segment in lower case."""
    part = F.lower(F.split_part(F.regexp_replace(_c(url), "^/+", ""), F.lit("/"), F.lit(1)))
    part = F.regexp_replace(part, r"\..*$", "")
    return F.concat(F.upper(F.substring(part, 1, 1)), F.substring(part, 2, 1000), F.lit("Controller"))


def fk_column(name) -> Column:
    return F.lower(_c(name)).rlike("_id$|^id_|^fk_|_fk$")


def fk_target(name) -> Column:
    return F.concat(F.regexp_replace(F.lower(_c(name)), "_id$|^id_|^fk_|_fk$", ""), F.lit("s"))


def abbreviations(name) -> Column:
    """Short forms a table may go by: first letter, initials, prefixes, singular and the full name."""
    n = F.upper(_c(name))
    initials = F.array_join(F.transform(F.split(n, "_"), lambda p: F.substring(p, 1, 1)), "")
    return F.array_distinct(F.array(F.substring(n, 1, 1), initials, F.substring(n, 1, 3), F.substring(n, 1, 4), F.regexp_replace(n, "S$", ""), n))
