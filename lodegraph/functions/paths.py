"""Column functions over file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path) -> Column:
    return F.regexp_extract(path, "([^/]+)$", 1)


def dirname(path) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def stem(path) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def layer(path) -> Column:
    """Layer by path, first match wins."""
    p = F.col(path)
    out = F
    for part, name in (("/controller/", "controller"), ("/service/", "service"), ("/mapper/", "mapper")):
        out = out.when(p.contains(part), name)
    return out.when(p.endswith(".jsp"), "view").otherwise("other")
