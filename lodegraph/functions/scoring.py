"""Scoring models as column expressions; weights are fixed values, given in the comments' order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _tiers(x: Column, tiers: list[tuple[float, float]], other: float) -> Column:
    out = F
    for at, score in tiers:
        out = out.when(x >= at, score)
    return out.otherwise(other)


def ast_score(success, complete, partial, fallback, seconds, elements) -> Column:
    """0 unless parsed; base, completeness, fallback, time and number of elements."""
    s = F.lit(0.3) + F.when(_c(complete), 0.5).when(_c(partial), 0.3).otherwise(0.0) - F.when(_c(fallback), 0.2).otherwise(0.0)
    s = s + F.when(_c(seconds) < 1, 0.1).when(_c(seconds) > 10, -0.1).otherwise(0.0) + F.least(F.lit(0.1), _c(elements) * 0.01)
    return F.when(_c(success), clamp(s, 0.0, 1.0)).otherwise(0.0)


def static_score(matched, total) -> Column:
    return F.when(_c(total) == 0, 0.5).otherwise(_tiers(F.try_divide(_c(matched).cast("double"), _c(total)), [(0.9, 1.0), (0.7, 0.8), (0.3, 0.4)], 0.2))


def catalog_score(matched, total, has_catalog) -> Column:
    return F.when(_c(total) == 0, 0.5).when(~_c(has_catalog), 0.2).otherwise(_tiers(F.try_divide(_c(matched).cast("double"), _c(total)), [(0.95, 1.0), (0.8, 0.85), (0.6, 0.7), (0.4, 0.55)], 0.3))


def heuristic_score(language, elements, parser) -> Column:
    return clamp(
        F.lit(0.5) + F.when(_c(language).isin("java", "xml") & (_c(elements) > 0), 0.2).otherwise(0.0) + F.when(_c(parser) == "tree_sitter", 0.1).when(_c(parser) == "antlr", 0.15).when(_c(parser) == "regex", -0.2).otherwise(0.0),
        0.0, 1.0,
    )


def complexity_penalty(dynamic_sql, reflection, expressions, nesting) -> Column:
    return F.when(_c(dynamic_sql), 0.15).otherwise(0.0) + F.when(_c(reflection), 0.25).otherwise(0.0) + 0.05 * _c(expressions) + 0.03 * _c(nesting)


def parsing_confidence(ast, static, catalog, heuristic, penalty) -> Column:
    return clamp(0.4 * _c(ast) + 0.3 * _c(static) + 0.2 * _c(catalog) + 0.1 * _c(heuristic) - _c(penalty), 0.1, 1.0)


def join_confidence(explicit, in_where, equality, tables_known, columns_known, dynamic, key_pair) -> Column:
    s = F.lit(0.3) + F.when(_c(explicit), 0.4).when(_c(in_where), 0.2).otherwise(0.0) + F.when(_c(equality), 0.2).otherwise(-0.1)
    s = s + F.when(_c(tables_known), 0.15).otherwise(-0.2) + F.when(_c(columns_known), 0.15).otherwise(-0.2) - F.when(_c(dynamic), 0.3).otherwise(0.0) + F.when(_c(key_pair), 0.2).otherwise(0.0)
    return clamp(s, 0.0, 1.0)


def filter_confidence(always, constant, parameter, operator, qualified) -> Column:
    s = F.lit(0.4) + F.when(_c(always), 0.3).otherwise(-0.1) + F.when(_c(constant), 0.2).when(_c(parameter), 0.1).otherwise(-0.15)
    s = s + F.when(_c(operator) == "=", 0.15).when(_c(operator).isin("IN", "BETWEEN"), 0.1).otherwise(-0.05) + F.when(_c(qualified), 0.15).otherwise(-0.1)
    return clamp(s, 0.0, 1.0)


def enriched(confidence, llm, model, evidence) -> Column:
    q = _c(llm) * _c(model) * _c(evidence)
    delta = F.when(q > 0.5, F.least(F.lit(0.3), (q - 0.5) * 0.6)).otherwise(F.greatest(F.lit(-0.2), (q - 0.5) * 0.4))
    return clamp(_c(confidence) + delta, 0.0, 1.0)


def hotspot(loc, complexity) -> Column:
    """Bin by lines, raised where complexity is high."""
    base = F.when(_c(loc) <= 100, "low").when(_c(loc) <= 300, "med").when(_c(loc) <= 800, "high").otherwise("crit")
    return F.when((_c(complexity) >= 20) & base.isin("low", "med"), "high").otherwise(base)


def heat(complexity, loc, frequency) -> Column:
    return 0.4 * _c(complexity) + 0.3 * _c(loc) + 0.3 * _c(frequency)


def heat_level(score) -> Column:
    return F.when(_c(score) >= 0.8, "critical").when(_c(score) >= 0.6, "hot").when(_c(score) >= 0.4, "warm").otherwise("cool")


def centrality(incoming, outgoing, public) -> Column:
    return 2 * _c(incoming) + _c(outgoing) + F.when(_c(public), 2).otherwise(0)


def completeness_status(score) -> Column:
    return F.when(_c(score) >= 0.9, "excellent").when(_c(score) >= 0.7, "good").when(_c(score) >= 0.5, "fair").otherwise("poor")


def density(edges, nodes) -> Column:
    e, n = _c(edges).cast("double"), _c(nodes)
    return F.coalesce(F.try_divide(e, n * (n - 1) / 2), F.lit(0.0))
