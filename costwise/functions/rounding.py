"""Reproducible rounding for reports that are compared across engines.

``round(x * 1e6) / 1e6`` is evaluated with the same IEEE operations in Spark
and in SQL engines, so identical inputs give bit-identical outputs. For values
spanning many magnitudes (risk-adjusted prices) significant digits are kept
instead of decimals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round6(x: str | Column) -> Column:
    c = _col(x)
    return F.round(c * F.lit(1e6)) / F.lit(1e6)


def round_sig(x: str | Column, digits: int = 9) -> Column:
    """Round to ``digits`` significant digits; 0, NULL, NaN and infinities pass through."""
    c = _col(x)
    finite = c.isNotNull() & (c != 0) & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    safe = F.when(finite, F.abs(c)).otherwise(F.lit(1.0))
    d = F.lit(digits - 1) - F.floor(F.log10(safe))
    p = F.concat(F.lit("1e"), F.abs(d).cast("string")).cast("double")
    scaled = F.when(d >= 0, c * p).otherwise(c / p)
    r = F.round(scaled)
    return F.when(finite, F.when(d >= 0, r / p).otherwise(r * p)).otherwise(c)


# SQL text of the same rounding, for oracles.
def sql_round6(expr: str) -> str:
    return f"(round(({expr}) * 1e6) / 1e6)"


def sql_round_sig(expr: str, digits: int = 9) -> str:
    x = f"({expr})"
    d = f"({digits - 1} - floor(log10(abs({x}))))"
    p = f"CAST('1e' || CAST(CAST(abs({d}) AS BIGINT) AS VARCHAR) AS DOUBLE)"
    return (
        f"(CASE WHEN {x} IS NULL OR {x} = 0 OR isnan({x}) OR isinf({x}) THEN {x} "
        f"WHEN {d} >= 0 THEN round({x} * {p}) / {p} ELSE round({x} / {p}) * {p} END)"
    )
