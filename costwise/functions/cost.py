"""Weighted cost, ideal cost, efficiency, waste and dollars (Column builders)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from costwise.params import DEFAULT_WEIGHTS, TOKENS_PER_MILLION


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weighted_cost(
    input_tokens: str | Column, output_tokens: str | Column, weights=DEFAULT_WEIGHTS
) -> Column:
    w_in, w_out = weights
    return F.lit(float(w_in)) * _col(input_tokens) + F.lit(float(w_out)) * _col(output_tokens)


def efficiency(correct: str | Column, v_star: str | Column, cost: str | Column) -> Column:
    """V*/cost when correct (0.0 on non-positive cost), NULL when wrong."""
    c = _col(cost)
    return F.when(
        _col(correct), F.when(c <= 0, F.lit(0.0)).otherwise(_col(v_star) / c)
    )


def waste_ratio(cost: str | Column, v_star: str | Column) -> Column:
    """(cost - V*)/V*, 0.0 when V* is not positive."""
    v = _col(v_star)
    return F.when(v <= 0, F.lit(0.0)).otherwise((_col(cost) - v) / v)


def spend_units(
    input_tokens: str | Column,
    output_tokens: str | Column,
    price_in: str | Column,
    price_out: str | Column,
) -> Column:
    """Tokens times $/Mtok (divide by 1e6 once, after summing)."""
    return _col(input_tokens) * _col(price_in) + _col(output_tokens) * _col(price_out)


def to_dollars(units: str | Column) -> Column:
    return _col(units) / F.lit(TOKENS_PER_MILLION)


def compact_dollars(v: str | Column) -> Column:
    """Display form: 5 decimals below 10, grouped 2 decimals below 1e6, else exponent."""
    x = _col(v)
    return (
        F.when(x.isNull(), F.lit("n/a"))
        .when(x < 10, F.format_string("%.5f", x))
        .when(x < 1_000_000, F.format_number(x, 2))
        .otherwise(F.format_string("%.1e", x))
    )
