"""Difficulty buckets and depth (Column builders)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from costwise.functions import patterns as P


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def difficulty_bucket(parameters_json: str | Column, nodes: str | Column) -> Column:
    """``parameters.bucket`` when it is a non-empty JSON string, else ``depth_<#nodes>``.

    The parameters are a VARIANT (as tasks are read) or JSON text."""
    v = F.try_parse_json(_col(parameters_json).cast("string"))
    raw = F.try_variant_get(v, "$.bucket", "variant")
    explicit = F.when(
        F.schema_of_variant(raw) == F.lit("STRING"), F.try_variant_get(v, "$.bucket", "string")
    )
    return F.coalesce(
        F.nullif(explicit, F.lit("")),
        F.concat(F.lit("depth_"), F.size(_col(nodes)).cast("string")),
    )


def depth_from_bucket(bucket: str | Column) -> Column:
    """Trailing integer of a bucket label (``hybrid_d12`` -> 12), 0 if none."""
    digits = F.nullif(F.regexp_extract(_col(bucket), P.TRAILING_INT, 1), F.lit(""))
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def depth_from_parameters(parameters_json: str | Column) -> Column:
    """``parameters.recipe.per_segment_difficulty.depth`` of a ladder task."""
    return F.try_variant_get(
        F.try_parse_json(_col(parameters_json).cast("string")),
        "$.recipe.per_segment_difficulty.depth",
        "bigint",
    )
