"""Helpers shared by the registered plans and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costwise.functions.rounding import round6, round_sig, sql_round6, sql_round_sig
from costwise.sources.fixtures import Fixtures, with_fixtures


@dataclass(frozen=True)
class Plan:
    name: str
    build: Callable[[Fixtures], DataFrame]
    oracle: str | None
    ops: str = ""

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Fixtures(spark, sf_dir))


REGISTRY: dict[str, Plan] = {}


def plan(name: str, ops: str, oracle: str | None, *fixtures: str):
    """Register a plan; ``oracle`` is DuckDB SQL over the named fixture views."""

    def deco(fn: Callable[[Fixtures], DataFrame]):
        sql = with_fixtures(oracle, *fixtures) if (oracle and fixtures) else oracle
        REGISTRY[name] = Plan(name, fn, sql, ops)
        return fn

    return deco


def finish(df: DataFrame, sig: Iterable[str] = ()) -> DataFrame:
    """Round every DOUBLE column reproducibly (decimals, or significant digits
    for the columns in ``sig``) so results compare bit-for-bit across engines."""
    sig = set(sig)
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            fn = round_sig if f.name in sig else round6
            cols.append(fn(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


R6 = sql_round6
RSIG = sql_round_sig
