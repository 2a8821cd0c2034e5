"""Running totals within groups of any size, and joins against counted keys.

A group may hold most of the rows, so no task is given a whole group: rows are dealt out by ranges of
(group, order), totals run inside each (range, group), and what stands in earlier ranges is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costwise.llm.storage import salt_count, stored

#: Keys with more rows than the total over this number are fewer than this number: a list of them can be broadcast.
HEAVY = 10_000


def running_totals(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """The rows with, for each name in ``sums``, the total over the rows before it in its group.

    ``order`` is ascending without nulls and differs between the rows of a group."""
    dealt = stored(
        rows.withColumns({f"own_{k}": v for k, v in sums.items()})
        .repartitionByRange(salt_count(rows), *group, *order)
        .withColumn("part", F.spark_partition_id()),
        "ordered",
    )
    inside = Window.partitionBy("part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(f"own_{k}").over(inside), F.lit(0).cast("long")).alias(k) for k in sums])
    across = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy("part", *group)
        .agg(*[F.sum(f"own_{k}").alias(f"own_{k}") for k in sums])
        .select("part", *group, *[F.sum(f"own_{k}").over(across).alias(f"before_{k}") for k in sums])
        .dropna(subset=[f"before_{k}" for k in sums], how="all")
    )
    # at most one group goes on from one range to the next, so there are fewer rows than ranges
    joined = local.join(F.broadcast(before), ["part", *group], "left")
    return joined.select(
        *rows.columns, *[(F.col(k) + F.coalesce(f"before_{k}", F.lit(0).cast("long"))).alias(k) for k in sums]
    )


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``keyed``, a stored table with one row for each key and the number of ``rows`` of that key.

    Rows of the heaviest keys (fewer than ``HEAVY``) stay where they are and meet a broadcast; the others are shuffled,
    and none of their keys has more than that share of all rows."""
    total = keyed.agg(F.sum(count)).first()[0] or 0
    heavy = keyed.filter(F.col(count) > max(1000, total // HEAVY))
    rest = keyed.filter(F.col(count) <= max(1000, total // HEAVY))
    near = rows.join(F.broadcast(heavy), on, "inner")
    away = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(rest, on, how)
    return near.unionByName(away)
