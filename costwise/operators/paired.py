"""Paired depth-ladder analysis: rung comparisons, flips, persistent failures,
prefix growth (C8, D17, E3, E4, K14).

Results are first reduced to one cell per (model, group, rung); the windows
partition that reduced table by (model, group), so a window partition holds
one row per rung (bounded by the ladder length) however many rows the fact
table has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rung_cells(results: DataFrame, group_col: str = "group_seed") -> DataFrame:
    """One row per (model, group, depth): n, n_correct, cell_correct (all correct)."""
    return results.groupBy("model", group_col, "depth").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("terminal_correct").alias("n_correct"),
    ).withColumn("cell_correct", F.col("n_correct") == F.col("n"))


def paired_flips(results: DataFrame, group_col: str = "group_seed") -> DataFrame:
    """E3 + C8: each rung against the previous, the base (shallowest) and the
    deepest rung of the same group."""
    cells = rung_cells(results, group_col)
    by_depth = Window.partitionBy("model", group_col).orderBy("depth")
    whole = by_depth.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prev = F.lag("cell_correct").over(by_depth)
    return cells.select(
        "model", group_col, "depth", "n", "n_correct", "cell_correct",
        prev.alias("prev_correct"),
        F.coalesce(prev != F.col("cell_correct"), F.lit(False)).alias("flipped"),
        F.first("cell_correct").over(whole).alias("base_correct"),
        F.last("cell_correct").over(whole).alias("deepest_correct"),
    )


def persistent_failures(results: DataFrame, group_col: str = "group_seed") -> DataFrame:
    """Per (model, group): failing at every rung (persistent), failing at some
    (transient) or never (clean), with the number of outcome flips along depth."""
    flips = paired_flips(results, group_col)
    g = flips.groupBy("model", group_col).agg(
        F.count(F.lit(1)).alias("n_rungs"),
        F.count_if(~F.col("cell_correct")).alias("n_failed_rungs"),
        F.count_if("flipped").alias("n_flips"),
    )
    status = (
        F.when(F.col("n_failed_rungs") == F.col("n_rungs"), F.lit("persistent"))
        .when(F.col("n_failed_rungs") > 0, F.lit("transient"))
        .otherwise(F.lit("clean"))
    )
    return g.withColumn("status", status)


def prefix_growth(tasks: DataFrame, group_col: str = "group_seed", extra: list[str] | None = None) -> DataFrame:
    """Within a group, the op list at rung d is the prefix of the
    deepest rung's list and the prompt grows strictly with depth.

    ``tasks`` carries (group, depth, ops array, merged_prompt)."""
    by_depth = Window.partitionBy(group_col).orderBy("depth")
    whole = by_depth.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    deepest_ops = F.last("ops").over(whole)
    prev_len = F.lag(F.length("merged_prompt")).over(by_depth)
    return tasks.select(
        group_col, "depth", *(extra or []),
        (F.slice(deepest_ops, 1, F.size("ops")) == F.col("ops")).alias("is_prefix"),
        F.coalesce(F.length("merged_prompt") > prev_len, F.lit(True)).alias("prompt_grows"),
    )
