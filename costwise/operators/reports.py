"""Stratified report, difficulty pivots, cost decomposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costwise.functions.buckets import depth_from_bucket
from costwise.functions.cost import to_dollars
from costwise.sources.prices import attach_prices


def stratified_report(results: DataFrame) -> DataFrame:
    """Per (model, difficulty_bucket) n, accuracy, mean efficiency on correct
    rows (0.0 when none), EVR = accuracy x mean efficiency, sample stddev of
    efficiency (0.0 below two values), mean input / output tokens."""
    eff = F.coalesce(F.avg("efficiency"), F.lit(0.0))
    acc = F.count_if("terminal_correct") / F.count(F.lit(1))
    return results.groupBy("model", "difficulty_bucket").agg(
        F.count(F.lit(1)).alias("n"),
        acc.alias("accuracy"),
        eff.alias("mean_efficiency_when_correct"),
        (acc * eff).alias("expected_value_ratio"),
        F.coalesce(F.stddev_samp("efficiency"), F.lit(0.0)).alias("efficiency_stddev"),
        F.avg("input_tokens").alias("mean_input_tokens"),
        F.avg("output_tokens").alias("mean_output_tokens"),
    )


def ordered(report: DataFrame, *keys: str) -> DataFrame:
    """``position`` of each row of a reduced report in the order of its keys."""
    return report.select(F.row_number().over(Window.orderBy(*keys)).alias("position"), "*")


def cell_totals(results: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Per (model, bucket) counts and sums; with a sheet also spend per cell."""
    cells = results.groupBy("model", "difficulty_bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("terminal_correct").alias("n_correct"),
        F.avg("efficiency").alias("mean_efficiency"),
        F.sum("input_tokens").alias("sum_input_tokens"),
        F.sum("output_tokens").alias("sum_output_tokens"),
    )
    if prices is None:
        return cells
    cells = attach_prices(cells, prices)
    units = (F.col("sum_input_tokens").cast("double") * F.col("price_in")
             + F.col("sum_output_tokens").cast("double") * F.col("price_out"))
    return cells.withColumn("spend_dollars", F.when(F.col("priced"), to_dollars(units)))


def _cells_of(cells: DataFrame, metric: str) -> DataFrame:
    """Long cells of one metric: model, bucket, depth (its place in the header), value, status."""
    if metric == "accuracy":
        value, empty = F.col("n_correct") / F.col("n"), F.lit(False)
    elif metric == "efficiency":
        value, empty = F.col("mean_efficiency"), F.col("mean_efficiency").isNull()
    elif metric == "dollars_per_correct":
        value = F.col("spend_dollars") / F.col("n_correct")
        empty = ~F.col("priced") | (F.col("n_correct") == 0)
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return cells.select(
        "model", "difficulty_bucket", depth_from_bucket("difficulty_bucket").alias("depth"),
        F.when(~empty, value).alias("value"), F.when(empty, F.lit("n/a")).otherwise(F.lit("ok")).alias("status"),
    )


def pivot(
    results: DataFrame,
    metric: str,
    prices: DataFrame | None = None,
    buckets: Sequence[str] | None = None,
) -> DataFrame:
    """``accuracy``, ``efficiency`` or ``dollars_per_correct`` by model and bucket.

    One row per cell that has results: model, difficulty_bucket, depth (F4: a
    header is ordered by depth, then label), value, status ('ok', or 'n/a' with a
    NULL value where the metric is empty). A caller that knows its buckets gets
    them as columns of values; a cell without results is NULL there, as in the
    long form it has no row."""
    if metric == "dollars_per_correct" and prices is None:
        raise ValueError("dollars_per_correct needs a price sheet")
    long = _cells_of(cell_totals(results, prices if metric == "dollars_per_correct" else None), metric)
    return long if buckets is None else _widen(long, buckets)


def cost_decomposition(results: DataFrame) -> DataFrame:
    """Least squares output_tokens ~ base + rate x depth per model; depth is
    the trailing integer of the bucket. Fewer than two distinct depths leaves
    base and rate NULL with status 'needs >=2 depths'."""
    depth = depth_from_bucket("difficulty_bucket").cast("double")
    y = F.col("output_tokens").cast("double")
    out = results.groupBy("model").agg(
        F.regr_intercept(y, depth).alias("base_output_tokens"),
        F.regr_slope(y, depth).alias("per_step_tokens"),
        F.count(F.lit(1)).alias("n"),
    )
    return out.withColumn(
        "status", F.when(F.col("per_step_tokens").isNull(), F.lit("needs >=2 depths")).otherwise("ok")
    )


def report_views(results: DataFrame, prices: DataFrame) -> DataFrame:
    """D1, D2, D3, D4, D5, D7 from one scan and one aggregation (GROUPING SETS).

    ``view`` is ``model`` (one row per model: leaderboard, dollars, cost against depth) or ``cell`` (one row per model
    and bucket: stratified report and pivots). Both sets are aggregated map-side; the sheet is joined to the result."""
    depth, correct = depth_from_bucket("difficulty_bucket").cast("double"), F.col("terminal_correct")
    y = F.col("output_tokens").cast("double")
    whole = F.grouping("difficulty_bucket") == 1
    sums = results.groupingSets([["model"], ["model", "difficulty_bucket"]], "model", "difficulty_bucket").agg(
        F.when(whole, "model").otherwise("cell").alias("view"),
        F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("n_correct"),
        F.sum("efficiency").alias("sum_efficiency"), F.count("efficiency").alias("n_efficiency"),
        F.coalesce(F.stddev_samp("efficiency"), F.lit(0.0)).alias("efficiency_stddev"),
        F.sum("input_tokens").alias("sum_input_tokens"), F.sum("output_tokens").alias("sum_output_tokens"),
        F.when(whole, F.regr_intercept(y, depth)).alias("base_output_tokens"),
        F.when(whole, F.regr_slope(y, depth)).alias("per_step_tokens"),
    )
    priced = attach_prices(sums, prices)
    units = (F.col("sum_input_tokens").cast("double") * F.col("price_in")
             + F.col("sum_output_tokens").cast("double") * F.col("price_out"))
    spend = F.when(F.col("priced"), to_dollars(units))
    accuracy = F.col("n_correct") / F.col("n")
    efficiency = F.when(F.col("n_efficiency") > 0, F.col("sum_efficiency") / F.col("n_efficiency")).otherwise(F.lit(0.0))
    return priced.select(
        "view", "model", "difficulty_bucket", "n", "n_correct", accuracy.alias("accuracy"),
        efficiency.alias("mean_efficiency_when_correct"), (accuracy * efficiency).alias("expected_value_ratio"), "efficiency_stddev",
        (F.col("sum_input_tokens") / F.col("n")).alias("mean_input_tokens"),
        (F.col("sum_output_tokens") / F.col("n")).alias("mean_output_tokens"),
        spend.alias("spend_dollars"), F.when(F.col("n_correct") > 0, spend / F.col("n_correct")).alias("dollars_per_correct"),
        "base_output_tokens", "per_step_tokens",
    )


def comparison(results: DataFrame, prices: DataFrame) -> dict[str, DataFrame]:
    """Leaderboard, pivots and cost decomposition over one reduced table.

    Every view is a lazy aggregate of the per (model, bucket) sums and counts
    (means are recomputed from sums, never averaged), so a caller that wants all
    views writes or caches ``cells`` and builds the views on that."""
    from costwise.functions.cost import waste_ratio

    correct = F.col("terminal_correct")
    cells = results.groupBy("model", "difficulty_bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(correct).alias("n_correct"),
        F.sum("input_tokens").alias("sum_input_tokens"),
        F.sum("output_tokens").alias("sum_output_tokens"),
        F.sum("efficiency").alias("sum_efficiency"),
        F.count("efficiency").alias("n_efficiency"),
        F.sum(F.when(correct, waste_ratio("cost", "v_star"))).alias("sum_waste"),
    ).withColumn("depth", depth_from_bucket("difficulty_bucket").cast("double"))
    return comparison_views(cells, prices)


def comparison_views(cells: DataFrame, prices: DataFrame) -> dict[str, DataFrame]:
    """The views of ``comparison`` on its cell table."""
    from costwise.operators.economics import leaderboard_from_totals

    per_model = cells.groupBy("model").agg(
        F.sum("n").alias("n"), F.sum("n_correct").alias("n_correct"),
        F.sum("sum_input_tokens").alias("sum_input_tokens"),
        F.sum("sum_output_tokens").alias("sum_output_tokens"),
        (F.sum("sum_efficiency") / F.sum("n_efficiency")).alias("_mean_eff"),
        (F.sum("sum_waste") / F.sum("n_correct")).alias("mean_waste"),
        (F.sum("sum_input_tokens") / F.sum("n")).alias("mean_input_tokens"),
        (F.sum("sum_output_tokens") / F.sum("n")).alias("mean_output_tokens"),
        # least squares from grouped sums (depth is constant within a bucket)
        F.sum(F.col("n") * F.col("depth")).alias("sx"),
        F.sum(F.col("n") * F.col("depth") * F.col("depth")).alias("sxx"),
        F.sum(F.col("depth") * F.col("sum_output_tokens")).alias("sxy"),
    )
    n = F.col("n").cast("double")
    var_x = F.col("sxx") - F.col("sx") * F.col("sx") / n
    cov = F.col("sxy") - F.col("sx") * F.col("sum_output_tokens") / n
    slope = F.when(var_x > 0, cov / var_x)
    decomposition = per_model.select(
        "model",
        (F.col("sum_output_tokens") / n - slope * F.col("sx") / n).alias("base_output_tokens"),
        slope.alias("per_step_tokens"), "n",
        F.when(slope.isNull(), F.lit("needs >=2 depths")).otherwise("ok").alias("status"),
    )
    units = (F.col("sum_input_tokens").cast("double") * F.col("price_in")
             + F.col("sum_output_tokens").cast("double") * F.col("price_out"))
    means = cells.withColumn(
        "mean_efficiency", F.when(F.col("n_efficiency") > 0, F.col("sum_efficiency") / F.col("n_efficiency")))
    priced = attach_prices(means, prices).withColumn("spend_dollars", F.when(F.col("priced"), to_dollars(units)))
    return {
        "cells": cells,
        "leaderboard": leaderboard_from_totals(per_model, prices),
        "decomposition": decomposition,
        "pivot_accuracy": _cells_of(means, "accuracy"),
        "pivot_efficiency": _cells_of(means, "efficiency"),
        "pivot_cost": _cells_of(priced, "dollars_per_correct"),
    }


def _widen(long: DataFrame, buckets: Sequence[str]) -> DataFrame:
    return long.groupBy("model").pivot("difficulty_bucket", list(buckets)).agg(F.first("value"))
