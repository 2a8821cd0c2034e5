"""Dollar economics over the results table.

Plan shape: the results table is reduced per model with a partial + final
hash aggregate (only counts and sums are shuffled, one row per model per map
task), and the price sheet is joined to that reduced table. Spend is linear,
so sum(in * p_in + out * p_out) = sum(in) * p_in + sum(out) * p_out; the
fact table is never joined with the sheet, whatever the sheet's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costwise.functions.cost import to_dollars, waste_ratio
from costwise.params import BETA, EFF_GATE, PER_TASKS
from costwise.sources.prices import attach_prices


def model_totals(results: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Counts and sums per key: n, n_correct, token sums, mean efficiency (over
    correct rows, S1), mean waste over correct rows, mean tokens."""
    correct = F.col("terminal_correct")
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(correct).alias("n_correct"),
        F.sum("input_tokens").alias("sum_input_tokens"),
        F.sum("output_tokens").alias("sum_output_tokens"),
        F.avg("efficiency").alias("_mean_eff"),
        F.avg(F.when(correct, waste_ratio("cost", "v_star"))).alias("mean_waste"),
        F.avg("input_tokens").alias("mean_input_tokens"),
        F.avg("output_tokens").alias("mean_output_tokens"),
    )


def _spend() -> Column:
    units = (
        F.col("sum_input_tokens").cast("double") * F.col("price_in")
        + F.col("sum_output_tokens").cast("double") * F.col("price_out")
    )
    return to_dollars(units)


def priced_totals(results: DataFrame, prices: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Per-key totals joined with the sheet: spend and $/correct (NULL when unpriced
    or nothing correct)."""
    return _priced(model_totals(results, keys), prices)


def _priced(totals: DataFrame, prices: DataFrame) -> DataFrame:
    totals = attach_prices(totals, prices)
    spend = F.when(F.col("priced"), _spend()).otherwise(F.lit(0.0))
    return (
        totals.withColumn("spend_dollars", spend)
        .withColumn(
            "dollars_per_correct",
            F.when(F.col("priced") & (F.col("n_correct") > 0),
                   F.col("spend_dollars") / F.col("n_correct")),
        )
        .withColumn("accuracy", F.col("n_correct") / F.col("n"))
        .withColumn("mean_efficiency", F.coalesce(F.col("_mean_eff"), F.lit(0.0)))
    )


def dollars_summary(results: DataFrame, prices: DataFrame) -> DataFrame:
    """Model, n, n_correct, accuracy, spend, $/correct, mean waste, priced."""
    t = priced_totals(results, prices)
    return t.select(
        "model", "n", "n_correct", "accuracy", "spend_dollars", "dollars_per_correct",
        F.col("mean_waste").alias("mean_waste_ratio"), "priced",
    )


def leaderboard(results: DataFrame, prices: DataFrame) -> DataFrame:
    """D3 + F1: one row per model ranked by $/correct, then models without a
    price (or without a correct answer) by accuracy x efficiency descending.

    ``status`` is 'unpriced' when $/correct is unavailable (S5); ties are
    broken by model name.
    """
    return _rank(priced_totals(results, prices))


def leaderboard_from_totals(totals: DataFrame, prices: DataFrame) -> DataFrame:
    """The leaderboard from already reduced per-model totals (see reports.comparison)."""
    return _rank(_priced(totals, prices))


def _rank(t: DataFrame) -> DataFrame:
    dpc = F.col("dollars_per_correct")
    evr = F.col("accuracy") * F.col("mean_efficiency")
    order = Window.orderBy(dpc.isNull(), F.when(dpc.isNull(), -evr).otherwise(dpc), F.col("model"))
    return t.select(
        "model", "n", "n_correct", "accuracy", "mean_efficiency", "dollars_per_correct",
        "mean_waste", "mean_output_tokens", "priced",
        F.when(dpc.isNull(), F.lit("unpriced")).otherwise(F.lit("ok")).alias("status"),
    ).withColumn("rank", F.row_number().over(order).cast("bigint"))


def business_view(
    results: DataFrame,
    prices: DataFrame,
    *,
    beta: float = BETA,
    eff_gate: float = EFF_GATE,
    per: int = PER_TASKS,
) -> DataFrame:
    """D6 + E2 + F5: risk-adjusted $/correct = $/correct / beta^(k^2), k = wrong
    normalised per ``per`` tasks. Only priced models. Rows with no correct answer
    or mean efficiency strictly below the gate go to the bottom tier with a
    reason; usable rows are ranked 1..m by risk."""
    t = priced_totals(results, prices).filter(F.col("priced"))
    n_wrong = F.col("n") - F.col("n_correct")
    k = n_wrong.cast("double") * F.lit(float(per)) / F.col("n")
    penalty = F.pow(F.lit(float(beta)), k * k)
    has_correct = F.col("n_correct") > 0
    risk = F.when(has_correct, F.when(penalty == 0, F.lit(float("inf"))).otherwise(
        F.col("dollars_per_correct") / penalty))
    eff = F.col("mean_efficiency")
    gated = has_correct & (eff < F.lit(float(eff_gate)))
    verdict = (
        F.when(~has_correct, F.concat(F.lit("no correct answers in "), F.col("n").cast("string")))
        .when(gated, F.concat(
            F.lit("gated: efficiency "), F.format_string("%.2f%%", eff * 100),
            F.lit(" below "), F.format_string("%.0f%%", F.lit(float(eff_gate)) * 100),
            F.lit(" floor (too slow/wasteful to wait for)")))
        .otherwise(F.lit(""))
    )
    out = t.select(
        "model", "n", "n_correct", n_wrong.alias("n_wrong"), "accuracy",
        "mean_efficiency", "spend_dollars", "dollars_per_correct",
        k.alias("k"), penalty.alias("penalty"), risk.alias("risk_adjusted"),
        gated.alias("gated"), verdict.alias("verdict"),
    ).withColumn("tier", F.when(F.col("verdict") == "", "usable").otherwise("bottom"))
    # Both windows run on the per-model table (one row per priced config).
    ranked = Window.partitionBy("tier").orderBy(F.col("risk_adjusted").asc_nulls_last(), "model")
    overall = Window.orderBy(F.col("tier").desc(), F.col("risk_adjusted").asc_nulls_last(), "model")
    return out.withColumn(
        "rank", F.when(F.col("tier") == "usable", F.row_number().over(ranked).cast("bigint"))
    ).withColumn("position", F.row_number().over(overall).cast("bigint"))


def reprice(results: DataFrame, sheets: DataFrame) -> DataFrame:
    """The same recorded token counts under every sheet (``sheet_id`` column).

    Per-model sums are computed once and fanned out over the sheets by the
    join on model, so adding a sheet costs one small join, not a rescan.
    """
    totals = model_totals(results)
    sheet_rows = sheets.select("sheet_id", "model", "price_in", "price_out")
    joined = totals.join(sheet_rows, "model", "inner")
    return joined.select(
        "sheet_id", "model", "n", "n_correct",
        _spend().alias("spend_dollars"),
        F.when(F.col("n_correct") > 0, _spend() / F.col("n_correct")).alias("dollars_per_correct"),
    )


def volume_price(business: DataFrame, workflows_per_month: int) -> DataFrame:
    """Monthly cost of a volume of trusted answers at the risk-adjusted price."""
    return business.select(
        "model", "tier", "risk_adjusted",
        (F.col("risk_adjusted") * F.lit(float(workflows_per_month))).alias("monthly_dollars"),
    )
