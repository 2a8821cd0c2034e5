"""Registered plans: stratified report, difficulty pivots, cost decomposition."""

from __future__ import annotations

from costwise.operators import reports as rep
from costwise.plans.common import R6, finish, plan


@plan(
    "stratified_report", "D1 F2",
    f"""
SELECT CAST(row_number() OVER (ORDER BY model, difficulty_bucket) AS INTEGER) AS position,
  model, difficulty_bucket, count(*) AS n,
  {R6('count(*) FILTER (WHERE terminal_correct) / count(*)')} AS accuracy,
  {R6('coalesce(avg(efficiency), CAST(0 AS DOUBLE))')} AS mean_efficiency_when_correct,
  {R6('count(*) FILTER (WHERE terminal_correct) / count(*) * coalesce(avg(efficiency), CAST(0 AS DOUBLE))')}
    AS expected_value_ratio,
  {R6('coalesce(stddev_samp(efficiency), CAST(0 AS DOUBLE))')} AS efficiency_stddev,
  {R6('avg(input_tokens)')} AS mean_input_tokens,
  {R6('avg(output_tokens)')} AS mean_output_tokens
FROM fx_results GROUP BY model, difficulty_bucket
""",
    "fx_results",
)
def stratified_report(fx):
    return finish(rep.ordered(rep.stratified_report(fx["fx_results"]), "model", "difficulty_bucket"))


def _pivot_sql(value: str, empty: str, with_prices: bool) -> str:
    join = "LEFT JOIN fx_prices p ON c.model = p.model" if with_prices else ""
    return f"""
WITH cells AS (
  SELECT model, difficulty_bucket, count(*) AS n,
    count(*) FILTER (WHERE terminal_correct) AS n_correct,
    avg(efficiency) AS mean_efficiency,
    CAST(sum(input_tokens) AS BIGINT) AS sum_in, CAST(sum(output_tokens) AS BIGINT) AS sum_out
  FROM fx_results GROUP BY model, difficulty_bucket)
SELECT c.model, c.difficulty_bucket, CAST(split_part(c.difficulty_bucket, '_d', 2) AS BIGINT) AS depth,
  CASE WHEN {empty} THEN NULL ELSE {R6(value)} END AS value,
  CASE WHEN {empty} THEN 'n/a' ELSE 'ok' END AS status
FROM cells c {join}
"""


@plan("pivot_accuracy", "D4 B12 F4", _pivot_sql("n_correct / n", "false", False), "fx_results")
def pivot_accuracy(fx):
    return finish(rep.pivot(fx["fx_results"], "accuracy"))


@plan(
    "pivot_efficiency", "D4 B12 F4",
    _pivot_sql("mean_efficiency", "mean_efficiency IS NULL", False),
    "fx_results",
)
def pivot_efficiency(fx):
    return finish(rep.pivot(fx["fx_results"], "efficiency"))


@plan(
    "pivot_cost", "C4 D4 B12 F4",
    _pivot_sql(
        "(CAST(sum_in AS DOUBLE) * p.price_in + CAST(sum_out AS DOUBLE) * p.price_out) / 1e6 / n_correct",
        "p.model IS NULL OR n_correct = 0",
        True,
    ),
    "fx_results", "fx_prices",
)
def pivot_cost(fx):
    return finish(rep.pivot(fx["fx_results"], "dollars_per_correct", prices=fx["fx_prices"]))


@plan(
    "cost_decomposition", "B12 D5",
    f"""
WITH d AS (
  SELECT model, CAST(output_tokens AS DOUBLE) AS y,
    CAST(coalesce(TRY_CAST(nullif(regexp_extract(difficulty_bucket, '([0-9]+)$', 1), '') AS BIGINT), 0) AS DOUBLE) AS x
  FROM fx_results)
SELECT model, {R6('regr_intercept(y, x)')} AS base_output_tokens, {R6('regr_slope(y, x)')} AS per_step_tokens,
  count(*) AS n,
  CASE WHEN regr_slope(y, x) IS NULL THEN 'needs >=2 depths' ELSE 'ok' END AS status
FROM d GROUP BY model
""",
    "fx_results",
)
def cost_decomposition(fx):
    return finish(rep.cost_decomposition(fx["fx_results"]))


def _comparison(fx):
    return rep.comparison(fx["fx_results"], fx["fx_prices"])


# D7 views share the oracles of the direct queries: one scan must give the same answers.
for _view, _direct in (("leaderboard", "leaderboard"), ("pivot_accuracy", "pivot_accuracy"),
                       ("pivot_efficiency", "pivot_efficiency"), ("pivot_cost", "pivot_cost"),
                       ("decomposition", "cost_decomposition")):
    def _build(fx, _view=_view):
        return finish(_comparison(fx)[_view])

    from costwise.plans.common import REGISTRY as _R, Plan as _P

    _R[f"comparison_{_view}"] = _P(f"comparison_{_view}", _build, _R[_direct].oracle, "D7")


@plan(
    "report_views", "D1 D2 D3 D4 D5 D7",
    f"""
WITH g AS (
  SELECT model, difficulty_bucket, grouping(difficulty_bucket) AS whole, count(*) AS n, count(*) FILTER (WHERE terminal_correct) AS n_correct,
    coalesce(avg(efficiency), CAST(0 AS DOUBLE)) AS eff, coalesce(stddev_samp(efficiency), CAST(0 AS DOUBLE)) AS sd,
    avg(input_tokens) AS mi, avg(output_tokens) AS mo, CAST(sum(input_tokens) AS DOUBLE) AS si, CAST(sum(output_tokens) AS DOUBLE) AS so,
    regr_intercept(output_tokens, depth) AS b0, regr_slope(output_tokens, depth) AS b1
  FROM fx_results GROUP BY GROUPING SETS ((model), (model, difficulty_bucket)))
SELECT CASE WHEN whole = 1 THEN 'model' ELSE 'cell' END AS view, g.model, difficulty_bucket, n, n_correct, {R6('n_correct / n')} AS accuracy,
  {R6('eff')} AS mean_efficiency_when_correct, {R6('n_correct / n * eff')} AS expected_value_ratio, {R6('sd')} AS efficiency_stddev,
  {R6('mi')} AS mean_input_tokens, {R6('mo')} AS mean_output_tokens,
  {R6('(si * price_in + so * price_out) / 1e6')} AS spend_dollars,
  {R6('CASE WHEN n_correct > 0 THEN (si * price_in + so * price_out) / 1e6 / n_correct END')} AS dollars_per_correct,
  {R6('CASE WHEN whole = 1 THEN b0 END')} AS base_output_tokens, {R6('CASE WHEN whole = 1 THEN b1 END')} AS per_step_tokens
FROM g LEFT JOIN fx_prices p ON p.model = g.model
""",
    "fx_results", "fx_prices",
)
def report_views(fx):
    return finish(rep.report_views(fx["fx_results"], fx["fx_prices"]))
