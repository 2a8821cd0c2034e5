"""Registered plans: dollar economics, leaderboard, business view, repricing."""

from __future__ import annotations

from costwise.operators import economics as econ
from costwise.plans.common import R6, RSIG, finish, plan

# Per-model totals, shared by the SQL oracles below (same algebra as
# operators.economics.model_totals + the sheet join on the reduced table).
TOTALS_SQL = """
totals AS (
  SELECT model, count(*) AS n,
    count(*) FILTER (WHERE terminal_correct) AS n_correct,
    CAST(sum(input_tokens) AS BIGINT) AS sum_in, CAST(sum(output_tokens) AS BIGINT) AS sum_out,
    avg(efficiency) AS mean_eff_raw,
    avg(CASE WHEN terminal_correct THEN
          CASE WHEN v_star <= 0 THEN CAST(0 AS DOUBLE) ELSE (cost - v_star) / v_star END END) AS mean_waste,
    avg(output_tokens) AS mean_output_tokens
  FROM fx_results GROUP BY model),
priced AS (
  SELECT t.*, p.price_in, p.price_out, p.model IS NOT NULL AS priced,
    CASE WHEN p.model IS NOT NULL
         THEN (CAST(sum_in AS DOUBLE) * p.price_in + CAST(sum_out AS DOUBLE) * p.price_out) / 1e6
         ELSE CAST(0 AS DOUBLE) END AS spend_dollars,
    n_correct / n AS accuracy,
    coalesce(mean_eff_raw, CAST(0 AS DOUBLE)) AS mean_efficiency
  FROM totals t LEFT JOIN fx_prices p ON t.model = p.model),
priced2 AS (
  SELECT *, CASE WHEN priced AND n_correct > 0 THEN spend_dollars / n_correct END AS dollars_per_correct
  FROM priced)
"""


@plan(
    "leaderboard", "C4 B6 B7 D3 F1",
    f"""
WITH {TOTALS_SQL}
SELECT model, n, n_correct, {R6('accuracy')} AS accuracy, {R6('mean_efficiency')} AS mean_efficiency,
  {R6('dollars_per_correct')} AS dollars_per_correct, {R6('mean_waste')} AS mean_waste,
  {R6('mean_output_tokens')} AS mean_output_tokens, priced,
  CASE WHEN dollars_per_correct IS NULL THEN 'unpriced' ELSE 'ok' END AS status,
  row_number() OVER (ORDER BY dollars_per_correct IS NULL,
     CASE WHEN dollars_per_correct IS NULL THEN -(accuracy * mean_efficiency) ELSE dollars_per_correct END,
     model) AS rank
FROM priced2
""",
    "fx_results", "fx_prices",
)
def leaderboard(fx):
    return finish(econ.leaderboard(fx["fx_results"], fx["fx_prices"]))


@plan(
    "dollars_summary", "C4 D2",
    f"""
WITH {TOTALS_SQL}
SELECT model, n, n_correct, {R6('accuracy')} AS accuracy, {R6('spend_dollars')} AS spend_dollars,
  {R6('dollars_per_correct')} AS dollars_per_correct, {R6('mean_waste')} AS mean_waste_ratio, priced
FROM priced2
""",
    "fx_results", "fx_prices",
)
def dollars_summary(fx):
    return finish(econ.dollars_summary(fx["fx_results"], fx["fx_prices"]))


def _business_ctes(gate: float, beta: float = 0.8, per: int = 20) -> str:
    return f"""
WITH {TOTALS_SQL},
b AS (
  SELECT model, n, n_correct, n - n_correct AS n_wrong, accuracy, mean_efficiency, spend_dollars,
    dollars_per_correct,
    CAST(n - n_correct AS DOUBLE) * CAST({per} AS DOUBLE) / n AS k
  FROM priced2 WHERE priced),
c AS (
  SELECT *, pow(CAST({beta} AS DOUBLE), k * k) AS penalty FROM b),
d AS (
  SELECT *,
    CASE WHEN n_correct > 0 THEN
      CASE WHEN penalty = 0 THEN CAST('inf' AS DOUBLE) ELSE dollars_per_correct / penalty END END AS risk_adjusted,
    n_correct > 0 AND mean_efficiency < CAST({gate} AS DOUBLE) AS gated
  FROM c),
e AS (
  SELECT *,
    CASE WHEN n_correct = 0 THEN 'no correct answers in ' || CAST(n AS VARCHAR)
         WHEN gated THEN 'gated: efficiency ' || printf('%.2f%%', mean_efficiency * 100) || ' below '
              || printf('%.0f%%', CAST({gate} AS DOUBLE) * 100) || ' floor (too slow/wasteful to wait for)'
         ELSE '' END AS verdict
  FROM d),
f AS (SELECT *, CASE WHEN verdict = '' THEN 'usable' ELSE 'bottom' END AS tier FROM e)
"""


def _business_sql(gate: float) -> str:
    return _business_ctes(gate) + f"""
SELECT model, n, n_correct, n_wrong, {R6('accuracy')} AS accuracy, {R6('mean_efficiency')} AS mean_efficiency,
  {R6('spend_dollars')} AS spend_dollars, {R6('dollars_per_correct')} AS dollars_per_correct,
  {R6('k')} AS k, {RSIG('penalty')} AS penalty, {RSIG('risk_adjusted')} AS risk_adjusted,
  gated, verdict, tier,
  CASE WHEN tier = 'usable' THEN row_number() OVER (PARTITION BY tier ORDER BY risk_adjusted ASC NULLS LAST, model) END AS rank,
  row_number() OVER (ORDER BY tier DESC, risk_adjusted ASC NULLS LAST, model) AS position
FROM f
"""


@plan("business_view", "C5 D6 E2 F5", _business_sql(0.05), "fx_results", "fx_prices")
def business_view(fx):
    return finish(econ.business_view(fx["fx_results"], fx["fx_prices"]),
                  sig=("penalty", "risk_adjusted"))


@plan("business_view_gate15", "C5 D6 E2 F5 (gate 0.15)", _business_sql(0.15), "fx_results", "fx_prices")
def business_view_gate15(fx):
    return finish(econ.business_view(fx["fx_results"], fx["fx_prices"], eff_gate=0.15),
                  sig=("penalty", "risk_adjusted"))


@plan(
    "volume_price", "D6 D21",
    _business_ctes(0.05) + f"""
SELECT model, tier, {RSIG('risk_adjusted')} AS risk_adjusted,
  {RSIG('risk_adjusted * CAST(10000 AS DOUBLE)')} AS monthly_dollars
FROM f
""",
    "fx_results", "fx_prices",
)
def volume_price(fx):
    b = econ.business_view(fx["fx_results"], fx["fx_prices"])
    return finish(econ.volume_price(b, 10_000), sig=("risk_adjusted", "monthly_dollars"))


@plan(
    "reprice_sheets", "C7",
    f"""
WITH totals AS (
  SELECT model, count(*) AS n, count(*) FILTER (WHERE terminal_correct) AS n_correct,
    CAST(sum(input_tokens) AS BIGINT) AS sum_in, CAST(sum(output_tokens) AS BIGINT) AS sum_out
  FROM fx_results GROUP BY model),
j AS (
  SELECT s.sheet_id, t.model, t.n, t.n_correct,
    (CAST(sum_in AS DOUBLE) * s.price_in + CAST(sum_out AS DOUBLE) * s.price_out) / 1e6 AS spend_dollars
  FROM totals t JOIN fx_sheets s ON t.model = s.model)
SELECT sheet_id, model, n, n_correct, {R6('spend_dollars')} AS spend_dollars,
  {R6('CASE WHEN n_correct > 0 THEN spend_dollars / n_correct END')} AS dollars_per_correct
FROM j
""",
    "fx_results", "fx_sheets",
)
def reprice_sheets(fx):
    return finish(econ.reprice(fx["fx_results"], fx["fx_sheets"]))

