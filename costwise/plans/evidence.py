"""Registered plans: evidence audits, provider payloads, model specs."""

from __future__ import annotations

from pyspark.sql import functions as F

from costwise.functions.spec import split_spec
from costwise.functions.usage import chat_usage
from costwise.operators import economics as econ
from costwise.operators import evidence as ev
from costwise.operators import reports as rep
from costwise.plans.common import R6, finish, plan
from costwise.plans.economics import TOTALS_SQL
from costwise.plans.ladder import RECORD_ORDER

ACCURACY_BAR = 0.6
TOP_K = 20


def _payloads(fx):
    p = fx["fx_payloads"]
    return p.select("request_id", "model", "ts", chat_usage("payload").alias("u")).select(
        "request_id", "model", "u.*")


_USAGE_SQL = """
raw AS (
  SELECT request_id, model, payload, json_extract(payload, '$.choices[0]') AS choice,
    coalesce(json_extract(payload, '$.usage'), json_extract(payload, '$.choices[0].usage')) AS used
  FROM fx_payloads),
norm AS (
  SELECT request_id, model, coalesce(json_extract_string(choice, '$.message.content'), '') AS text,
    TRY_CAST(json_extract(used, '$.prompt_tokens') AS BIGINT) AS input_tokens,
    TRY_CAST(json_extract(used, '$.completion_tokens') AS BIGINT) AS output_tokens,
    TRY_CAST(json_extract(used, '$.completion_tokens_details.reasoning_tokens') AS BIGINT) AS reasoning_tokens,
    used IS NOT NULL AS provider_usage,
    json_extract_string(choice, '$.finish_reason') AS finish_reason,
    json_extract_string(choice, '$.message.reasoning_content') AS reasoning_content,
    json_extract_string(choice, '$.message.refusal') AS refusal
  FROM raw)
"""


@plan(
    "usage_normalise", "B17",
    f"WITH {_USAGE_SQL} SELECT * FROM norm",
    "fx_payloads",
)
def usage_normalise(fx):
    return _payloads(fx)


@plan(
    "finish_reasons", "B17 D12",
    f"WITH {_USAGE_SQL} SELECT model, finish_reason, count(*) AS n FROM norm GROUP BY model, finish_reason",
    "fx_payloads",
)
def finish_reasons(fx):
    return ev.finish_reasons(_payloads(fx))


@plan(
    "answer_audit", "B17 D12",
    f"""
WITH {_USAGE_SQL}
SELECT model, count(*) AS n, count(refusal) AS n_refused, count(*) FILTER (WHERE finish_reason = 'length') AS n_truncated,
  count(*) FILTER (WHERE length(trim(text)) = 0) AS n_empty
FROM norm GROUP BY model
""",
    "fx_payloads",
)
def answer_audit(fx):
    return ev.answer_audit(_payloads(fx))


@plan(
    "reasoning_evidence", "B17 D13",
    f"""
WITH {_USAGE_SQL}
SELECT split_part(split_part(model, ':', 2), '#', 1) AS model_id, nullif(split_part(model, '=', 2), '') AS knob_value,
  model, count(*) AS n, {R6('avg(reasoning_tokens)')} AS mean_reasoning_tokens,
  count(reasoning_tokens) AS n_with_reasoning_tokens, count(reasoning_content) AS n_with_reasoning_text,
  count(*) FILTER (WHERE NOT provider_usage) AS n_without_usage
FROM norm GROUP BY model
""",
    "fx_payloads",
)
def reasoning_evidence(fx):
    return finish(ev.reasoning_evidence(_payloads(fx)))


@plan(
    "coverage", "D11 S11",
    f"""
SELECT model, count(*) AS n_rows, count(DISTINCT task_id) AS n_tasks,
  (SELECT count(DISTINCT task_id) FROM fx_results) AS expected_tasks,
  count(*) - count(DISTINCT task_id) AS n_duplicate_rows,
  {R6('count(DISTINCT task_id) / (SELECT count(DISTINCT task_id) FROM fx_results)')} AS coverage
FROM fx_results GROUP BY model
""",
    "fx_results",
)
def coverage(fx):
    return finish(ev.coverage(fx["fx_results"]))


@plan(
    "most_missed", "D14 F3",
    f"""
WITH numbered AS (
  SELECT *, row_number() OVER (PARTITION BY task_id, model
    ORDER BY seq DESC, output_tokens DESC, terminal_correct DESC) AS back FROM fx_results)
SELECT task_id, count(DISTINCT CASE WHEN NOT terminal_correct THEN model END) AS n_wrong,
  count(DISTINCT model) AS n_models
FROM numbered WHERE back = 1 GROUP BY task_id
ORDER BY n_wrong DESC, task_id LIMIT {TOP_K}
""",
    "fx_results",
)
def most_missed(fx):
    return ev.most_missed(fx["fx_results"], RECORD_ORDER, TOP_K)


@plan(
    "shared_wrong", "D15",
    """
SELECT task_id, parsed_terminal, count(DISTINCT model) AS n_models,
  string_agg(DISTINCT model, ',' ORDER BY model) AS models
FROM fx_results WHERE NOT terminal_correct AND parsed_terminal IS NOT NULL
GROUP BY task_id, parsed_terminal HAVING count(DISTINCT model) >= 2
""",
    "fx_results",
)
def shared_wrong(fx):
    return ev.shared_wrong(fx["fx_results"])


@plan(
    "absorption", "D16",
    """
WITH w AS (
  SELECT r.model, abs(TRY_CAST(r.parsed_terminal AS DECIMAL(38,0)) - TRY_CAST(r.expected_terminal AS DECIMAL(38,0))) AS delta,
    d.d1, d.d2
  FROM fx_results r JOIN fx_distractors d ON r.task_id = d.task_id
  WHERE NOT r.terminal_correct)
SELECT model, count(*) AS n_wrong, count(*) FILTER (WHERE delta = d1 OR delta = d2) AS n_absorbed
FROM w GROUP BY model
""",
    "fx_results", "fx_distractors",
)
def absorption(fx):
    d = fx["fx_distractors"].select("task_id", F.array("d1", "d2").alias("distractor_values"))
    return ev.absorption(fx["fx_results"], d)


@plan(
    "ideal_floor", "D18",
    f"""
SELECT depth, count(*) AS n_tasks,
  {R6('avg((CAST(v_star_input_tokens AS DOUBLE) * (SELECT min(price_in) FROM fx_prices) + CAST(1 AS DOUBLE) * (SELECT min(price_out) FROM fx_prices)) / 1e6)')}
    AS ideal_dollars
FROM fx_tasks GROUP BY depth
""",
    "fx_tasks", "fx_prices",
)
def ideal_floor(fx):
    return finish(ev.ideal_floor(fx["fx_tasks"], fx["fx_prices"]))


_DPC = f"WITH {TOTALS_SQL}, d AS (SELECT model, accuracy, dollars_per_correct FROM priced2 WHERE dollars_per_correct IS NOT NULL)"


@plan(
    "spread", "D2 D19",
    _DPC + f"""
SELECT (SELECT model FROM d ORDER BY dollars_per_correct, model LIMIT 1) AS cheapest_model,
  {R6('min(dollars_per_correct)')} AS min_dollars_per_correct,
  (SELECT model FROM d ORDER BY dollars_per_correct DESC, model DESC LIMIT 1) AS dearest_model,
  {R6('max(dollars_per_correct)')} AS max_dollars_per_correct,
  {R6('max(dollars_per_correct) / min(dollars_per_correct)')} AS spread
FROM d
""",
    "fx_results", "fx_prices",
)
def spread(fx):
    return finish(ev.spread(econ.dollars_summary(fx["fx_results"], fx["fx_prices"])))


@plan(
    "cheapest_over_bar", "D2 D22",
    _DPC + f"""
SELECT model, {R6('dollars_per_correct')} AS dollars_per_correct, {R6('accuracy')} AS accuracy,
  (SELECT count(*) FROM d WHERE accuracy >= CAST({ACCURACY_BAR} AS DOUBLE)) AS n_eligible
FROM d WHERE accuracy >= CAST({ACCURACY_BAR} AS DOUBLE)
ORDER BY dollars_per_correct, model LIMIT 1
""",
    "fx_results", "fx_prices",
)
def cheapest_over_bar(fx):
    return finish(ev.cheapest_over_bar(econ.dollars_summary(fx["fx_results"], fx["fx_prices"]), ACCURACY_BAR))


@plan(
    "dominated_configs", "D2 C9",
    _DPC + f"""
SELECT a.model, {R6('a.accuracy')} AS accuracy, {R6('a.dollars_per_correct')} AS dollars_per_correct,
  {R6('(SELECT max(b.accuracy) FROM d b WHERE b.dollars_per_correct < a.dollars_per_correct)')} AS best_cheaper_accuracy,
  EXISTS (SELECT 1 FROM d b WHERE b.dollars_per_correct < a.dollars_per_correct AND b.accuracy >= a.accuracy) AS dominated
FROM d a
""",
    "fx_results", "fx_prices",
)
def dominated_configs(fx):
    return finish(ev.dominated_configs(econ.dollars_summary(fx["fx_results"], fx["fx_prices"])))


@plan(
    "ci_width", "D24",
    f"""
WITH g AS (
  SELECT model, difficulty_bucket, count(*) AS n_correct, avg(efficiency) AS m, stddev_samp(efficiency) AS sd
  FROM fx_results WHERE efficiency IS NOT NULL GROUP BY model, difficulty_bucket),
h AS (SELECT *, CAST(1.96 AS DOUBLE) * sd / sqrt(CAST(n_correct AS DOUBLE)) AS half FROM g)
SELECT model, difficulty_bucket,
  CASE WHEN half IS NOT NULL THEN 1 + (SELECT count(*) FROM h o WHERE o.difficulty_bucket = h.difficulty_bucket
    AND o.m - o.half > h.m + h.half) END AS overlap_rank, n_correct, {R6('m')} AS mean_efficiency, {R6('half')} AS half_width,
  {R6('m - half')} AS ci_low, {R6('m + half')} AS ci_high,
  coalesce(half > CAST(0.02 AS DOUBLE), true) AS sample_more
FROM h
""",
    "fx_results",
)
def ci_width(fx):
    return finish(ev.ci_width(fx["fx_results"]))


@plan(
    "ci_width_versions", "D24",
    f"""
WITH g AS (
  SELECT model, generator_version, difficulty_bucket, count(*) AS n_correct, avg(efficiency) AS m, stddev_samp(efficiency) AS sd
  FROM fx_versioned WHERE efficiency IS NOT NULL GROUP BY model, generator_version, difficulty_bucket),
h AS (SELECT *, CAST(1.96 AS DOUBLE) * sd / sqrt(CAST(n_correct AS DOUBLE)) AS half FROM g)
SELECT model, generator_version, difficulty_bucket,
  CASE WHEN half IS NOT NULL THEN 1 + (SELECT count(*) FROM h o WHERE o.difficulty_bucket = h.difficulty_bucket
    AND o.generator_version = h.generator_version AND o.m - o.half > h.m + h.half) END AS overlap_rank, n_correct,
  {R6('m')} AS mean_efficiency, {R6('half')} AS half_width, {R6('m - half')} AS ci_low, {R6('m + half')} AS ci_high,
  coalesce(half > CAST(0.02 AS DOUBLE), true) AS sample_more
FROM h
""",
    "fx_versioned",
)
def ci_width_versions(fx):
    return finish(ev.ci_width(fx["fx_versioned"]))


@plan(
    "saturated_cells", "D1 D25",
    f"""
WITH r AS (
  SELECT model, difficulty_bucket, count(*) AS n,
    count(*) FILTER (WHERE terminal_correct) / count(*) AS accuracy,
    coalesce(stddev_samp(efficiency), CAST(0 AS DOUBLE)) AS efficiency_stddev
  FROM fx_results GROUP BY model, difficulty_bucket)
SELECT model, difficulty_bucket, n, {R6('accuracy')} AS accuracy, {R6('efficiency_stddev')} AS efficiency_stddev
FROM r WHERE accuracy >= CAST(0.95 AS DOUBLE) AND efficiency_stddev <= CAST(0.15 AS DOUBLE)
""",
    "fx_results",
)
def saturated_cells(fx):
    # the fixture's per-cell efficiency sd lies in 0.12-0.18, so 0.15 separates cells
    r = ev.saturated_cells(rep.stratified_report(fx["fx_results"]), max_sd=0.15)
    return finish(r.select("model", "difficulty_bucket", "n", "accuracy", "efficiency_stddev"))


@plan(
    "spend_by_depth", "C5 D26",
    f"""
WITH g AS (
  SELECT model, depth, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS si, CAST(sum(output_tokens) AS BIGINT) AS so
  FROM fx_results GROUP BY model, depth)
SELECT g.model, CAST(g.depth AS BIGINT) AS depth, g.n,
  {R6('(CAST(si AS DOUBLE) * p.price_in + CAST(so AS DOUBLE) * p.price_out) / 1e6 / g.n')} AS mean_dollars_per_task
FROM g JOIN fx_prices p ON g.model = p.model
""",
    "fx_results", "fx_prices",
)
def spend_by_depth(fx):
    return finish(ev.spend_by_depth(fx["fx_results"], fx["fx_prices"]))


def sql_split_spec(s: str) -> dict[str, str]:
    rest = f"(CASE WHEN instr({s}, ':') > 0 THEN substr({s}, instr({s}, ':') + 1) ELSE '' END)"
    frag = f"(CASE WHEN instr({rest}, '#') > 0 THEN substr({rest}, instr({rest}, '#') + 1) ELSE '' END)"
    provider = f"split_part({s}, ':', 1)"
    knob = f"split_part({frag}, '=', 1)"
    value = f"(CASE WHEN instr({frag}, '=') > 0 THEN substr({frag}, instr({frag}, '=') + 1) ELSE '' END)"
    is_effort = f"({knob} = 'effort' AND {value} IN ('low', 'medium', 'high'))"
    is_thinking = f"({knob} = 'thinking' AND {value} = 'off')"
    error = (
        f"(CASE WHEN {frag} <> '' AND {is_effort} AND {provider} <> 'openai' THEN 'effort_requires_openai' "
        f"WHEN {frag} <> '' AND NOT {is_effort} AND {is_thinking} AND {provider} <> 'moonshot' "
        f"THEN 'thinking_off_requires_moonshot' "
        f"WHEN {frag} <> '' AND NOT {is_effort} AND NOT {is_thinking} THEN 'unsupported_fragment' "
        f"WHEN {provider} NOT IN ('moonshot', 'openai', 'anthropic', 'deepseek') THEN 'unknown_provider' END)"
    )
    return {
        "provider": provider,
        "model_id": f"split_part({rest}, '#', 1)",
        "knob": f"nullif({knob}, '')",
        "knob_value": f"(CASE WHEN {frag} <> '' THEN {value} END)",
        "error": error,
    }


_SPEC = sql_split_spec("spec")


@plan(
    "spec_split", "B19",
    "SELECT spec_id, spec, " + ", ".join(f"{v} AS {k}" for k, v in _SPEC.items()) + " FROM fx_specs",
    "fx_specs",
)
def spec_split(fx):
    s = fx["fx_specs"]
    return s.select("spec_id", "spec", split_spec("spec").alias("p")).select("spec_id", "spec", "p.*")


# Fixture names of the 13 result configs as provider specs (for the knob view).
FX_SPECS = {
    "m0": "openai:gpt-x", "m1": "openai:gpt-x#effort=low", "m2": "openai:gpt-x#effort=medium",
    "m3": "openai:gpt-x#effort=high", "m4": "moonshot:kimi-y", "m5": "moonshot:kimi-y#thinking=off",
    "m6": "anthropic:claude-z", "m7": "deepseek:ds-w", "m8": "openai:gpt-v#effort=high",
    "m9": "openai:gpt-v#effort=low", "m10": "moonshot:kimi-u", "m11": "moonshot:kimi-u#thinking=off",
    "m12": "anthropic:claude-t",
}
_CASE_SPEC = "CASE model " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FX_SPECS.items()) + " END"
_S2 = sql_split_spec("model")


@plan(
    "knob_exchange", "B19 D2 D20",
    f"""
WITH {TOTALS_SQL},
s AS (SELECT {_CASE_SPEC} AS model, accuracy, dollars_per_correct FROM priced2),
p AS (SELECT model, accuracy, dollars_per_correct, {_S2['provider']} AS provider, {_S2['model_id']} AS model_id,
        {_S2['knob']} AS knob, {_S2['knob_value']} AS knob_value FROM s)
SELECT k.model, b.model AS base_model, k.knob, k.knob_value, b.knob_value AS base_knob_value,
  {R6('k.accuracy - b.accuracy')} AS accuracy_delta,
  {R6('k.dollars_per_correct / b.dollars_per_correct')} AS cost_ratio
FROM p k JOIN p b ON k.provider = b.provider AND k.model_id = b.model_id AND k.model <> b.model
WHERE k.knob IS NOT NULL AND (b.knob IS NULL OR
  coalesce(b.dollars_per_correct, CAST('Infinity' AS DOUBLE)) < coalesce(k.dollars_per_correct, CAST('Infinity' AS DOUBLE))
  OR coalesce(b.dollars_per_correct, CAST('Infinity' AS DOUBLE)) = coalesce(k.dollars_per_correct, CAST('Infinity' AS DOUBLE))
     AND b.model < k.model)
""",
    "fx_results", "fx_prices",
)
def knob_exchange(fx):
    d = econ.dollars_summary(fx["fx_results"], fx["fx_prices"])
    mapping = F.create_map(*[F.lit(x) for kv in FX_SPECS.items() for x in kv])
    d = d.withColumn("model", mapping[F.col("model")])
    return finish(ev.knob_exchange(d))
