"""Registered plans: scoring free-text responses against tasks, text measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from costwise.functions import patterns as P
from costwise.functions.answers import last_integer
from costwise.functions.text import heuristic_tokens, utf8_bytes, word_count
from costwise.operators import scoring as sc
from costwise.plans.common import R6, finish, plan

Q = P.sql_literal
NOT_WS = "[^" + P.WS[1:]


def sql_last_integer(text: str) -> str:
    # written for the oracle alone: ASCII digits are all that the test tables hold
    seps = "[," + chr(0xFF0C) + chr(0xA0) + chr(0x202F) + "]"
    raw = f"regexp_extract_all({text}, '-?([0-9]{{1,3}}({seps}[0-9][0-9][0-9])+|[0-9]+)')[-1]"
    digits = f"regexp_replace({raw}, '{seps}', '', 'g')"
    stripped = f"regexp_replace({digits}, '^(-?)0+([0-9])', '\\1\\2')"
    return f"(CASE WHEN {stripped} = '-0' THEN '0' ELSE {stripped} END)"


def sql_words(text: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, {Q(NOT_WS + '+')})) AS BIGINT)"


def sql_tokens(text: str) -> str:
    return (
        f"(CASE WHEN {text} IS NULL OR {text} = '' THEN CAST(0 AS BIGINT) ELSE "
        f"greatest(CAST(1 AS BIGINT), CAST(floor(CAST({sql_words(text)} AS DOUBLE) * CAST(1.3 AS DOUBLE)) AS BIGINT)) END)"
    )


def _field(text: str, pat: str) -> str:
    return f"nullif(regexp_extract({text}, {Q(pat)}, 1), '')"


def sql_consistency(text: str) -> tuple[str, str, str, str]:
    a = f"TRY_CAST({_field(text, P.CONSISTENCY_A)} AS DECIMAL(38,0))"
    b = f"TRY_CAST({_field(text, P.CONSISTENCY_B)} AS DECIMAL(38,0))"
    c = f"TRY_CAST({_field(text, P.CONSISTENCY_C)} AS DECIMAL(38,0))"
    v = f"lower({_field(text, P.CONSISTENCY_VERDICT)})"
    return a, b, c, v


_A, _B, _C, _V = sql_consistency("response_text")

SCORED_SQL = f"""
scored0 AS (
  SELECT r.task_id, r.model, t.template_id, t.canonical_terminal_answer AS expected_terminal,
    CAST(coalesce(r.input_tokens, {sql_tokens('t.merged_prompt')}) AS BIGINT) AS input_tokens,
    CAST(coalesce(r.output_tokens, {sql_tokens('r.response_text')}) AS BIGINT) AS output_tokens,
    t.v_star_input_tokens, t.v_star_output_tokens, r.response_text, t.generator_version, t.difficulty_bucket,
    {_A} AS a, {_B} AS b, {_C} AS c, {_V} AS verdict,
    {sql_last_integer('r.response_text')} AS int_answer
  FROM fx_doc_responses r JOIN fx_doc_tasks t ON r.task_id = t.task_id),
scored AS (
  SELECT task_id, model, template_id,
    CASE WHEN template_id = 'consistency'
         THEN coalesce((a = b + c) = (verdict = 'consistent'), false)
         ELSE coalesce(int_answer = expected_terminal, false) END AS terminal_correct,
    CASE WHEN template_id = 'consistency' THEN verdict ELSE int_answer END AS parsed_terminal,
    expected_terminal, input_tokens, output_tokens,
    CAST(1.0 AS DOUBLE) * input_tokens + CAST(4.0 AS DOUBLE) * output_tokens AS cost,
    CAST(1.0 AS DOUBLE) * v_star_input_tokens + CAST(4.0 AS DOUBLE) * v_star_output_tokens AS v_star,
    response_text, generator_version, difficulty_bucket
  FROM scored0),
scored2 AS (
  SELECT *, CASE WHEN terminal_correct THEN CASE WHEN cost <= 0 THEN CAST(0 AS DOUBLE) ELSE v_star / cost END END
    AS efficiency
  FROM scored)
"""


def _scored(fx):
    return sc.score(fx["fx_doc_tasks"], fx["fx_doc_responses"])


@plan(
    "score_responses", "C1 B1-B7 B10 B14 B15",
    f"""
WITH {SCORED_SQL}
SELECT task_id, model, template_id, terminal_correct, parsed_terminal, expected_terminal,
  input_tokens, output_tokens, {R6('cost')} AS cost, {R6('v_star')} AS v_star, {R6('efficiency')} AS efficiency,
  generator_version, difficulty_bucket
FROM scored2
""",
    "fx_doc_tasks", "fx_doc_responses",
)
def score_responses(fx):
    return finish(_scored(fx).drop("response_text", "weights"))


@plan(
    "consistency_grade", "B8 B9",
    f"""
SELECT task_id, model, CAST({_A} AS VARCHAR) AS a, CAST({_B} AS VARCHAR) AS b, CAST({_C} AS VARCHAR) AS c, {_V} AS verdict,
  coalesce((({_A}) = ({_B}) + ({_C})) = (({_V}) = 'consistent'), false) AS terminal_correct
FROM fx_responses WHERE template_id = 'consistency'
""",
    "fx_responses",
)
def consistency_grade(fx):
    from costwise.functions.answers import consistency_fields, grade_consistency

    r = fx["fx_responses"].filter(F.col("template_id") == "consistency")
    f = consistency_fields("response_text")
    return r.select("task_id", "model", f.alias("f")).select(
        "task_id", "model", "f.a", "f.b", "f.c", "f.verdict",
        grade_consistency("f").alias("terminal_correct"),
    )


@plan(
    "last_integer", "B1",
    f"SELECT doc_id, {sql_last_integer('text')} AS parsed_terminal FROM documents",
)
def last_integer_plan(fx):
    return fx["documents"].select("doc_id", last_integer("text").alias("parsed_terminal"))


@plan(
    "last_integer_responses", "B1 B2",
    f"""
SELECT task_id, {sql_last_integer('response_text')} AS parsed_terminal,
  coalesce({sql_last_integer('response_text')} = expected_terminal, false) AS terminal_correct
FROM fx_responses WHERE template_id <> 'consistency'
""",
    "fx_responses",
)
def last_integer_responses(fx):
    from costwise.functions.answers import grade_exact

    r = fx["fx_responses"].filter(F.col("template_id") != "consistency")
    p = last_integer("response_text")
    return r.select("task_id", p.alias("parsed_terminal"),
                    grade_exact(p, "expected_terminal").alias("terminal_correct"))


@plan(
    "token_heuristic", "B15 B16",
    f"""
SELECT doc_id, {sql_words('text')} AS words, {sql_tokens('text')} AS tokens,
  CAST(strlen(text) AS BIGINT) AS utf8_bytes
FROM documents
""",
)
def token_heuristic(fx):
    d = fx["documents"]
    return d.select(
        "doc_id", word_count("text").cast("bigint").alias("words"),
        heuristic_tokens("text").alias("tokens"), utf8_bytes("text").alias("utf8_bytes"),
    )


@plan(
    "bytes_per_correct", "B16 D23",
    f"""
WITH {SCORED_SQL}
SELECT model, count(*) AS n, count(*) FILTER (WHERE terminal_correct) AS n_correct,
  CAST(sum(strlen(response_text)) AS BIGINT) AS total_bytes,
  {R6('CASE WHEN count(*) FILTER (WHERE terminal_correct) > 0 THEN CAST(sum(strlen(response_text)) AS DOUBLE) / count(*) FILTER (WHERE terminal_correct) END')}
    AS bytes_per_correct
FROM scored2 GROUP BY model
""",
    "fx_doc_tasks", "fx_doc_responses",
)
def bytes_per_correct(fx):
    from costwise.operators.evidence import bytes_per_correct as bpc

    return finish(bpc(_scored(fx)))


@plan(
    "calibration_scores", "K17 C6 C1",
    f"""
WITH cal AS (
  SELECT t.task_id, m.model, t.canonical_terminal_answer AS ans, t.v_star_input_tokens, t.v_star_output_tokens,
    t.merged_prompt,
    CASE m.model WHEN 'echo_model' THEN t.canonical_terminal_answer
      WHEN 'verbose_echo_model' THEN repeat('Let me think step by step about this problem. ', 20)
                                     || chr(10) || 'The answer is ' || t.canonical_terminal_answer
      ELSE '0' END AS response_text
  FROM fx_doc_tasks t,
    (SELECT 'echo_model' AS model UNION ALL SELECT 'verbose_echo_model' UNION ALL SELECT 'wrong_echo_model') m
  WHERE t.template_id <> 'consistency'),
s AS (
  SELECT task_id, model, {sql_last_integer('response_text')} AS parsed_terminal, ans AS expected_terminal,
    {sql_tokens('merged_prompt')} AS input_tokens, {sql_tokens('response_text')} AS output_tokens,
    CAST(v_star_input_tokens AS DOUBLE) + 4 * CAST(v_star_output_tokens AS DOUBLE) AS v_star
  FROM cal),
s2 AS (
  SELECT *, coalesce(parsed_terminal = expected_terminal, false) AS terminal_correct,
    CAST(input_tokens AS DOUBLE) + 4 * CAST(output_tokens AS DOUBLE) AS cost FROM s)
SELECT model, count(*) AS n, count(*) FILTER (WHERE terminal_correct) AS n_correct,
  {R6('coalesce(avg(CASE WHEN terminal_correct THEN CASE WHEN cost <= 0 THEN 0 ELSE v_star / cost END END), CAST(0 AS DOUBLE))')}
    AS mean_efficiency,
  {R6('avg(output_tokens)')} AS mean_output_tokens
FROM s2 GROUP BY model
""",
    "fx_doc_tasks",
)
def calibration_scores(fx):
    tasks = fx["fx_doc_tasks"].filter(F.col("template_id") != "consistency")
    responses = sc.calibration_responses(tasks)
    scored = sc.score(tasks, responses)
    return finish(scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("terminal_correct").alias("n_correct"),
        F.coalesce(F.avg("efficiency"), F.lit(0.0)).alias("mean_efficiency"),
        F.avg("output_tokens").alias("mean_output_tokens"),
    ))


@plan(
    "consistency_calibration", "K18 B8 B9",
    f"""
WITH claims AS (
  SELECT task_id, {_A} AS a, {_B} AS b, {_C} AS c, {_V} AS verdict
  FROM fx_responses WHERE template_id = 'consistency'),
g AS (
  SELECT 'consistency_echo_model' AS model,
    coalesce((a = b + c) = (verdict = 'consistent'), false) AS ok FROM claims
  UNION ALL
  SELECT 'confabulating_consistency_model' AS model,
    coalesce(a + 1 = b + c, false) AS ok FROM claims)
SELECT model, count(*) AS n, count(*) FILTER (WHERE ok) AS n_correct FROM g GROUP BY model
""",
    "fx_responses",
)
def consistency_calibration(fx):
    from costwise.functions.answers import consistency_fields, grade_consistency

    r = fx["fx_responses"].filter(F.col("template_id") == "consistency")
    claims = r.select("task_id", consistency_fields("response_text").alias("f")).select(
        "task_id", "f.a", "f.b", "f.c", "f.verdict")
    replies = sc.consistency_calibration(claims)
    graded = replies.select("model", grade_consistency(consistency_fields("response_text")).alias("ok"))
    return graded.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_correct"))
