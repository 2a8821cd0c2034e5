"""Fixture views over the shared test tables (documented in FIXTURES.md).

Each view is one SQL template whose inputs are written ``{table}``. Spark binds
the placeholders to DataFrames read from the parquet folder
(``spark.sql(template, lineitem=df)``); the DuckDB oracle gets the same text
with plain table names, inlined as CTEs. One text, two engines, no drift.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

FX_SQL: dict[str, str] = {
    # tasks: one per part; everything about a task follows from its part alone.
    "fx_tasks": """
SELECT concat('P', CAST(p_partkey AS STRING)) AS task_id,
  CAST(3 * (1 + p_partkey % 10) AS INT) AS depth,
  CAST(floor(p_partkey / 10) AS BIGINT) % 50 AS group_seed,
  concat('hybrid-paired_d', CAST(3 * (1 + p_partkey % 10) AS STRING)) AS difficulty_bucket,
  CAST(p_partkey * 37 % 5000 AS STRING) AS expected_terminal,
  100 + 5 * (p_partkey % 50) AS v_star_input_tokens, CAST(1 AS BIGINT) AS v_star_output_tokens
FROM {part}
""",
    # results: several models per task, and (task, model) pairs recorded more than once in the order of seq.
    "fx_results": """
WITH base AS (
  SELECT concat('P', CAST(l_partkey AS STRING)) AS task_id,
    concat('m', CAST(l_suppkey % 13 AS STRING)) AS model,
    l_orderkey * 8 + l_linenumber AS seq,
    CAST(3 * (1 + l_partkey % 10) AS INT) AS depth,
    CAST(floor(l_partkey / 10) AS BIGINT) % 50 AS group_seed,
    (l_orderkey * 7 + l_linenumber * 3 + l_suppkey) % 20 >= (l_suppkey % 13) AS terminal_correct,
    CAST(l_partkey * 37 % 5000 AS STRING) AS expected_terminal,
    CAST(l_partkey * 37 % 5000 + 1 + l_orderkey % 5 AS STRING) AS wrong_terminal,
    100 + 5 * (l_partkey % 50) AS input_tokens,
    1 + CAST(floor(l_extendedprice / 100) AS BIGINT) AS output_tokens
  FROM {lineitem})
SELECT task_id, model, seq, terminal_correct,
  CASE WHEN terminal_correct THEN expected_terminal ELSE wrong_terminal END AS parsed_terminal,
  expected_terminal, input_tokens, output_tokens,
  CAST(input_tokens + 4 * output_tokens AS DOUBLE) AS cost,
  CAST(input_tokens + 4 AS DOUBLE) AS v_star,
  CASE WHEN terminal_correct
       THEN CAST(input_tokens + 4 AS DOUBLE) / CAST(input_tokens + 4 * output_tokens AS DOUBLE) END AS efficiency,
  concat('hybrid-paired_d', CAST(depth AS STRING)) AS difficulty_bucket, depth, group_seed
FROM base
""",
    # the same results, recorded under three generator versions.
    "fx_versioned": """
SELECT *, concat('2.', CAST(seq % 3 AS STRING)) AS generator_version FROM {fx_results}
""",
    # recorded task segments: three attempts a group, a listing, a chain and a ledger each; in every fourth group
    # the first attempts show a hidden value.
    "fx_segments": """
WITH a AS (SELECT p.*, a.attempt FROM {part} p CROSS JOIN (VALUES (0), (1), (2)) a(attempt))
SELECT CAST(p_partkey AS BIGINT) AS seed, CAST(attempt AS INT) AS attempt, CAST(s.position AS INT) AS position, s.kind AS kind,
  concat(s.kind, ' over ', p_name, ' with ', CAST(p_partkey * 7 + attempt AS STRING), ' units',
    CASE WHEN p_partkey % 4 = 0 AND attempt < p_partkey % 3 THEN concat(', in all ', CAST(100000 + p_partkey * 11 + s.position AS STRING), ' of them') ELSE '' END, '.') AS text,
  CAST(100000 + p_partkey * 11 + s.position AS BIGINT) AS value,
  CASE WHEN attempt = 1 AND p_partkey % 5 = 0 THEN 'text' ELSE 'integer' END AS value_type
FROM a CROSS JOIN (VALUES (0, 'program_output'), (1, 'arithmetic_chain'), (2, 'table_aggregation')) s(position, kind)
""",
    # price sheet: m12 deliberately missing.
    "fx_prices": """
SELECT concat('m', CAST(n_nationkey AS STRING)) AS model,
  CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) * n_nationkey AS price_in,
  CAST(2.5 AS DOUBLE) + CAST(1.25 AS DOUBLE) * n_nationkey AS price_out
FROM {nation} WHERE n_nationkey < 12
""",
    # three sheets: list price, a doubled sheet and a half-price sheet.
    "fx_sheets": """
SELECT 'sheet_x0.5' AS sheet_id, concat('m', CAST(n_nationkey AS STRING)) AS model,
  (CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) * n_nationkey) * CAST(0.5 AS DOUBLE) AS price_in,
  (CAST(2.5 AS DOUBLE) + CAST(1.25 AS DOUBLE) * n_nationkey) * CAST(0.5 AS DOUBLE) AS price_out
FROM {nation} WHERE n_nationkey < 12
UNION ALL
SELECT 'sheet_x1' AS sheet_id, concat('m', CAST(n_nationkey AS STRING)) AS model,
  CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) * n_nationkey AS price_in,
  CAST(2.5 AS DOUBLE) + CAST(1.25 AS DOUBLE) * n_nationkey AS price_out
FROM {nation} WHERE n_nationkey < 12
UNION ALL
SELECT 'sheet_x2' AS sheet_id, concat('m', CAST(n_nationkey AS STRING)) AS model,
  (CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) * n_nationkey) * CAST(2 AS DOUBLE) AS price_in,
  (CAST(2.5 AS DOUBLE) + CAST(1.25 AS DOUBLE) * n_nationkey) * CAST(2 AS DOUBLE) AS price_out
FROM {nation} WHERE n_nationkey < 10
""",
    # free-text responses: integers, grouped integers, consistency replies, empty text.
    "fx_responses": """
SELECT concat('D', CAST(doc_id AS STRING)) AS task_id, source AS model,
  CASE WHEN doc_id % 5 = 3 THEN 'consistency' ELSE 'chain' END AS template_id,
  CASE doc_id % 5
    WHEN 0 THEN text
    WHEN 1 THEN concat(text, ' Answer: ', CAST(n_chars AS STRING))
    WHEN 2 THEN concat('Difference: ', CAST(CAST(floor(n_chars / 1000) AS BIGINT) AS STRING), ',',
                       lpad(CAST(n_chars % 1000 AS STRING), 3, '0'))
    WHEN 3 THEN concat('a=', CAST(n_chars AS STRING), ', b=', CAST(n_chars - 7 AS STRING), ', c=',
                       CAST(7 + doc_id % 2 AS STRING), ', verdict=',
                       CASE WHEN doc_id % 4 < 2 THEN 'consistent' ELSE 'inconsistent' END)
    ELSE '' END AS response_text,
  CASE WHEN doc_id % 10 < 7 THEN CAST(n_chars AS STRING) ELSE CAST(n_chars + 1 AS STRING) END AS expected_terminal,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END AS provider_output_tokens,
  CAST(20 + doc_id % 80 AS BIGINT) AS v_star_input_tokens, CAST(1 AS BIGINT) AS v_star_output_tokens
FROM {documents}
""",
    # the task side of the documents: the document text is the prompt.
    "fx_doc_tasks": """
SELECT concat('D', CAST(doc_id AS STRING)) AS task_id,
  CASE WHEN doc_id % 5 = 3 THEN 'consistency' ELSE 'chain' END AS template_id,
  'fx-1.0' AS generator_version,
  text AS merged_prompt,
  CASE WHEN doc_id % 10 < 7 THEN CAST(n_chars AS STRING) ELSE CAST(n_chars + 1 AS STRING) END
    AS canonical_terminal_answer,
  CAST(20 + doc_id % 80 AS BIGINT) AS v_star_input_tokens, CAST(1 AS BIGINT) AS v_star_output_tokens,
  concat('docs_', lang, '_d', CAST(1 + doc_id % 4 AS STRING)) AS difficulty_bucket
FROM {documents}
""",
    # the response side: provider counts missing for some rows (local fallback).
    "fx_doc_responses": """
SELECT concat('D', CAST(doc_id AS STRING)) AS task_id, source AS model,
  CASE doc_id % 5
    WHEN 0 THEN text
    WHEN 1 THEN concat(text, ' Answer: ', CAST(n_chars AS STRING))
    WHEN 2 THEN concat('Difference: ', CAST(CAST(floor(n_chars / 1000) AS BIGINT) AS STRING), ',',
                       lpad(CAST(n_chars % 1000 AS STRING), 3, '0'))
    WHEN 3 THEN concat('a=', CAST(n_chars AS STRING), ', b=', CAST(n_chars - 7 AS STRING), ', c=',
                       CAST(7 + doc_id % 2 AS STRING), ', verdict=',
                       CASE WHEN doc_id % 4 < 2 THEN 'consistent' ELSE 'inconsistent' END)
    ELSE '' END AS response_text,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(30 + doc_id % 90 AS BIGINT) END AS input_tokens,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END AS output_tokens
FROM {documents}
""",
    # two recorded distractor values per task.
    "fx_distractors": """
SELECT concat('P', CAST(p_partkey AS STRING)) AS task_id,
  CAST(p_size % 6 AS BIGINT) AS d1, p_partkey % 4 AS d2
FROM {part}
""",
    # model spec strings, valid and invalid, one per customer.
    "fx_specs": """
SELECT c_custkey AS spec_id,
  concat(CASE WHEN c_custkey % 17 = 0 THEN '' ELSE
           concat(CASE c_nationkey % 5 WHEN 0 THEN 'openai' WHEN 1 THEN 'moonshot' WHEN 2 THEN 'anthropic'
                                       WHEN 3 THEN 'deepseek' ELSE 'acme' END, ':') END,
         lower(c_mktsegment), '-', CAST(c_custkey % 7 AS STRING),
         CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN '#effort=low' WHEN 2 THEN '#thinking=off'
                            WHEN 3 THEN '#effort=max' WHEN 4 THEN '#effort=high' ELSE '#bogus' END) AS spec
FROM {customer}
""",
    # op log per order; start value repeated on each row.
    "fx_ops": """
SELECT l_orderkey AS task_id, 10000000 + l_orderkey % 400 AS start_value,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq,
  CASE l_partkey % 4 WHEN 0 THEN 'gain' WHEN 1 THEN 'loss' WHEN 2 THEN 'scale' ELSE 'split' END AS op,
  CASE l_partkey % 4 WHEN 0 THEN 13 + l_partkey % 84 WHEN 1 THEN 7 + l_partkey % 20
       ELSE 2 + l_partkey % 2 END AS k
FROM {lineitem}
""",
    # ledger cells in long form.
    "fx_cells": """
SELECT l_orderkey AS task_id, l_suppkey % 3 AS grp, l_linenumber AS day_idx,
  CAST(floor(l_quantity) AS BIGINT) AS value
FROM {lineitem}
""",
    # provider chunk stream.
    "fx_chunks": """
SELECT conv_id AS request_id, turn AS idx,
  CASE WHEN role = 'assistant' THEN text END AS content,
  CASE WHEN role <> 'assistant' THEN text END AS reasoning,
  CASE WHEN turn % 2 = 1 THEN turn * 10 END AS completion_tokens,
  CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'stop' END AS finish_reason
FROM {conversations}
""",
    # raw chat payloads: answers in choices[], usage on the payload, on the choice or (every fifth) nowhere,
    # some answers empty, refused or cut off; three settings of every model.
    "fx_payloads": """
WITH with_usage AS (
  SELECT *, concat(',"usage":{{"prompt_tokens":', CAST(user_id AS STRING), ',"completion_tokens":',
      CAST(CAST(floor(value) AS BIGINT) AS STRING), ',"completion_tokens_details":{{"reasoning_tokens":',
      CAST(event_id % 50 AS STRING), '}}}}') AS used FROM {events})
SELECT event_id AS request_id, ts,
  concat('openai:', event_type, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '#effort=low' ELSE '#effort=high' END) AS model,
  concat('{{"choices":[{{"message":{{"content":"', CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('answer ', CAST(event_id AS STRING)) END, '"',
    CASE WHEN event_id % 13 = 0 THEN ',"refusal":"declined"' ELSE '' END,
    CASE WHEN event_id % 4 = 0 THEN ',"reasoning_content":"thought"' ELSE '' END,
    '}},"finish_reason":"', CASE WHEN event_id % 7 = 0 THEN 'length' ELSE 'stop' END, '"',
    CASE WHEN event_id % 5 <> 0 AND event_id % 3 = 0 THEN used ELSE '' END, '}}]',
    CASE WHEN event_id % 5 <> 0 AND event_id % 3 <> 0 THEN used ELSE '' END, '}}') AS payload
FROM with_usage
""",
}

_PLACEHOLDER = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def _inputs(template: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(template)))


class Fixtures:
    """Lazily built fixture DataFrames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in FX_SQL:
                tpl = FX_SQL[name]
                refs = {n: self.table(n) for n in _inputs(tpl)}
                self._cache[name] = self.spark.sql(tpl, **refs)
            else:
                self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    __getitem__ = table


def duckdb_text(template: str) -> str:
    """The template with plain table names (``{x}`` -> ``x``, ``{{`` -> ``{``)."""
    return template.format(**{n: n for n in _inputs(template)})


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix an oracle query with the named fixture views as CTEs (dependencies first)."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        for dep in _inputs(FX_SQL[n]):
            if dep in FX_SQL:
                visit(dep)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({duckdb_text(FX_SQL[n]).strip()})" for n in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
