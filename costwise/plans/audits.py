"""Registered plans: truth replay, ledger totals, surface-form audits, chunk streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from costwise.functions import patterns as P
from costwise.operators import audits as au
from costwise.operators.chunks import collapse_chunks
from costwise.plans.common import plan
from costwise.plans.scoring import sql_tokens

Q = P.sql_literal


@plan(
    "oplog_replay", "K10",
    """
WITH RECURSIVE starts AS (SELECT task_id, min(start_value) AS start_value FROM fx_ops GROUP BY task_id),
r(task_id, seq, v) AS (
  SELECT task_id, CAST(0 AS BIGINT), CAST(start_value AS BIGINT) FROM starts
  UNION ALL
  SELECT r.task_id, CAST(o.seq AS BIGINT),
    CASE o.op WHEN 'gain' THEN r.v + o.k WHEN 'loss' THEN r.v - o.k WHEN 'scale' THEN r.v * o.k
         ELSE (r.v - (((r.v % o.k) + o.k) % o.k)) // o.k END
  FROM r JOIN fx_ops o ON o.task_id = r.task_id AND o.seq = r.seq + 1)
SELECT task_id, max(seq) AS n_ops, arg_max(v, seq) AS final_value, min(v) AS min_value, max(v) AS max_value
FROM r GROUP BY task_id
""",
    "fx_ops",
)
def oplog_replay(fx):
    return au.replay_ops(fx["fx_ops"])


@plan(
    "ledger_spread", "D10 K11",
    """
WITH t AS (SELECT task_id, grp, CAST(sum(value) AS BIGINT) AS total FROM fx_cells GROUP BY task_id, grp)
SELECT task_id, count(*) AS n_groups, max(total) AS max_total, min(total) AS min_total,
  max(total) - min(total) AS spread, count(DISTINCT total) < count(*) AS has_tie
FROM t GROUP BY task_id
""",
    "fx_cells",
)
def ledger_spread(fx):
    return au.ledger_spread(fx["fx_cells"])


def _doc_tasks(fx):
    d = fx["documents"]
    return d.select(
        F.col("doc_id").alias("task_id"), F.col("text").alias("merged_prompt"),
        F.array(F.col("n_chars"), F.col("n_chars") + 1, F.col("doc_id")).alias("hidden"),
        F.col("n_chars").alias("answer"),
    )


_RUNS = f"regexp_extract_all(text, {Q(P.NUMBER_RUN)})"
_MARK = f"regexp_matches(text, {Q(P.DECOMPOSITION_MARKERS)})"


def _hit(v: str) -> str:
    return f"list_contains({_RUNS}, CAST({v} AS VARCHAR))"


_VALS = ["n_chars", "n_chars + 1", "doc_id"]
_N_LEAK = " + ".join(f"CAST({_hit(v)} AS BIGINT)" for v in _VALS)
_LEAKED = "concat_ws(',', " + ", ".join(f"CASE WHEN {_hit(v)} THEN CAST({v} AS VARCHAR) END" for v in _VALS) + ")"


@plan(
    "surface_audit", "B20 B21 K15",
    f"SELECT doc_id AS task_id, {_MARK} AS has_marker, {_N_LEAK} AS n_leaked, {_LEAKED} AS leaked FROM documents",
)
def surface_audit(fx):
    return au.surface_audit(_doc_tasks(fx))


@plan(
    "marker_audit", "B20",
    f"SELECT count(*) AS n_docs, count(*) FILTER (WHERE {_MARK}) AS n_with_marker FROM documents",
)
def marker_audit(fx):
    from costwise.functions.text import has_decomposition_marker

    return fx["documents"].agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(has_decomposition_marker("text")).alias("n_with_marker"),
    )


@plan(
    "task_validity", "K12",
    f"""
SELECT 'no_decomposition_marker' AS "check", count(*) AS n_tasks, count(*) FILTER (WHERE {_MARK}) AS n_violations
FROM documents
UNION ALL
SELECT 'no_hidden_value_leak', count(*), count(*) FILTER (WHERE ({_N_LEAK}) > 0) FROM documents
UNION ALL
SELECT 'answer_within_bounds', count(*), count(*) FILTER (WHERE NOT (n_chars BETWEEN 2 AND 500000)) FROM documents
UNION ALL
SELECT 'prompt_not_empty', count(*), count(*) FILTER (WHERE NOT (length(text) > 0)) FROM documents
""",
)
def task_validity(fx):
    return au.validity_audit(_doc_tasks(fx))


@plan(
    "vstar_consistency", "K16 B15",
    f"""
SELECT task_id, v_star_input_tokens, {sql_tokens('merged_prompt')} AS recomputed_input_tokens,
  v_star_input_tokens = {sql_tokens('merged_prompt')} AS consistent
FROM fx_doc_tasks
""",
    "fx_doc_tasks",
)
def vstar_consistency(fx):
    return au.vstar_consistency(fx["fx_doc_tasks"])


CHUNKS_SQL = """
SELECT request_id,
  coalesce(string_agg(content, '' ORDER BY idx) FILTER (WHERE content IS NOT NULL AND content <> ''), '') AS content,
  nullif(coalesce(string_agg(reasoning, '' ORDER BY idx) FILTER (WHERE reasoning IS NOT NULL AND reasoning <> ''), ''), '')
    AS reasoning,
  arg_max(completion_tokens, idx) FILTER (WHERE completion_tokens IS NOT NULL) AS completion_tokens,
  arg_max(finish_reason, idx) FILTER (WHERE finish_reason IS NOT NULL) AS finish_reason,
  count(*) AS n_chunks"""


@plan("chunk_collapse", "I5", CHUNKS_SQL + "\nFROM fx_chunks GROUP BY request_id", "fx_chunks")
def chunk_collapse(fx):
    return collapse_chunks(fx["fx_chunks"])


@plan(
    "leak_audit", "B21",
    f"SELECT doc_id AS task_id, {_N_LEAK} AS n_leaked, {_LEAKED} AS leaked FROM documents",
)
def leak_audit(fx):
    return au.surface_audit(_doc_tasks(fx)).select("task_id", "n_leaked", "leaked")
