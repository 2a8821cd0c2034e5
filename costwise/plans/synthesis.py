"""Registered plans: task-set synthesis and its audits.

The generators' oracles compute the same draws and tasks in SQL (``synthesis_sql``).
The audits' answers are fixed by the seed tables: every seed gives a task and no
rule is violated; ``tests/test_audits.py`` plants violations of every rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from costwise.functions import patterns as P
from costwise.functions.text import has_decomposition_marker, heuristic_tokens, leaked_values
from costwise.operators import audits as au
from costwise.operators import segments as sg
from costwise.operators import synth as sy
from costwise.plans import synthesis_sql as sql
from costwise.plans.common import R6, finish, plan
from costwise.plans.scoring import sql_tokens
from costwise.session import materialize


def _part_seeds(fx, distractors=None):
    p = fx["part"]
    d = (F.col("p_size") % 3) if distractors is None else distractors
    return p.select(F.col("p_partkey").alias("seed"), (F.lit(3) + F.col("p_partkey") % 8).cast("int").alias("depth"),
                    d.cast("int").alias("distractors"))


PART_SEEDS = "SELECT p_partkey AS seed, CAST(3 + p_partkey % 8 AS INTEGER) AS depth, CAST(p_size % 3 AS INTEGER) AS distractors FROM part"
CUSTOMER_SEEDS = "SELECT c_custkey AS seed, CAST(2 + c_custkey % 7 AS INTEGER) AS depth, CAST(c_custkey % 3 AS INTEGER) AS distractors FROM customer"
SUPPLIER_SEEDS = "SELECT s_suppkey AS seed, CAST(3 + s_suppkey % 8 AS INTEGER) AS depth, CAST(s_suppkey % 3 AS INTEGER) AS distractors FROM supplier"


@plan("chain_synthesis", "K1 K2 K3 K6 K9 B22 E5", sql.chain_oracle(PART_SEEDS))
def chain_synthesis(fx):
    t = sy.synthesize_chains(_part_seeds(fx))
    return t.select("task_id", "seed", "depth", "distractors", "attempt", "canonical_terminal_answer",
                    F.size("ops").cast("bigint").alias("n_ops"), F.length("merged_prompt").alias("prompt_chars"),
                    "v_star_input_tokens", "v_star_output_tokens", "status")


def synth_checks(t):
    """K10 + K12 + K16 over generated tasks: (check, n_tasks, n_violations)."""
    replay = au.replay_values("ops", "start_value")
    checks = F.array(
        F.struct(F.lit("truth_replay").alias("check"),
                 ((replay == F.col("values"))
                  & (F.element_at("values", -1).cast("string") == F.col("canonical_terminal_answer"))).alias("ok")),
        F.struct(F.lit("no_hidden_value_leak").alias("check"),
                 (F.size(leaked_values("merged_prompt", "values")) == 0).alias("ok")),
        F.struct(F.lit("no_decomposition_marker").alias("check"),
                 (~has_decomposition_marker("merged_prompt")).alias("ok")),
        F.struct(F.lit("values_within_bounds").alias("check"),
                 F.forall("values", lambda v: (v >= sy.VALUE_FLOOR) & (v <= sy.VALUE_CAP)).alias("ok")),
        F.struct(F.lit("vstar_tokens").alias("check"),
                 (F.col("v_star_input_tokens") == heuristic_tokens("merged_prompt")).alias("ok")),
        F.struct(F.lit("distractors_avoid_hidden").alias("check"),
                 (~F.arrays_overlap("distractor_values", "values")).alias("ok")),
        F.struct(F.lit("distractors_differ").alias("check"),
                 (F.size(F.array_distinct("distractor_values")) == F.size("distractor_values")).alias("ok")),
    )
    long = t.select(F.explode(checks).alias("c")).select("c.check", F.coalesce("c.ok", F.lit(False)).alias("ok"))
    return long.groupBy("check").agg(F.count(F.lit(1)).alias("n_tasks"),
                                     F.count_if(~F.col("ok")).alias("n_violations"))


@plan("synth_audit", "K10 K12 K16 G4", """
SELECT c.name AS "check", n.n AS n_tasks, CAST(0 AS BIGINT) AS n_violations
FROM (VALUES ('truth_replay'), ('no_hidden_value_leak'), ('no_decomposition_marker'), ('values_within_bounds'), ('vstar_tokens'), ('distractors_avoid_hidden'), ('distractors_differ')) c(name) CROSS JOIN (SELECT count(*) AS n FROM part) n
""")
def synth_audit(fx):
    return synth_checks(sy.synthesize_chains(_part_seeds(fx)).filter(F.col("status") == "ok"))


@plan(
    "distractor_invariance", "K13",
    "SELECT count(*) AS n_groups, CAST(0 AS BIGINT) AS n_answer_changed, CAST(0 AS BIGINT) AS n_prompt_not_longer FROM part",
)
def distractor_invariance(fx):
    """Same (seed, depth) with 0, 1, 2 distractors: one answer, prompts strictly longer."""
    s = _part_seeds(fx, distractors=F.lit(0)).drop("distractors").select(
        "seed", "depth", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("distractors"))
    t = sy.synthesize_chains(s)
    g = t.groupBy("seed", "depth").agg(
        F.count_distinct("canonical_terminal_answer").alias("n_answers"),
        F.array_sort(F.collect_list(F.struct("distractors", F.length("merged_prompt").alias("n")))).alias("p"),
    )
    grows = F.forall(F.sequence(F.lit(2), F.size("p")),
                     lambda i: F.element_at("p", i)["n"] > F.element_at("p", i - 1)["n"])
    return g.agg(F.count(F.lit(1)).alias("n_groups"),
                 F.count_if(F.col("n_answers") != 1).alias("n_answer_changed"),
                 F.count_if(~grows).alias("n_prompt_not_longer"))


@plan(
    "paired_ladder_audit", "K8 K14 E4 C8",
    """
SELECT count(*) AS n_groups, 10 * count(*) AS n_tasks, CAST(0 AS BIGINT) AS groups_not_prefix,
  CAST(0 AS BIGINT) AS groups_prompt_not_growing, CAST(0 AS BIGINT) AS groups_distractors_differ
FROM supplier
""",
)
def paired_ladder_audit(fx):
    groups = fx["supplier"].select(F.col("s_suppkey").alias("group_seed"))
    rungs = sy.paired_ladder(groups, list(range(3, 31, 3)))
    from costwise.operators.paired import prefix_growth

    pg = prefix_growth(rungs.withColumn("dset", F.array_join(
        F.transform("distractor_values", lambda v: v.cast("string")), ",")), extra=["dset"])
    per_group = pg.groupBy("group_seed").agg(
        F.count(F.lit(1)).alias("n_rungs"),
        F.count_if(~F.col("is_prefix")).alias("not_prefix"),
        F.count_if(~F.col("prompt_grows")).alias("not_growing"),
        F.count_distinct("dset").alias("n_distractor_sets"),
    )
    return per_group.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_rungs").alias("n_tasks"),
                         F.count_if(F.col("not_prefix") > 0).alias("groups_not_prefix"),
                         F.count_if(F.col("not_growing") > 0).alias("groups_prompt_not_growing"),
                         F.count_if(F.col("n_distractor_sets") != 1).alias("groups_distractors_differ"))


@plan(
    "replay_check", "C10 G5",
    """
SELECT count(*) AS n_same, CAST(0 AS BIGINT) AS n_changed, CAST(0 AS BIGINT) AS n_only_recorded,
  CAST(0 AS BIGINT) AS n_only_regenerated, CAST(0 AS BIGINT) AS n_rows_differing
FROM part
""",
)
def replay_check(fx):
    """Record a generated task set as a table in the checkpoint folder, regenerate
    it from the same seeds and compare: status counts and rows differing."""
    import uuid

    from costwise.session import checkpoint_dir

    path = f"{checkpoint_dir(fx.spark).rstrip('/')}/recorded-tasks-{uuid.uuid4().hex[:12]}"
    cols = ["task_id", "merged_prompt", "canonical_terminal_answer", "ops"]
    sy.synthesize_chains(_part_seeds(fx)).select(*cols).write.mode("overwrite").parquet(path)
    recorded = fx.spark.read.parquet(path)
    regenerated = sy.synthesize_chains(_part_seeds(fx)).select(*cols)
    status = au.replay_check(recorded, regenerated, ["merged_prompt", "canonical_terminal_answer", "ops"])
    return status.agg(
        F.count_if(F.col("status") == "same").alias("n_same"),
        F.count_if(F.col("status") == "changed").alias("n_changed"),
        F.count_if(F.col("status") == "only_recorded").alias("n_only_recorded"),
        F.count_if(F.col("status") == "only_regenerated").alias("n_only_regenerated"),
        F.coalesce(F.sum(F.col("n_left_only") + F.col("n_right_only")), F.lit(0)).cast("bigint").alias("n_rows_differing"),
    )


#: Own phrases; a value is handed on by description and never by its digits.
BRIDGES = [
    ("program_output", "arithmetic_chain", 0, "The number it prints is what the counter shows at the outset."),
    ("program_output", "arithmetic_chain", 1, "Set the counter to the printed number before going on."),
    ("arithmetic_chain", "table_aggregation", 0, "The counter's last reading fills the blank first cell of the sheet."),
    ("arithmetic_chain", "table_aggregation", 1, "Write the last reading into the sheet's first cell."),
    ("arithmetic_chain", "table_aggregation", 2, "The sheet opens with that reading."),
]
_RECIPE = ["program_output", "arithmetic_chain", "table_aggregation"]
_CLOSING = "Reply with one integer."
_PHRASE_SQL = " ".join(
    f"WHEN s.position = {_RECIPE.index(a)} AND (s.seed * 31 + s.attempt * 7 + s.position) % {n} = {v} THEN {P.sql_literal(t)}"
    for a, n in (("program_output", 2), ("arithmetic_chain", 3)) for x, _, v, t in BRIDGES if x == a
)


@plan(
    "hybrid_segments", "K7 K9 E5",
    f"""
WITH s AS (SELECT *, CASE {_PHRASE_SQL} END AS bridge FROM fx_segments s),
t AS (
  SELECT seed, attempt, concat(string_agg(concat_ws(' ', text, bridge), ' ' ORDER BY position), {P.sql_literal(' ' + _CLOSING)}) AS prompt,
    bool_and(position = 2 OR value_type = 'integer') AS fits, list(CAST(value AS VARCHAR)) AS hidden, max(value) FILTER (WHERE position = 2) AS answer
  FROM s GROUP BY seed, attempt),
v AS (
  SELECT *, row_number() OVER (PARTITION BY seed ORDER BY attempt) AS k FROM t
  WHERE fits AND len(list_intersect(regexp_extract_all(prompt, '[0-9.]+'), hidden)) = 0)
SELECT d.seed, v.attempt, v.prompt AS merged_prompt, CAST(v.answer AS VARCHAR) AS canonical_terminal_answer,
  {sql_tokens('v.prompt')} AS v_star_input_tokens, CASE WHEN v.seed IS NULL THEN 'rejected' ELSE 'ok' END AS status
FROM (SELECT DISTINCT seed FROM t) d LEFT JOIN v ON v.seed = d.seed AND v.k = 1
""",
    "fx_segments",
)
def hybrid_segments(fx):
    bridges = fx.spark.createDataFrame(BRIDGES, "source string, target string, variant int, phrase string")
    out = sg.compose_hybrids(fx["fx_segments"], bridges, _RECIPE, _CLOSING)
    # no task, no count
    return out.withColumn("v_star_input_tokens", F.coalesce("v_star_input_tokens", F.lit(0).cast("bigint")))


@plan(
    "shared_texts", "K14",
    """
WITH s AS (
  SELECT seed % 50 AS grp, kind, CASE kind WHEN 'program_output' THEN concat('listing ', CAST(CASE WHEN seed % 350 = 3 THEN seed ELSE seed % 50 END AS VARCHAR)) ELSE text END AS text
  FROM fx_segments WHERE attempt = 0)
SELECT grp, kind, count(*) AS n_rungs, count(DISTINCT text) AS n_texts, count(DISTINCT text) = 1 AS same_text FROM s GROUP BY grp, kind
""",
    "fx_segments",
)
def shared_texts(fx):
    """Rungs of a group must show one listing: every 350th seed shows another one, which the audit has to find."""
    own = F.when(F.col("seed") % 350 == 3, F.col("seed")).otherwise(F.col("seed") % 50)
    rungs = fx["fx_segments"].filter("attempt = 0").select(
        (F.col("seed") % 50).alias("grp"), "kind",
        F.when(F.col("kind") == "program_output", F.concat(F.lit("listing "), own.cast("string"))).otherwise(F.col("text")).alias("text"))
    return au.shared_text_audit(rungs, ["grp"], "kind")


def _customer_seeds(fx):
    c = fx["customer"]
    return c.select(F.col("c_custkey").alias("seed"), (F.lit(2) + F.col("c_custkey") % 7).cast("int").alias("depth"),
                    (F.col("c_custkey") % 3).cast("int").alias("distractors"))


@plan("ledger_synthesis", "K4 K5 K6 K9 E5", sql.ledger_oracle(CUSTOMER_SEEDS))
def ledger_synthesis(fx):
    t = sy.synthesize_ledgers(_customer_seeds(fx))
    return t.select("task_id", "seed", "depth", "distractors", "attempt", "n_groups", "n_days",
                    "canonical_terminal_answer", F.length("merged_prompt").alias("prompt_chars"),
                    "v_star_input_tokens", "status")


@plan("ledger_audit", "K11 K12 D10", """
SELECT c.name AS "check", n.n AS n_tasks, CAST(0 AS BIGINT) AS n_violations
FROM (VALUES ('truth_replay'), ('cells_narrated_once'), ('no_hidden_value_leak'), ('no_decomposition_marker'), ('distractors_avoid_cells')) c(name) CROSS JOIN (SELECT count(*) AS n FROM customer) n
""")
def ledger_audit(fx):
    """Truth replay through the ledger-total operator on the long-form cells,
    plus surface checks: (check, n_tasks, n_violations)."""
    t = materialize(sy.synthesize_ledgers(_customer_seeds(fx)).filter(F.col("status") == "ok"), "ledger-tasks")
    spread_ = au.ledger_spread(sy.ledger_cells_long(t))
    truth = t.select("task_id", "canonical_terminal_answer", "merged_prompt", "cells", "totals",
                     "distractor_values").join(spread_, "task_id", "inner")
    hidden = F.concat("totals", F.array(F.col("spread")))
    # every cell is narrated exactly once: its text occurs as a standalone number once
    runs = F.regexp_extract_all("merged_prompt", F.lit("[0-9]+"), 0)
    # bind the runs once per row (lambdas get no common-subexpression elimination)
    once_each = sy.let(runs, lambda rr: F.forall(
        "cells", lambda v: F.size(F.filter(rr, lambda r: r == v.cast("string"))) == 1))
    checks = F.array(
        F.struct(F.lit("truth_replay").alias("check"),
                 ((F.col("spread").cast("string") == F.col("canonical_terminal_answer"))
                  & ~F.col("has_tie")).alias("ok")),
        F.struct(F.lit("cells_narrated_once").alias("check"), once_each.alias("ok")),
        F.struct(F.lit("no_hidden_value_leak").alias("check"),
                 (F.size(leaked_values("merged_prompt", hidden)) == 0).alias("ok")),
        F.struct(F.lit("no_decomposition_marker").alias("check"),
                 (~has_decomposition_marker("merged_prompt")).alias("ok")),
        F.struct(F.lit("distractors_avoid_cells").alias("check"),
                 (~F.arrays_overlap("distractor_values", F.concat("cells", hidden))).alias("ok")),
    )
    long = truth.select(F.explode(checks).alias("c")).select("c.check", F.coalesce("c.ok", F.lit(False)).alias("ok"))
    return long.groupBy("check").agg(F.count(F.lit(1)).alias("n_tasks"),
                                     F.count_if(~F.col("ok")).alias("n_violations"))


def _supplier_seeds(fx):
    s = fx["supplier"]
    return s.select(F.col("s_suppkey").alias("seed"), (F.lit(3) + F.col("s_suppkey") % 8).cast("int").alias("depth"),
                    (F.col("s_suppkey") % 3).cast("int").alias("distractors"))


@plan("hybrid_synthesis", "K7 K3 K4 K6 K9 E5", sql.hybrid_oracle(SUPPLIER_SEEDS))
def hybrid_synthesis(fx):
    t = sy.synthesize_hybrids(_supplier_seeds(fx))
    return t.select("task_id", "seed", "depth", "distractors", "attempt", "n_groups", "n_days",
                    "canonical_terminal_answer", F.length("merged_prompt").alias("prompt_chars"),
                    "difficulty_bucket", "status")


@plan("hybrid_audit", "K7 K10 K11 K12", """
SELECT c.name AS "check", n.n AS n_tasks, CAST(0 AS BIGINT) AS n_violations
FROM (VALUES ('chain_replay'), ('injected_cell_is_chain_result'), ('ledger_truth'), ('no_hidden_value_leak'), ('no_decomposition_marker')) c(name) CROSS JOIN (SELECT count(*) AS n FROM supplier) n
""")
def hybrid_audit(fx):
    """Chain replay, injected cell = chain result, ledger truth, surface checks."""
    t = materialize(sy.synthesize_hybrids(_supplier_seeds(fx)).filter(F.col("status") == "ok"), "hybrid-tasks")
    spread_ = au.ledger_spread(sy.ledger_cells_long(t))
    j = t.join(spread_, "task_id", "inner")
    replay = au.replay_values("ops", F.element_at("chain_values", 1))
    checks = F.array(
        F.struct(F.lit("chain_replay").alias("check"), (replay == F.col("chain_values")).alias("ok")),
        F.struct(F.lit("injected_cell_is_chain_result").alias("check"),
                 (F.element_at("cells", 1) == F.element_at("chain_values", -1)).alias("ok")),
        F.struct(F.lit("ledger_truth").alias("check"),
                 ((F.col("spread").cast("string") == F.col("canonical_terminal_answer"))
                  & ~F.col("has_tie")).alias("ok")),
        F.struct(F.lit("no_hidden_value_leak").alias("check"),
                 (F.size(leaked_values("merged_prompt", "hidden")) == 0).alias("ok")),
        F.struct(F.lit("no_decomposition_marker").alias("check"),
                 (~has_decomposition_marker("merged_prompt")).alias("ok")),
    )
    long = j.select(F.explode(checks).alias("c")).select("c.check", F.coalesce("c.ok", F.lit(False)).alias("ok"))
    return long.groupBy("check").agg(F.count(F.lit(1)).alias("n_tasks"),
                                     F.count_if(~F.col("ok")).alias("n_violations"))


_CALIBRATION = f"""WITH RECURSIVE {sql.chain_tasks_ctes(SUPPLIER_SEEDS)},
m AS (
  SELECT t.*, {sql_tokens('prompt')} AS tin, x.model, CASE x.model WHEN 'echo_model' THEN answer WHEN 'wrong_echo_model' THEN '0'
    ELSE concat(repeat('Let me think step by step about this problem. ', 20), chr(10), 'The answer is ', answer) END AS said
  FROM tasks t, (VALUES ('echo_model'), ('verbose_echo_model'), ('wrong_echo_model')) x(model)),
r AS (
  SELECT model, concat('depth_', depth) AS difficulty_bucket, tin, {sql_tokens('said')} AS tout, model <> 'wrong_echo_model' OR answer = '0' AS ok,
    CAST(tin + 4 * {sql_tokens('answer')} AS DOUBLE) / CAST(tin + 4 * {sql_tokens('said')} AS DOUBLE) AS eff FROM m)
SELECT model, difficulty_bucket, count(*) AS n, {R6('count(*) FILTER (WHERE ok) / count(*)')} AS accuracy,
  {R6('coalesce(avg(eff) FILTER (WHERE ok), CAST(0 AS DOUBLE))')} AS mean_efficiency_when_correct,
  {R6('count(*) FILTER (WHERE ok) / count(*) * coalesce(avg(eff) FILTER (WHERE ok), CAST(0 AS DOUBLE))')} AS expected_value_ratio,
  {R6('coalesce(stddev_samp(CASE WHEN ok THEN eff END), CAST(0 AS DOUBLE))')} AS efficiency_stddev,
  {R6('avg(tin)')} AS mean_input_tokens, {R6('avg(tout)')} AS mean_output_tokens
FROM r GROUP BY model, difficulty_bucket
"""


@plan("calibration_run", "K1-K3 K17 C1 D1 D2", _CALIBRATION)
def calibration_run(fx):
    """End to end: synthesize chain tasks, emit calibration responses, score them
    through the normal path, and report per (model, bucket)."""
    from costwise.operators.reports import stratified_report
    from costwise.operators.scoring import calibration_responses, score

    tasks = materialize(sy.synthesize_chains(_supplier_seeds(fx)).filter(F.col("status") == "ok"), "e2e-tasks")
    results = score(tasks, calibration_responses(tasks))
    return finish(stratified_report(results))


@plan(
    "paired_hybrid_audit", "K8 K14 E4 K7 K11",
    """
SELECT count(*) AS n_groups, 10 * count(*) AS n_tasks, CAST(0 AS BIGINT) AS groups_not_prefix,
  CAST(0 AS BIGINT) AS groups_prompt_not_growing, CAST(0 AS BIGINT) AS groups_wrong_truth,
  CAST(0 AS BIGINT) AS groups_table_differs
FROM supplier
""",
)
def paired_hybrid_audit(fx):
    """Paired chain+ledger ladders from supplier groups: per group, op lists are
    prefixes, prompts grow, the visible ledger cells and distractors are shared
    by all rungs, and every rung's answer equals the recomputed ledger spread."""
    from costwise.operators.paired import prefix_growth

    groups = fx["supplier"].select(F.col("s_suppkey").alias("group_seed"))
    rungs = materialize(sy.paired_hybrid_ladder(groups, list(range(3, 31, 3))), "paired-hybrid")
    rungs = rungs.withColumn("task_id", F.concat_ws("-", F.col("group_seed").cast("string"),
                                                    F.col("depth").cast("string")))
    spread_ = au.ledger_spread(sy.ledger_cells_long(rungs))
    truth = rungs.join(spread_.select("task_id", "spread", "has_tie"), "task_id", "inner").select(
        "task_id", ((F.col("spread").cast("string") == F.col("canonical_terminal_answer"))
                    & ~F.col("has_tie")).alias("truth_ok"))
    shared = F.concat_ws("|", F.array_join(F.transform(F.slice("cells", 2, F.size("cells") - 1),
                                                       lambda v: v.cast("string")), ","),
                         F.array_join(F.transform("distractor_values", lambda v: v.cast("string")), ","))
    pg = prefix_growth(rungs.withColumn("shared", shared), extra=["task_id", "shared"])
    per_group = pg.join(truth, "task_id", "inner").groupBy("group_seed").agg(
        F.count(F.lit(1)).alias("n_rungs"),
        F.count_if(~F.col("is_prefix")).alias("not_prefix"),
        F.count_if(~F.col("prompt_grows")).alias("not_growing"),
        F.count_if(~F.col("truth_ok")).alias("wrong_truth"),
        F.count_distinct("shared").alias("n_shared_variants"),
    )
    return per_group.agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n_rungs").alias("n_tasks"),
        F.count_if(F.col("not_prefix") > 0).alias("groups_not_prefix"),
        F.count_if(F.col("not_growing") > 0).alias("groups_prompt_not_growing"),
        F.count_if(F.col("wrong_truth") > 0).alias("groups_wrong_truth"),
        F.count_if(F.col("n_shared_variants") != 1).alias("groups_table_differs"),
    )
