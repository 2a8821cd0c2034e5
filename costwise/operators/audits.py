"""Audits over recorded tasks: truth replay, ledger totals, surface-form checks
(B20, B21, D10, K10-K12, K15, K16, C10, G5).

Replays fold over one task's own op list (bounded by the chain depth), so the
per-task arrays are small; everything else is a projection or a hash
aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costwise.functions.text import has_decomposition_marker, heuristic_tokens, leaked_values

# Fixed values that must equal the reference for identical results:
#   chain ops: gain v + k, loss v - k, scale v * k, split v // k (floor division)
#   value bounds of generated chains: 2 .. 500,000
VALUE_MIN = 2
VALUE_MAX = 500_000

_STEP = (
    "CASE o.op WHEN 'gain' THEN acc.v + o.k WHEN 'loss' THEN acc.v - o.k "
    "WHEN 'scale' THEN acc.v * o.k ELSE (acc.v - pmod(acc.v, o.k)) div o.k END"
)


def replay_ops(ops: DataFrame) -> DataFrame:
    """Recompute running values from long-form op logs.

    ``ops``: (task_id, start_value, seq, op, k). Output per task: number of ops,
    final value, smallest and largest running value (start included)."""
    per_task = ops.groupBy("task_id").agg(
        F.first("start_value").alias("start_value"),
        F.array_sort(F.collect_list(F.struct(
            F.col("seq").cast("bigint").alias("seq"), "op", F.col("k").cast("bigint").alias("k")))).alias("ops"),
    )
    fold = F.expr(
        "aggregate(ops, named_struct('v', start_value, 'lo', start_value, 'hi', start_value), "
        f"(acc, o) -> named_struct('v', {_STEP}, "
        f"'lo', least(acc.lo, {_STEP}), 'hi', greatest(acc.hi, {_STEP})))"
    )
    return per_task.select(
        "task_id", F.size("ops").cast("bigint").alias("n_ops"), fold.alias("r")
    ).select("task_id", "n_ops", F.col("r.v").alias("final_value"),
             F.col("r.lo").alias("min_value"), F.col("r.hi").alias("max_value"))


def replay_values(ops_array: str | Column, start: str | Column) -> Column:
    """All running values of one recorded op list (array<struct<name,k>>), start first."""
    ops = F.col(ops_array) if isinstance(ops_array, str) else ops_array
    s = F.col(start) if isinstance(start, str) else start
    return F.aggregate(
        ops, F.array(s.cast("bigint")),
        lambda acc, o: F.concat(acc, F.array(
            F.when(o["name"] == "gain", F.element_at(acc, -1) + o["k"])
            .when(o["name"] == "loss", F.element_at(acc, -1) - o["k"])
            .when(o["name"] == "scale", F.element_at(acc, -1) * o["k"])
            .otherwise(((F.element_at(acc, -1) - F.pmod(F.element_at(acc, -1), o["k"])).cast("decimal(38,0)")
                        / o["k"].cast("decimal(38,0)")).cast("bigint"))
        )),
    )


def ledger_spread(cells: DataFrame) -> DataFrame:
    """Per task the group totals' spread (max - min) and whether two
    groups tie. ``cells``: (task_id, grp, day_idx, value)."""
    totals = cells.groupBy("task_id", "grp").agg(F.sum("value").alias("total"))
    return totals.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.max("total").alias("max_total"),
        F.min("total").alias("min_total"),
        (F.max("total") - F.min("total")).alias("spread"),
        (F.count_distinct("total") < F.count(F.lit(1))).alias("has_tie"),
    )


def surface_audit(tasks: DataFrame, text_col: str = "merged_prompt", hidden_col: str = "hidden") -> DataFrame:
    """B20 + B21 (+ K15 when ``text_col`` is a program listing): per task, marker
    present and which hidden values leak as standalone numbers."""
    leaked = leaked_values(text_col, hidden_col)
    return tasks.select(
        "task_id",
        has_decomposition_marker(text_col).alias("has_marker"),
        F.size(leaked).cast("bigint").alias("n_leaked"),
        F.array_join(F.transform(leaked, lambda v: v.cast("string")), ",").alias("leaked"),
    )


def validity_audit(tasks: DataFrame) -> DataFrame:
    """One (check, n_tasks, n_violations) row per rule, from one pass.

    ``tasks``: (task_id, merged_prompt, hidden array<bigint>, answer bigint)."""
    checks = F.array(
        F.struct(F.lit("no_decomposition_marker").alias("check"),
                 (~has_decomposition_marker("merged_prompt")).alias("ok")),
        F.struct(F.lit("no_hidden_value_leak").alias("check"),
                 (F.size(leaked_values("merged_prompt", "hidden")) == 0).alias("ok")),
        F.struct(F.lit("answer_within_bounds").alias("check"),
                 F.coalesce(F.col("answer").between(VALUE_MIN, VALUE_MAX), F.lit(False)).alias("ok")),
        F.struct(F.lit("prompt_not_empty").alias("check"),
                 (F.length("merged_prompt") > 0).alias("ok")),
    )
    long = tasks.select("task_id", F.explode(checks).alias("c")).select("task_id", "c.check", "c.ok")
    return long.groupBy("check").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.count_if(~F.col("ok")).alias("n_violations"),
    )


def vstar_consistency(tasks: DataFrame, tokenizer=heuristic_tokens) -> DataFrame:
    """Stored V* input tokens equal the tokenizer's count of the prompt."""
    recomputed = tokenizer(F.col("merged_prompt"))
    return tasks.select(
        "task_id", "v_star_input_tokens", recomputed.alias("recomputed_input_tokens"),
        (F.col("v_star_input_tokens") == recomputed).alias("consistent"),
    )


def _signed(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of both sides under one roof: +1 from ``a``, -1 from ``b``."""
    return a.select(*cols, F.lit(1).alias("_sign")).unionByName(b.select(*cols, F.lit(-1).alias("_sign")))


def replay_check(recorded: DataFrame, regenerated: DataFrame, compare: list[str]) -> DataFrame:
    """Two task sets compared by task_id in one pass (bag semantics within a task).

    Per task: status, and how many of its rows only one side has. Rows meet as a 128-bit digest of the compared
    columns with a sign: what both sides have cancels out. One exchange, by task, carries digests and no texts."""
    digest = [F.xxhash64(*compare).alias("_d1"), F.xxhash64(F.lit("row"), *reversed(compare)).alias("_d2")]
    narrow = _signed(recorded.select("task_id", *digest), regenerated.select("task_id", *digest), ["task_id", "_d1", "_d2"])
    net = narrow.repartition("task_id").groupBy("task_id", "_d1", "_d2").agg(
        F.sum("_sign").alias("net"), F.count_if(F.col("_sign") > 0).alias("a"), F.count_if(F.col("_sign") < 0).alias("b")
    )
    per_task = net.groupBy("task_id").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"),
        F.sum(F.greatest("net", F.lit(0))).alias("n_left_only"), F.sum(F.greatest(-F.col("net"), F.lit(0))).alias("n_right_only"),
    )
    status = (
        F.when(F.col("b") == 0, F.lit("only_recorded")).when(F.col("a") == 0, F.lit("only_regenerated"))
        .when(F.col("n_left_only") + F.col("n_right_only") == 0, F.lit("same")).otherwise(F.lit("changed"))
    )
    return per_task.select("task_id", status.alias("status"), "n_left_only", "n_right_only")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side missing from the other (bag semantics); empty when equal.

    A signed union and one aggregation by the whole row: what both sides have cancels out."""
    net = _signed(a, b, a.columns).groupBy(*a.columns).agg(F.sum("_sign").alias("_net")).filter(F.col("_net") != 0)
    side = F.when(F.col("_net") > 0, F.lit("left_only")).otherwise(F.lit("right_only"))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("_net")))
    return net.withColumn("_copy", copies).select(*a.columns, side.alias("side"))


def shared_text_audit(segments: DataFrame, group: list[str], part: str, text: str = "text") -> DataFrame:
    """Per group and part, how many rungs carry it and whether its text is the same on all of them.

    Texts are compared by their SHA-256, so the exchange carries digests (one for each group, part and variant)."""
    variants = segments.groupBy(*group, part, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_h")).agg(F.count(F.lit(1)).alias("n"))
    return variants.groupBy(*group, part).agg(
        F.sum("n").alias("n_rungs"), F.count(F.lit(1)).alias("n_texts"), (F.count(F.lit(1)) == 1).alias("same_text")
    )
