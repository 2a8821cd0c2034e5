"""Run control as data: work grid, pending pairs, latest record, depth-ladder pruning
(C2, C3, D8, D9, E1).

The ladder's prune/stop decisions are computed in closed form from recorded
results, with no driver loop: a config's prune flag at a rung depends only on
that (model, depth) cell, a config is alive at a rung when it was not flagged
at any shallower rung, and the ladder stops at the first rung where the
pruned share of alive configs exceeds the majority threshold. All windows run
on the reduced (model x rung) table, never on the fact table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costwise.params import (
    LADDER_DEPTHS,
    LADDER_STOP_ACCURACY,
    LADDER_STOP_EFFICIENCY,
    LADDER_STOP_MAJORITY,
)


def roster_column(models: Sequence[str]) -> F.Column:
    """One row per roster model when exploded (a generator, not a join)."""
    return F.explode(F.array(*[F.lit(m) for m in models]))


def work_grid(tasks: DataFrame, models: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Every (task, model) pair of the roster."""
    return tasks.select("task_id", *keep, roster_column(models).alias("model"))


def pending_pairs(tasks: DataFrame, results: DataFrame, models: Sequence[str]) -> DataFrame:
    """Roster pairs with no recorded result.

    Rather than materialising and shuffling the whole tasks x roster grid for
    an anti-join, each task's recorded roster models are collected (a set
    bounded by the roster, de-duplicated map-side) and the missing ones are
    exploded per task. Only results and task ids are shuffled, both hash
    partitioned on task_id, so the join adds no exchange."""
    roster = F.array(*[F.lit(m) for m in models])
    done = results.filter(F.col("model").isin(*models)).groupBy("task_id").agg(
        F.collect_set("model").alias("done"))
    t = tasks.select("task_id").distinct().join(done, "task_id", "left")
    todo = F.array_except(roster, F.coalesce(F.col("done"), F.array().cast("array<string>")))
    return t.select("task_id", F.explode(todo).alias("model"))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, keep_order: bool = True) -> DataFrame:
    """The last record per key by an explicit order (file order is not defined).

    Without ``keep_order`` the ordering columns are left out of the result, and travel once instead of twice.

    ``max_by`` over a struct of the ordering columns is reduced on every map task
    before the shuffle, so a key that holds a large share of the rows is no hot
    spot. The aggregate's buffer holds whole rows (strings among them), which
    Spark keeps in a sort aggregate on either side of the exchange."""
    others = [c for c in df.columns if c not in keys and (keep_order or c not in order)]
    ordering = F.struct(*[F.col(c) for c in order])
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in others]), ordering).alias("_r"))
    return agg.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def rung_stats(
    results: DataFrame, tasks: DataFrame, models: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Per (model, rung depth) over the roster grid: recorded count, accuracy
    (0.0 when nothing is recorded) and mean efficiency of correct answers.

    A pair counts once, with its last record, and only if its task is one of
    ``tasks`` (task_id, depth), which also says how deep it is."""
    own = results.filter(F.col("model").isin(*models)).select(
        "task_id", "model", "terminal_correct", "efficiency",
        *[c for c in order if c not in ("terminal_correct", "efficiency")])
    recorded = latest_per_key(own, ["task_id", "model"], order).join(tasks, "task_id").groupBy("model", "depth").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("terminal_correct").alias("n_correct"),
        F.avg("efficiency").alias("mean_efficiency"),
    )
    grid = tasks.select("depth").distinct().select("depth", roster_column(models).alias("model"))
    cells = grid.join(recorded, ["model", "depth"], "left")
    return cells.select(
        "model", "depth",
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
        F.coalesce("n_correct", F.lit(0).cast("bigint")).alias("n_correct"),
        F.coalesce(F.col("n_correct") / F.col("n"), F.lit(0.0)).alias("accuracy"),
        "mean_efficiency",
    )


def ladder(
    results: DataFrame,
    tasks: DataFrame,
    models: Sequence[str],
    *,
    order: Sequence[str] = ("seq",),
    depths: Sequence[int] = LADDER_DEPTHS,
    stop_accuracy: float = LADDER_STOP_ACCURACY,
    stop_efficiency: float = LADDER_STOP_EFFICIENCY,
    majority: float = LADDER_STOP_MAJORITY,
) -> DataFrame:
    """Rungs actually evaluated, with prune flags and the early-stop rung.

    ``results`` carries (task_id, model, terminal_correct, efficiency) and the
    columns of ``order``, by which the last record of a pair is the one that
    counts. ``tasks`` carries (task_id, depth) of every task, so rungs without
    tasks are skipped. Output: one row per (alive model, evaluated rung)."""
    on_ladder = tasks.select("task_id", "depth").filter(F.col("depth").isin(*depths)).distinct()
    cells = rung_stats(results, on_ladder, models, order)
    acc, eff = F.col("accuracy"), F.col("mean_efficiency")
    reason = (
        F.when(acc <= F.lit(float(stop_accuracy)), F.lit("accuracy"))
        .when(eff.isNotNull() & (eff < F.lit(float(stop_efficiency))), F.lit("efficiency"))
    )
    cells = cells.withColumn("prune_reason", reason).withColumn("flag", F.col("prune_reason").isNotNull())
    earlier = Window.partitionBy("model").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn(
        "alive", F.coalesce(F.sum(F.col("flag").cast("int")).over(earlier), F.lit(0)) == 0)
    per_rung = cells.groupBy("depth").agg(
        F.count_if("alive").alias("alive_count"),
        F.count_if(F.col("alive") & F.col("flag")).alias("pruned_count"),
    )
    stops = per_rung.withColumn(
        "stop_here",
        (F.col("pruned_count") / F.greatest(F.col("alive_count"), F.lit(1)) > F.lit(float(majority)))
        | (F.col("alive_count") == F.col("pruned_count")),
    )
    stop_depth = stops.filter("stop_here").select(F.min("depth")).scalar()
    evaluated = cells.filter("alive").join(stops, "depth", "inner").filter(
        stop_depth.isNull() | (F.col("depth") <= stop_depth))
    return evaluated.select(
        "model", "depth", "n", "n_correct", "accuracy", "mean_efficiency",
        F.col("flag").alias("pruned"), "prune_reason", "alive_count", "pruned_count",
        (F.col("depth") == F.coalesce(stop_depth, F.lit(-1))).alias("stopped_here"),
    )
