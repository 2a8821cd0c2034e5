"""Evidence audits over results.

All of them reduce the fact table with hash aggregates first; comparisons
between configurations run on the reduced per-model tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costwise.functions.answers import is_sum
from costwise.functions.buckets import depth_from_bucket
from costwise.functions.cost import to_dollars
from costwise.functions.spec import split_spec
from costwise.functions.text import utf8_bytes
from costwise.operators.ladder import latest_per_key
from costwise.sources.prices import attach_prices


def coverage(results: DataFrame) -> DataFrame:
    """Rows per config vs the number of distinct tasks in the run.

    Two pruned scans of (model, task_id): with columnar pruning the second scan
    reads only those two columns, which is cheaper than materializing the
    (model, task) pairs, since they are nearly unique."""
    per_model = results.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("task_id").alias("n_tasks"),
    )
    expected = results.select(F.count_distinct("task_id").alias("expected_tasks"))
    # scalar subquery: one value, no join
    exp = expected.scalar()
    return per_model.select(
        "model", "n_rows", "n_tasks", exp.alias("expected_tasks"),
        (F.col("n_rows") - F.col("n_tasks")).alias("n_duplicate_rows"),
        (F.col("n_tasks") / exp).alias("coverage"),
    )


def finish_reasons(normalised: DataFrame) -> DataFrame:
    """Responses per (model, finish reason); NULL reason kept as its own row."""
    return normalised.groupBy("model", "finish_reason").agg(F.count(F.lit(1)).alias("n"))


def answer_audit(normalised: DataFrame) -> DataFrame:
    """Refused, cut-off and empty answers per config."""
    return normalised.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("refusal").isNotNull()).alias("n_refused"),
        F.count_if(F.col("finish_reason") == "length").alias("n_truncated"),
        F.count_if(F.trim("text") == "").alias("n_empty"),
    )


def reasoning_evidence(normalised: DataFrame) -> DataFrame:
    """Hidden reasoning per config and knob setting: mean tokens, rows that
    report them, rows that bring reasoning text, rows without usage."""
    spec = split_spec("model")
    return normalised.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("reasoning_tokens").alias("mean_reasoning_tokens"),
        F.count("reasoning_tokens").alias("n_with_reasoning_tokens"),
        F.count("reasoning_content").alias("n_with_reasoning_text"),
        F.count_if(~F.col("provider_usage")).alias("n_without_usage"),
    ).select(spec["model_id"].alias("model_id"), spec["knob_value"].alias("knob_value"), "*")


def most_missed(results: DataFrame, order: Sequence[str], k: int = 20) -> DataFrame:
    """D14 + F3: the k tasks most models got wrong (ties by task).

    A model counts once per task, with its last record by ``order``."""
    last = latest_per_key(results.select("task_id", "model", "terminal_correct", *[c for c in order if c != "terminal_correct"]),
                          ["task_id", "model"], order)
    per_task = last.groupBy("task_id").agg(
        F.count_if(~F.col("terminal_correct")).alias("n_wrong"),
        F.count(F.lit(1)).alias("n_models"),
    )
    return per_task.orderBy(F.col("n_wrong").desc(), "task_id").limit(k)


def shared_wrong(results: DataFrame, min_models: int = 2) -> DataFrame:
    """The same wrong parsed value on the same task from >= min_models configs.

    Models are collected per (task, value) group; the set is bounded by the
    number of configurations and de-duplicated map-side before the shuffle."""
    wrong = results.filter(~F.col("terminal_correct") & F.col("parsed_terminal").isNotNull())
    g = wrong.groupBy("task_id", "parsed_terminal").agg(F.array_sort(F.collect_set("model")).alias("m"))
    return g.filter(F.size("m") >= min_models).select(
        "task_id", "parsed_terminal", F.size("m").cast("bigint").alias("n_models"), F.array_join("m", ",").alias("models"))


def absorption(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Wrong answers whose error equals +/- one of the task's distractor values.

    ``tasks`` carries (task_id, distractor_values array<bigint>)."""
    j = results.filter(~F.col("terminal_correct")).select(
        "task_id", "model", "parsed_terminal", "expected_terminal",
    ).join(tasks.select("task_id", "distractor_values"), "task_id", "inner")
    value = F.rlike("parsed_terminal", F.lit("^-?[0-9]+$")) & F.rlike("expected_terminal", F.lit("^-?[0-9]+$"))
    off_by = lambda d: (  # noqa: E731 - exact at any length
        is_sum(F.col("parsed_terminal"), F.col("expected_terminal"), d.cast("string"))
        | is_sum(F.col("expected_terminal"), F.col("parsed_terminal"), d.cast("string")))
    hit = F.when(value, F.exists("distractor_values", off_by))
    return j.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_wrong"),
        F.count_if(F.coalesce(hit, F.lit(False))).alias("n_absorbed"),
    )


def ideal_floor(tasks: DataFrame, prices: DataFrame) -> DataFrame:
    """V* tokens priced at the cheapest rates of the sheet, mean per depth.

    The two minima are scalar subqueries over the sheet (no join)."""
    min_in = prices.select(F.min("price_in")).scalar()
    min_out = prices.select(F.min("price_out")).scalar()
    units = (F.col("v_star_input_tokens").cast("double") * min_in
             + F.col("v_star_output_tokens").cast("double") * min_out)
    return tasks.groupBy("depth").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.avg(to_dollars(units)).alias("ideal_dollars"),
    )


def spread(dollars: DataFrame) -> DataFrame:
    """Cheapest and dearest $/correct across configs and their ratio."""
    d = dollars.filter(F.col("dollars_per_correct").isNotNull())
    return d.agg(
        F.min_by("model", F.struct("dollars_per_correct", "model")).alias("cheapest_model"),
        F.min("dollars_per_correct").alias("min_dollars_per_correct"),
        F.max_by("model", F.struct("dollars_per_correct", F.col("model"))).alias("dearest_model"),
        F.max("dollars_per_correct").alias("max_dollars_per_correct"),
        (F.max("dollars_per_correct") / F.min("dollars_per_correct")).alias("spread"),
    )


def knob_exchange(dollars: DataFrame) -> DataFrame:
    """Accuracy gained and cost ratio between every two settings of one base model
    (plain against a knob, and knob against knob where there is no plain row).

    The settings of a base model are gathered into one array, which the number of
    its configurations bounds, so the per-model summary is computed once and not
    joined with itself. Of a pair the plain setting, else the cheaper one, is the base."""
    s = dollars.withColumn("spec", split_spec("model")).select(
        F.col("spec.provider").alias("provider"), F.col("spec.model_id").alias("model_id"),
        F.struct(
            F.col("spec.knob").isNotNull().alias("knobbed"),
            F.coalesce("dollars_per_correct", F.lit(float("inf"))).alias("price"),
            "model", F.col("spec.knob").alias("knob"), F.col("spec.knob_value").alias("knob_value"),
            "accuracy", "dollars_per_correct",
        ).alias("row"),
    )
    rows = s.groupBy("provider", "model_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    pairs = F.flatten(F.transform(
        "rows", lambda base, i: F.transform(
            F.slice("rows", i + 2, F.size("rows")), lambda other: F.struct(base.alias("base"), other.alias("other")))))
    j = rows.select(F.explode(pairs).alias("p"))
    return j.select(
        F.col("p.other.model").alias("model"), F.col("p.base.model").alias("base_model"),
        F.col("p.other.knob").alias("knob"), F.col("p.other.knob_value").alias("knob_value"),
        F.col("p.base.knob_value").alias("base_knob_value"),
        (F.col("p.other.accuracy") - F.col("p.base.accuracy")).alias("accuracy_delta"),
        (F.col("p.other.dollars_per_correct") / F.col("p.base.dollars_per_correct")).alias("cost_ratio"),
    )


def cheapest_over_bar(dollars: DataFrame, accuracy_bar: float) -> DataFrame:
    """The cheapest config whose accuracy reaches the bar (one row, or none)."""
    d = dollars.filter((F.col("accuracy") >= F.lit(float(accuracy_bar)))
                       & F.col("dollars_per_correct").isNotNull())
    best = d.agg(F.min(F.struct("dollars_per_correct", "model", "accuracy")).alias("b"),
                 F.count(F.lit(1)).alias("n_eligible"))
    return best.filter(F.col("n_eligible") > 0).select(
        F.col("b.model").alias("model"), F.col("b.dollars_per_correct").alias("dollars_per_correct"),
        F.col("b.accuracy").alias("accuracy"), "n_eligible",
    )


def dominated_configs(dollars: DataFrame) -> DataFrame:
    """Configs beaten by another with >= accuracy and strictly lower $/correct.

    Skyline by a running maximum instead of a pairwise self-join: order the
    per-model table by $/correct, collapse equal prices, and compare each
    accuracy with the best accuracy among strictly cheaper prices."""
    d = dollars.filter(F.col("dollars_per_correct").isNotNull()).select(
        "model", "accuracy", "dollars_per_correct")
    per_price = d.groupBy("dollars_per_correct").agg(F.max("accuracy").alias("acc_at_price"))
    w = Window.orderBy("dollars_per_correct").rowsBetween(Window.unboundedPreceding, -1)
    best_cheaper = per_price.select(
        "dollars_per_correct", F.max("acc_at_price").over(w).alias("best_cheaper_accuracy"))
    j = d.join(best_cheaper, "dollars_per_correct", "inner")
    return j.select(
        "model", "accuracy", "dollars_per_correct", "best_cheaper_accuracy",
        F.coalesce(F.col("best_cheaper_accuracy") >= F.col("accuracy"), F.lit(False)).alias("dominated"),
    )


def bytes_per_correct(results: DataFrame) -> DataFrame:
    """UTF-8 response bytes per correct answer, tokenizer independent."""
    return results.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("terminal_correct").alias("n_correct"),
        F.sum(utf8_bytes("response_text")).alias("total_bytes"),
    ).withColumn(
        "bytes_per_correct",
        F.when(F.col("n_correct") > 0, F.col("total_bytes") / F.col("n_correct")),
    )


def ci_width(results: DataFrame, z: float = 1.96, max_half_width: float = 0.02) -> DataFrame:
    """95% CI of mean efficiency per (model, generator_version, bucket) and a
    flag to sample more when the half-width exceeds the target."""
    keys = [c for c in ("model", "generator_version", "difficulty_bucket") if c in results.columns]
    g = results.filter(F.col("efficiency").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_correct"),
        F.avg("efficiency").alias("mean_efficiency"),
        F.stddev_samp("efficiency").alias("sd"),
    )
    half = F.lit(float(z)) * F.col("sd") / F.sqrt(F.col("n_correct").cast("double"))
    low, high = F.col("mean_efficiency") - half, F.col("mean_efficiency") + half
    # configs are ranked only past each other's interval: the rank counts those whose lower bound lies above the
    # own upper bound. A sweep over all bounds of a cell from the top counts the lower ones met; at equal values
    # upper bounds come first, so that touching intervals overlap.
    bounds = F.array(F.struct(high.alias("at"), F.lit(0).alias("lower")), F.struct(low.alias("at"), F.lit(1).alias("lower")))
    sweep = Window.partitionBy(*[k for k in keys if k != "model"]).orderBy(F.col("b.at").desc_nulls_last(), "b.lower", "model").rowsBetween(
        Window.unboundedPreceding, -1)
    met = F.coalesce(F.sum(F.when(F.col("b.at").isNotNull(), F.col("b.lower"))).over(sweep), F.lit(0).cast("bigint"))
    g = g.withColumn("b", F.explode(bounds)).withColumn("met", met).filter(F.col("b.lower") == 0)
    g = g.withColumn("ci_high", high).withColumn("overlap_rank", F.when(high.isNotNull(), F.col("met") + 1).cast("bigint"))
    return g.select(
        *keys, "overlap_rank", "n_correct", "mean_efficiency", half.alias("half_width"),
        low.alias("ci_low"), "ci_high",
        F.coalesce(half > F.lit(float(max_half_width)), F.lit(True)).alias("sample_more"),
    )


def saturated_cells(report: DataFrame, min_accuracy: float = 0.95, max_sd: float = 0.05) -> DataFrame:
    """Cells of the stratified report where accuracy is near 1 and spread is tight."""
    return report.filter((F.col("accuracy") >= F.lit(float(min_accuracy)))
                         & (F.col("efficiency_stddev") <= F.lit(float(max_sd))))


def spend_by_depth(results: DataFrame, prices: DataFrame) -> DataFrame:
    """Mean $ per task per (model, depth) for priced models."""
    g = results.groupBy("model", depth_from_bucket("difficulty_bucket").alias("depth")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("input_tokens").alias("sum_input_tokens"),
        F.sum("output_tokens").alias("sum_output_tokens"),
    )
    p = attach_prices(g, prices).filter(F.col("priced"))
    units = (F.col("sum_input_tokens").cast("double") * F.col("price_in")
             + F.col("sum_output_tokens").cast("double") * F.col("price_out"))
    return p.select("model", "depth", "n", (to_dollars(units) / F.col("n")).alias("mean_dollars_per_task"))

