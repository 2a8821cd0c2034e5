"""Grading tasks x responses into the results table.

Plan shape: the task side is reduced to the columns grading needs, and the
prompt's local token count is computed there (a bigint travels through the
join instead of the prompt text). The join on ``task_id`` is a plain equi-join:
AQE picks broadcast when the task side is small and splits skewed partitions
when one task has many responses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costwise.functions.answers import consistency_fields, grade_consistency, grade_exact, last_integer
from costwise.functions.cost import efficiency, weighted_cost
from costwise.functions.text import heuristic_tokens
from costwise.params import DEFAULT_WEIGHTS

# Scorer plug-ins: template_id -> (text, expected) -> (parsed, correct).
Scorer = Callable[[Column, Column], tuple[Column, Column]]


def _integer_scorer(text: Column, expected: Column) -> tuple[Column, Column]:
    parsed = last_integer(text)
    return parsed, grade_exact(parsed, expected)


def _consistency_scorer(text: Column, expected: Column) -> tuple[Column, Column]:
    fields = consistency_fields(text)
    return fields["verdict"], grade_consistency(fields)


SCORERS: dict[str, Scorer] = {"consistency": _consistency_scorer}
DEFAULT_SCORER: Scorer = _integer_scorer


def register_scorer(template_id: str, scorer: Scorer) -> None:
    SCORERS[template_id] = scorer


def _dispatch(template: Column, text: Column, expected: Column) -> tuple[Column, Column]:
    """Fold the registry into one CASE per output (B10): one scan, one projection."""
    parsed, correct = DEFAULT_SCORER(text, expected)
    for tid, fn in SCORERS.items():
        p, c = fn(text, expected)
        parsed = F.when(template == F.lit(tid), p).otherwise(parsed)
        correct = F.when(template == F.lit(tid), c).otherwise(correct)
    return parsed, correct


def score(
    tasks: DataFrame,
    responses: DataFrame,
    *,
    weights: tuple[float, float] = DEFAULT_WEIGHTS,
    tokenizer: Callable[[Column], Column] = heuristic_tokens,
) -> DataFrame:
    """Join responses to tasks and grade every pair (one output row per response).

    Provider token counts win; a NULL count falls back to the local count of
    the prompt (input) or of the response text (output) (S18).
    """
    t = tasks.select(
        "task_id", "template_id", "generator_version",
        F.col("canonical_terminal_answer").alias("expected_terminal"),
        "v_star_input_tokens", "v_star_output_tokens", "difficulty_bucket",
        tokenizer(F.col("merged_prompt")).alias("_prompt_tokens"),
    )
    r = responses.select("task_id", "model", "response_text", "input_tokens", "output_tokens")
    j = r.join(t, "task_id", "inner")
    in_tok = F.coalesce(F.col("input_tokens"), F.col("_prompt_tokens")).cast("bigint")
    out_tok = F.coalesce(F.col("output_tokens"), tokenizer(F.col("response_text"))).cast("bigint")
    text = F.coalesce(F.col("response_text"), F.lit(""))
    parsed, correct = _dispatch(F.col("template_id"), text, F.col("expected_terminal"))
    scored = j.select(
        "task_id", "model", "template_id",
        correct.alias("terminal_correct"),
        parsed.alias("parsed_terminal"),
        "expected_terminal",
        in_tok.alias("input_tokens"),
        out_tok.alias("output_tokens"),
        "v_star_input_tokens", "v_star_output_tokens",
        "response_text", "generator_version", "difficulty_bucket",
    )
    w_in, w_out = weights
    scored = scored.withColumn("cost", weighted_cost("input_tokens", "output_tokens", weights)) \
        .withColumn("v_star", weighted_cost("v_star_input_tokens", "v_star_output_tokens", weights))
    return scored.select(
        "task_id", "model", "template_id", "terminal_correct", "parsed_terminal", "expected_terminal",
        "input_tokens", "output_tokens", "cost", "v_star",
        efficiency("terminal_correct", "v_star", "cost").alias("efficiency"),
        "response_text", "generator_version",
        F.array(F.lit(float(w_in)), F.lit(float(w_out))).alias("weights"),
        "difficulty_bucket",
    )


def attach_answers(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """Look up each row's canonical answer by task id; a task id missing from
    the task table fails the job (lazily, at execution) instead of yielding NULL."""
    t = tasks.select("task_id", F.col("canonical_terminal_answer").alias("_answer"), F.lit(True).alias("_known"))
    j = rows.join(t, "task_id", "left")
    check = F.when(F.col("_known").isNull(),
                   F.raise_error(F.concat(F.lit("no answer registered for task "), F.col("task_id"))))
    return j.withColumn("canonical_terminal_answer", F.coalesce(check.cast("string"), F.col("_answer"))) \
        .drop("_answer", "_known")


# Fixed values that must equal the reference for identical results:
#   verbose calibration padding: "Let me think step by step about this problem. "
#   repeated max(1, padding_tokens // 10) times, then a newline and
#   "The answer is <answer>"; default padding_tokens = 200
#   always-wrong calibration answer: "0"
VERBOSE_PAD = "Let me think step by step about this problem. "
WRONG_ANSWER = "0"


def calibration_responses(tasks: DataFrame, padding_tokens: int = 200) -> DataFrame:
    """Ideal ('echo_model'), verbose ('verbose_echo_model') and always-wrong
    ('wrong_echo_model') responses for every task; counts left NULL so the
    normal scoring path counts them locally."""
    reps = max(1, padding_tokens // 10)
    answer = F.col("canonical_terminal_answer")
    kind = F.explode(F.array(F.lit("echo_model"), F.lit("verbose_echo_model"), F.lit("wrong_echo_model")))
    base = tasks.select("task_id", "canonical_terminal_answer", kind.alias("model"))
    text = (
        F.when(F.col("model") == "echo_model", answer)
        .when(F.col("model") == "verbose_echo_model",
              F.concat(F.lit(VERBOSE_PAD * reps), F.lit("\nThe answer is "), answer))
        .otherwise(F.lit(WRONG_ANSWER))
    )
    return base.select(
        "task_id", "model", text.alias("response_text"),
        F.lit(None).cast("bigint").alias("input_tokens"),
        F.lit(None).cast("bigint").alias("output_tokens"),
    )


def consistency_calibration(claims: DataFrame) -> DataFrame:
    """Truthful and confabulating replies for (task_id, a, b, c, verdict) rows.

    The confabulating reply emits ``a + 1`` and always claims 'consistent'."""
    truthful = F.format_string("a=%s, b=%s, c=%s, verdict=%s", "a", "b", "c", "verdict")
    confab = F.format_string("a=%s, b=%s, c=%s, verdict=consistent",
                             (F.col("a") + 1).cast("string"), "b", "c")
    kind = F.explode(F.array(F.lit("consistency_echo_model"), F.lit("confabulating_consistency_model")))
    base = claims.select("task_id", "a", "b", "c", "verdict", kind.alias("model"))
    return base.select(
        "task_id", "model",
        F.when(F.col("model") == "consistency_echo_model", truthful).otherwise(confab).alias("response_text"),
        F.lit(None).cast("bigint").alias("input_tokens"),
        F.lit(None).cast("bigint").alias("output_tokens"),
    )
