"""Hybrid tasks composed of recorded segments.

Segments come as a table of attempts, whatever family wrote them: per (seed, attempt, position) the kind, its
text, its value and the value's type. Bridges are a dimension by (source kind, target kind, variant): the phrase
that hands a segment's value on to the next one. A composition is one aggregation over the segments of an
attempt and two joins with the small bridge table; the first valid attempt of a seed wins by ``min_by``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costwise.functions.text import has_decomposition_marker, heuristic_tokens, leaked_values


def compose_hybrids(segments: DataFrame, bridges: DataFrame, recipe: list[str], closing: str) -> DataFrame:
    """One row per seed: the first attempt whose segments follow ``recipe`` and that is valid, else status 'rejected'.

    ``segments``: (seed, attempt, position, kind, text, value, value_type); ``bridges``: (source, target, variant,
    phrase) with variants 0..n-1 of each pair. An attempt is valid if it has the recipe's kinds in order, every
    handed-on value is an integer, a bridge exists for every joint, no segment's value stands in the prompt and
    nothing reads like a list of steps. The variant is drawn by (seed, attempt, joint), equal in every engine."""
    counted = bridges.groupBy("source", "target").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("variant").cast("int"), "phrase"))).alias("phrases")
    )  # as many entries as a pair has variants
    order = F.create_map(*[x for i, k in enumerate(recipe) for x in (F.lit(i), F.lit(k))])
    joint = F.when(F.col("position") < len(recipe) - 1, order[F.col("position") + 1])
    joined = segments.filter(F.col("position").between(0, len(recipe) - 1)).withColumn("next_kind", joint).join(
        counted, (F.col("kind") == F.col("source")) & (F.col("next_kind") == F.col("target")), "left"
    )
    variant = F.pmod(F.col("seed") * 31 + F.col("attempt") * 7 + F.col("position"), F.size("phrases")).cast("int")
    last = F.col("position") == len(recipe) - 1
    piece = F.struct(
        "position", F.rtrim(F.col("text")).alias("text"), F.when(~last, F.element_at("phrases", variant)).alias("bridge"),
        F.col("value").alias("value"),
        ((F.col("kind") == order[F.col("position")]) & (last | (F.col("value_type") == "integer"))).alias("fits"),
    )
    attempts = joined.groupBy("seed", "attempt").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    prompt = F.concat(
        F.array_join(F.flatten(F.transform("p", lambda x: F.array_compact(F.array(x["text"], x["bridge"])))), " "), F.lit(" " + closing)
    )
    # a missing position, a repeated one or an unknown joint makes no task
    whole = (
        (F.size("p") == len(recipe)) & F.forall(F.transform("p", lambda x, i: (x["position"] == i) & x["fits"]), lambda ok: F.coalesce(ok, F.lit(False)))
        & (F.size(F.filter("p", lambda x: x["bridge"].isNotNull())) == len(recipe) - 1)
    )
    values = F.transform("p", lambda x: x["value"])
    tried = attempts.select("seed", "attempt", whole.alias("whole"), prompt.alias("merged_prompt"), values.alias("hidden"))
    valid = F.col("whole") & (F.size(leaked_values("merged_prompt", "hidden")) == 0) & ~has_decomposition_marker("merged_prompt")
    first = tried.groupBy("seed").agg(
        F.min(F.when(valid, F.struct("attempt", "merged_prompt", F.element_at("hidden", -1).alias("answer")))).alias("f")
    )
    return first.select(
        "seed", "f.attempt", "f.merged_prompt", F.col("f.answer").cast("string").alias("canonical_terminal_answer"),
        heuristic_tokens(F.col("f.merged_prompt")).alias("v_star_input_tokens"),
        F.when(F.col("f").isNull(), F.lit("rejected")).otherwise(F.lit("ok")).alias("status"),
    )
