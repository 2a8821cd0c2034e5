"""Audits over task sets with planted violations: each rule finds its own, and nothing in a clean set."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from costwise.operators import audits as au
from costwise.operators import synth as sy
from costwise.plans.synthesis import synth_checks


@pytest.fixture(scope="module")
def tasks(spark):
    seeds = spark.range(12).select("id", F.lit(5).alias("depth"), F.lit(2).alias("distractors")).withColumnRenamed("id", "seed")
    return sy.synthesize_chains(seeds).cache()


def planted():
    return {
        "truth_replay": {"canonical_terminal_answer": F.lit("-1")},
        "no_hidden_value_leak": {"merged_prompt": F.concat("merged_prompt", F.lit(" It was "), F.col("values")[1].cast("string"), F.lit(" then."))},
        "no_decomposition_marker": {"merged_prompt": F.concat(F.lit("Step 1: "), F.col("merged_prompt"))},
        "values_within_bounds": {"values": F.concat("values", F.array(F.lit(500_001).cast("bigint")))},
        "vstar_tokens": {"v_star_input_tokens": F.col("v_star_input_tokens") + 1},
        "distractors_avoid_hidden": {"distractor_values": F.array(F.col("values")[0], F.col("distractor_values")[0])},
        "distractors_differ": {"distractor_values": F.array(F.col("distractor_values")[0], F.col("distractor_values")[0])},
    }


def test_planted_violations_are_counted(tasks):
    clean = {r["check"]: r["n_violations"] for r in synth_checks(tasks).collect()}
    assert clean == dict.fromkeys(planted(), 0)
    for rule, change in planted().items():
        three = F.col("seed") < 3
        bad = tasks.withColumns({c: F.when(three, v).otherwise(F.col(c)) for c, v in change.items()})
        found = {r["check"]: r["n_violations"] for r in synth_checks(bad).collect()}
        assert found[rule] == 3, rule


def test_replay_check_counts_every_kind_of_difference(spark):
    a = spark.createDataFrame([("same", "x", 1), ("same", "x", 1), ("changed", "x", 1), ("gone", "x", 1), ("null", None, 1), ("twice", "x", 1)], "task_id string, p string, n int")
    b = spark.createDataFrame([("same", "x", 1), ("same", "x", 1), ("changed", "y", 1), ("new", "x", 1), ("null", None, 1), ("twice", "x", 1), ("twice", "x", 1)], a.schema)
    got = {r.task_id: (r.status, r.n_left_only, r.n_right_only) for r in au.replay_check(a, b, ["p", "n"]).collect()}
    assert got == {"same": ("same", 0, 0), "changed": ("changed", 1, 1), "gone": ("only_recorded", 1, 0), "new": ("only_regenerated", 0, 1),
                   "null": ("same", 0, 0), "twice": ("changed", 0, 1)}
    rows = sorted(tuple(r) for r in au.same_rows(a, b).collect())
    assert rows == sorted([("changed", "x", 1, "left_only"), ("gone", "x", 1, "left_only"), ("changed", "y", 1, "right_only"),
                           ("new", "x", 1, "right_only"), ("twice", "x", 1, "right_only")])
    assert au.same_rows(a, a).count() == 0


def test_shared_text(spark):
    rows = [(1, "listing", "a"), (1, "listing", "a"), (1, "table", "t1"), (2, "listing", "a"), (2, "listing", "b"), (3, "listing", None), (3, "listing", "")]
    got = {(r.g, r.part): (r.n_rungs, r.n_texts, r.same_text) for r in
           au.shared_text_audit(spark.createDataFrame(rows, "g int, part string, text string"), ["g"], "part").collect()}
    assert got == {(1, "listing"): (2, 1, True), (1, "table"): (1, 1, True), (2, "listing"): (2, 2, False), (3, "listing"): (2, 1, True)}


def test_hybrids_of_recorded_segments(spark):
    from costwise.operators.segments import compose_hybrids

    def seg(seed, attempt, texts, values=(7001, 7002, 7003), kinds=("program_output", "arithmetic_chain", "table_aggregation"), types=("integer",) * 3):
        return [(seed, attempt, i, k, t, v, y) for i, (k, t, v, y) in enumerate(zip(kinds, texts, values, types, strict=True))]

    good = ("print it.  ", "count on.", "sum up.")
    rows = (
        seg(1, 0, ("shows 7002 there.", *good[1:])) + seg(1, 1, good)  # the first attempt shows a hidden value
        + seg(2, 0, good, types=("text", "integer", "integer")) + seg(2, 2, good)  # nothing to hand on
        + seg(3, 0, good)[:2]  # a segment is missing
        + seg(4, 0, good, kinds=("program_output", "table_aggregation", "arithmetic_chain"))  # no such recipe
        + seg(5, 0, ("Step 1: go.", *good[1:]))  # reads like a list of steps
    )
    segments = spark.createDataFrame(rows, "seed long, attempt int, position int, kind string, text string, value long, value_type string")
    bridges = spark.createDataFrame(
        [("program_output", "arithmetic_chain", 0, "Take that on."), ("arithmetic_chain", "table_aggregation", 0, "Put it first.")],
        "source string, target string, variant int, phrase string")
    recipe = ["program_output", "arithmetic_chain", "table_aggregation"]
    got = {r.seed: r for r in compose_hybrids(segments, bridges, recipe, "One integer.").collect()}
    assert {s: (r.status, r.attempt) for s, r in got.items()} == {1: ("ok", 1), 2: ("ok", 2), 3: ("rejected", None), 4: ("rejected", None), 5: ("rejected", None)}
    assert got[1].merged_prompt == "print it. Take that on. count on. Put it first. sum up. One integer." and got[1].canonical_terminal_answer == "7003"
