"""Row-level rules: answer parsing, grading, cost, text measures, specs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from costwise.functions import (
    compact_dollars,
    depth_from_bucket,
    difficulty_bucket,
    efficiency,
    grade_consistency,
    consistency_fields,
    has_decomposition_marker,
    heuristic_tokens,
    last_integer,
    leaked_values,
    round_sig,
    split_spec,
    utf8_bytes,
    waste_ratio,
    word_count,
)


def _one(spark, col, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(col(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("The year 1947 and the answer is 12", "12"),
        ("answer: 42", "42"),
        ("no number here", None),
        ("", None),
        ("step 1, step 2, result 7", "7"),
        ("Difference: 463,949", "463949"),
        ("Difference: 463，949", "463949"),
        ("Difference: 185 805", "185805"),
        ("Difference: 185 805", "185805"),
        ("007", "7"),
        ("-0", "0"),
        ("-000", "0"),
        ("5-3", "-3"),
        ("1,2345", "5"),
        ("x = 123456789012345678901234567890", "123456789012345678901234567890"),
        ("-42 apples", "-42"),
    ],
)
def test_last_integer(spark, text, expected):
    assert _one(spark, last_integer, text) == expected


def test_efficiency_and_waste(spark):
    df = spark.createDataFrame(
        [(True, 274.0, 5070.0), (False, 274.0, 5070.0), (True, 10.0, 0.0), (True, 130.0, 1530.0)],
        "c boolean, v double, cost double",
    )
    rows = df.select(efficiency("c", "v", "cost").alias("e"), waste_ratio("cost", "v").alias("w")).collect()
    assert abs(rows[0]["e"] - 274 / 5070) < 1e-12 and round(rows[0]["e"], 3) == 0.054
    assert rows[1]["e"] is None
    assert rows[2]["e"] == 0.0
    assert abs(rows[3]["w"] - (1530 - 130) / 130) < 1e-12
    assert round(rows[0]["w"], 1) == 17.5


@pytest.mark.parametrize(
    "text,correct",
    [
        ("a=78, b=36, c=42, verdict=consistent", True),
        ("a=79, b=36, c=42, verdict=inconsistent", True),
        ("a=79, b=36, c=42, verdict=consistent", False),
        ("I think the numbers add up.", False),
        ("A = 10 , B=4, c= 6, VERDICT = Consistent", True),
        ("beta=4, a=9, b=5, c=4, verdict=consistent", False),  # 'a=' matched inside 'beta=4'
    ],
)
def test_consistency_grader(spark, text, correct):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(grade_consistency(consistency_fields("t")).alias("g")).first()["g"]
    assert got is correct


def test_token_heuristic_and_bytes(spark):
    df = spark.createDataFrame(
        [("",), ("   ",), ("one",), ("a b c d e f g h i j",), ("x　y z\x1cw",), ("héllo wörld",)],
        "t string",
    )
    rows = df.select(word_count("t").alias("w"), heuristic_tokens("t").alias("k"), utf8_bytes("t").alias("b")).collect()
    assert [r["k"] for r in rows] == [0, 1, 1, 13, 5, 2]
    assert [r["w"] for r in rows] == [len(t.split()) for t in ["", "   ", "one", "a b c d e f g h i j",
                                                                "x　y z\x1cw", "héllo wörld"]]
    assert rows[5]["b"] == len("héllo wörld".encode())


def test_bucket_depth(spark):
    for label, d in [("depth_6", 6), ("hybrid_prog+chain+table_d3", 3),
                     ("hybrid_prog+chain+table_d12", 12), ("no_digits_here", 0)]:
        assert _one(spark, depth_from_bucket, label) == d


def test_difficulty_bucket_default_and_explicit(spark):
    df = spark.createDataFrame(
        [('{"bucket": "hybrid_d6"}', 3), ('{"bucket": ""}', 4), ('{"bucket": 7}', 2), ("{}", 5)],
        "p string, n int",
    ).select("p", F.array_repeat(F.lit("node"), F.col("n")).alias("nodes"))
    got = [r[0] for r in df.select(difficulty_bucket("p", "nodes")).collect()]
    assert got == ["hybrid_d6", "depth_4", "depth_2", "depth_5"]


@pytest.mark.parametrize(
    "text,marker",
    [
        ("Step 1: add the numbers", True),
        ("step3 then", True),
        ("Stage 2 of the plan", True),
        ("solve each subproblem", True),
        ("a sub-problem", True),
        ("see Part B below", True),
        ("Part Bravo", False),
        ("answer Q3 first", True),
        ("Q33", False),
        ("a footstep 1", False),
        ("nothing to see", False),
        ("STEP 4", True),
    ],
)
def test_decomposition_marker(spark, text, marker):
    assert _one(spark, has_decomposition_marker, text) is marker


def test_leak_predicate(spark):
    df = spark.createDataFrame(
        [("the value is 42.", [42]), ("42.5 units", [42]), ("1420 units", [42]), ("got 42 and -7", [42, -7, 8]),
         ("v-7x", [-7]), ("3.42", [42])],
        "t string, h array<bigint>",
    )
    got = [r[0] for r in df.select(leaked_values("t", "h")).collect()]
    assert got == [[], [], [], [42, -7], [-7], []]


def test_spec_split(spark):
    specs = ["openai:gpt-5.4#effort=low", "moonshot:kimi-k2.5#thinking=off", "anthropic:claude#effort=low",
             "openai:gpt#thinking=off", "openai:gpt#effort=max", "acme:x", "deepseek:ds", "noprovider"]
    df = spark.createDataFrame([(s,) for s in specs], "s string")
    rows = df.select(split_spec("s").alias("p")).select("p.*").collect()
    assert (rows[0]["provider"], rows[0]["model_id"], rows[0]["knob"], rows[0]["knob_value"], rows[0]["error"]) == (
        "openai", "gpt-5.4", "effort", "low", None)
    assert rows[1]["error"] is None and rows[1]["knob"] == "thinking"
    assert rows[2]["error"] == "effort_requires_openai"
    assert rows[3]["error"] == "thinking_off_requires_moonshot"
    assert rows[4]["error"] == "unsupported_fragment"
    assert rows[5]["error"] == "unknown_provider"
    assert rows[6]["error"] is None and rows[6]["knob"] is None
    assert rows[7]["provider"] == "noprovider" and rows[7]["error"] == "unknown_provider"


def test_compact_dollars_and_sig_rounding(spark):
    df = spark.createDataFrame([(0.0024321,), (12345.678,), (1.7e11,), (None,)], "v double")
    got = [r[0] for r in df.select(compact_dollars("v")).collect()]
    assert got == ["0.00243", "12,345.68", "1.7e+11", "n/a"]
    df2 = spark.createDataFrame([(123456789012.345,), (0.000123456789123,), (0.0,)], "v double")
    got2 = [r[0] for r in df2.select(round_sig("v", 9)).collect()]
    assert got2 == [123456789000.0, 0.000123456789, 0.0]


def test_block_and_chat_payloads(spark):
    import json

    from costwise.functions import block_usage, chat_usage

    blocks = json.dumps({"content": [{"type": "thinking", "thinking": "hmm"}, {"type": "text", "text": "The "},
                                     {"type": "thinking", "thinking": ""}, {"type": "text", "text": "answer is 4"}],
                         "usage": {"input_tokens": 12, "output_tokens": 30}, "stop_reason": "end_turn"})
    no_think = json.dumps({"content": [{"type": "text", "text": "4"}], "usage": {"input_tokens": 1, "output_tokens": 2},
                           "stop_reason": "max_tokens"})
    df = spark.createDataFrame([(blocks,), (no_think,)], "p string")
    rows = df.select(block_usage("p").alias("u")).select("u.*").collect()
    assert rows[0]["text"] == "The answer is 4" and rows[0]["thinking_content"] == "hmm"
    assert rows[0]["input_tokens"] == 12 and rows[0]["stop_reason"] == "end_turn"
    assert rows[1]["thinking_content"] is None
    chat = spark.createDataFrame([('{"finish_reason":"length"}',),
                                  ('{"usage":{"prompt_tokens":5,"completion_tokens":7},"finish_reason":"stop",'
                                   '"reasoning_content":""}',)], "p string")
    c = chat.select(chat_usage("p").alias("u")).select("u.*").collect()
    assert c[0]["input_tokens"] is None and c[0]["provider_usage"] is False and c[0]["finish_reason"] == "length"
    assert c[1]["output_tokens"] == 7 and c[1]["provider_usage"] is True and c[1]["reasoning_content"] is None


def test_depth_from_parameters(spark):
    from costwise.functions import depth_from_parameters

    df = spark.createDataFrame([('{"recipe": {"per_segment_difficulty": {"depth": 12}}}',), ("{}",)], "p string")
    assert [r[0] for r in df.select(depth_from_parameters("p")).collect()] == [12, None]


def test_score_with_provider_fallback(spark):
    from costwise.operators.scoring import calibration_responses, score

    tasks = spark.createDataFrame(
        [("t1", "chain", "2.0.0", "one two three four five six seven eight nine ten", "42", 14, 1, "depth_3"),
         ("t2", "consistency", "2.0.0", "check it", "consistent", 3, 1, "depth_3")],
        "task_id string, template_id string, generator_version string, merged_prompt string, "
        "canonical_terminal_answer string, v_star_input_tokens bigint, v_star_output_tokens bigint, "
        "difficulty_bucket string")
    responses = spark.createDataFrame(
        [("t1", "m", "so the answer is 42", None, 9), ("t1", "n", "maybe 41", 100, None),
         ("t2", "m", "a=10, b=4, c=6, verdict=consistent", 5, 5)],
        "task_id string, model string, response_text string, input_tokens bigint, output_tokens bigint")
    out = {(r["task_id"], r["model"]): r for r in score(tasks, responses).collect()}
    assert out[("t1", "m")]["input_tokens"] == 13 and out[("t1", "m")]["terminal_correct"] is True
    assert out[("t1", "n")]["output_tokens"] == 2 and out[("t1", "n")]["efficiency"] is None
    assert out[("t2", "m")]["parsed_terminal"] == "consistent" and out[("t2", "m")]["terminal_correct"] is True
    assert abs(out[("t1", "m")]["efficiency"] - (14 + 4) / (13 + 36)) < 1e-12
    cal = {r["model"]: r for r in score(tasks.limit(1), calibration_responses(tasks.limit(1))).collect()}
    assert cal["echo_model"]["terminal_correct"] and cal["verbose_echo_model"]["terminal_correct"]
    assert not cal["wrong_echo_model"]["terminal_correct"]
    assert cal["verbose_echo_model"]["efficiency"] < cal["echo_model"]["efficiency"]


def test_answer_lookup_fails_on_unknown_task(spark):
    from costwise.operators.scoring import attach_answers

    tasks = spark.createDataFrame([("t1", "42")], "task_id string, canonical_terminal_answer string")
    ok = attach_answers(spark.createDataFrame([("t1",)], "task_id string"), tasks).first()
    assert ok["canonical_terminal_answer"] == "42"
    with pytest.raises(Exception):
        attach_answers(spark.createDataFrame([("t9",)], "task_id string"), tasks).collect()
