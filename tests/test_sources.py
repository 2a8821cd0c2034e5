"""Readers and writers: price sheets, results / tasks JSONL, manifests, round trip."""

from __future__ import annotations

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from costwise.sources.jsonl import merge_results, read_manifests, read_results, read_tasks, write_jsonl
from costwise.sources.prices import load_price_sheet


def _tmp():
    return tempfile.mkdtemp(prefix="costwise-test-", dir="/tmp")


RESULT = {
    "task_id": "t1", "model": "m", "terminal_correct": True, "parsed_terminal": "5",
    "expected_terminal": "5", "input_tokens": 10, "output_tokens": 2, "cost": 18.0, "v_star": 14.0,
    "efficiency": 14.0 / 18.0, "response_text": "5", "generator_version": "2.0.0", "weights": [1.0, 4.0],
    "difficulty_bucket": "depth_3",
}


def test_price_sheet_skips_metadata(spark):
    d = _tmp()
    with open(os.path.join(d, "prices.json"), "w") as f:
        json.dump({"_note": "per million tokens", "_version": 3, "a:x": {"in": 3, "out": 15.5}}, f)
    rows = load_price_sheet(spark, os.path.join(d, "prices.json")).collect()
    assert [(r["model"], r["price_in"], r["price_out"]) for r in rows] == [("a:x", 3.0, 15.5)]


def test_results_round_trip_and_legacy_rows(spark):
    d = _tmp()
    legacy = dict(RESULT)
    modern = dict(RESULT, task_id="t2", response_extra={"finish_reason": "stop"}, parsed_terminal=None)
    with open(os.path.join(d, "results.jsonl"), "w") as f:
        f.write(json.dumps(legacy) + "\n\n" + json.dumps(modern) + "\n")
    r = read_results(spark, os.path.join(d, "results.jsonl"))
    rows = {x["task_id"]: x for x in r.collect()}
    assert rows["t1"]["response_extra"].toPython() == {} and rows["t2"]["response_extra"].toPython() == {"finish_reason": "stop"}
    out = os.path.join(_tmp(), "out")
    write_jsonl(r, out, mode="overwrite")
    back = read_results(spark, out)
    assert sorted(back.columns) == sorted(r.columns) and back.count() == 2
    assert back.filter(F.col("parsed_terminal").isNull()).count() == 1
    merged = merge_results([r, back])
    assert merged.count() == 4 and merge_results([r, back], dedupe=True).count() == 2


def test_missing_required_field_fails(spark):
    d = _tmp()
    bad = dict(RESULT)
    del bad["model"]
    with open(os.path.join(d, "results.jsonl"), "w") as f:
        f.write(json.dumps(bad) + "\n")
    with pytest.raises(Exception):
        read_results(spark, os.path.join(d, "results.jsonl")).collect()


def test_tasks_and_manifest(spark):
    d = _tmp()
    task = {
        "task_id": "arithmetic_chain::2.0.0::abc", "generator_version": "2.0.0", "template_id": "chain",
        "seed": 18446744073709551615, "parameters": {"bucket": "hybrid_d6", "ops": [{"name": "gain", "k": 3}]},
        "nodes": [], "merged_prompt": "How many?", "canonical_terminal_answer": "12",
        "terminal_answer_type": "integer", "v_star_input_tokens": 40, "v_star_output_tokens": 1,
    }
    with open(os.path.join(d, "tasks.jsonl"), "w") as f:
        f.write(json.dumps(task) + "\n")
    t = read_tasks(spark, os.path.join(d, "tasks.jsonl")).first()
    assert str(t["seed"]) == "18446744073709551615"
    assert t["parameters"].toPython() == {"bucket": "hybrid_d6", "ops": [{"name": "gain", "k": 3}]}
    write_jsonl(read_tasks(spark, os.path.join(d, "tasks.jsonl")), os.path.join(d, "again"))
    line = json.loads(next(r.value for r in spark.read.text(os.path.join(d, "again")).collect()))
    assert line["parameters"] == task["parameters"] and line["seed"] == task["seed"]
    os.makedirs(os.path.join(d, "runs", "r1"))
    with open(os.path.join(d, "runs", "r1", "manifest.json"), "w") as f:
        json.dump({"run_id": "r1", "created_at": "2026-07-02T18:37:46+00:00", "family": "hybrid",
                   "models": ["a", "b"], "weights": [1.0, 4.0], "task_count": 40,
                   "cells": [{"depth": 3, "distractors": 1}]}, f, indent=2)
    m = read_manifests(spark, os.path.join(d, "runs", "*", "manifest.json")).first()
    assert m["run_id"] == "r1" and m["task_count"] == 40 and m["created_ts"] is not None


EXTRAS = [None, {}, {"a": 1}, {"a": 1.5, "b": True, "c": None, "d": [1, "1", {"e": []}], "f": {"g": {"h": "007"}}}, [], "", 0, False]


def test_extra_fields_keep_their_types(spark):
    d = _tmp()
    with open(os.path.join(d, "results.jsonl"), "w") as f:
        for i, extra in enumerate(EXTRAS):
            f.write(json.dumps(dict(RESULT, task_id=f"t{i}", response_extra=extra)) + "\n")
    r = read_results(spark, os.path.join(d, "results.jsonl"))
    write_jsonl(r, os.path.join(d, "again"))
    r.write.parquet(os.path.join(d, "table"))
    for back in (read_results(spark, os.path.join(d, "again")), spark.read.parquet(os.path.join(d, "table"))):
        got = {x.task_id: json.loads(x.e) for x in back.select("task_id", F.to_json("response_extra").alias("e")).collect()}
        assert got == {f"t{i}": extra or {} for i, extra in enumerate(EXTRAS)}


def test_last_record_over_files_wins(spark):
    from costwise.operators.ladder import latest_per_key

    d = _tmp()
    for name, versions in (("b.jsonl", ["1", "2", "3"]), ("a.jsonl", ["4", "5"])):
        with open(os.path.join(d, name), "w") as f:
            for v in versions:
                f.write(json.dumps(dict(RESULT, generator_version=v)) + "\n")
    for order, want in ((["b.jsonl", "a.jsonl"], "5"), (["a.jsonl", "b.jsonl"], "3")):
        back = read_results(spark, [os.path.join(d, n) for n in order], with_order=True, with_source=True)
        one = latest_per_key(back.drop("response_extra"), ["task_id", "model"], ["ingest"]).collect()
        assert [r.generator_version for r in one] == [want] and one[0].source_file.endswith(order[1])


def _folder_bytes(path, ending):
    found = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(ending)]
    return len(found), sum(os.path.getsize(f) for f in found)


def test_round_trip_files_take_a_fraction_of_the_plain_text(spark, monkeypatch):
    """results_roundtrip kept two copies of the rows as plain text: more disk than its input by far."""
    from costwise.plans import REGISTRY, io
    from costwise.sources import jsonl

    d = _tmp()
    monkeypatch.setattr(io, "_folder", lambda fx: os.path.join(d, "io"))
    monkeypatch.setattr(jsonl, "RECORDS_PER_FILE", 100, raising=False)
    rows = [(o, 1 + o % 40, 1 + o % 7, 1 + o % 4, 100.0 + o) for o in range(400)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_extendedprice double") \
        .coalesce(1).write.parquet(os.path.join(d, "lineitem.parquet"))
    back = REGISTRY["results_roundtrip"].run(spark, d)
    assert sorted(r["seq"] for r in back.collect()) == sorted(o * 8 + n for o, _, _, n, _ in rows)
    plain = os.path.join(d, "plain")
    write_jsonl(read_results(spark, os.path.join(d, "io", "lines")), plain)
    text = _folder_bytes(plain, ".json")[1]
    for part in ("lines", "again"):
        assert _folder_bytes(os.path.join(d, "io", part), ".json") == (0, 0)
        files, size = _folder_bytes(os.path.join(d, "io", part), ".json.gz")
        assert files >= 4 and size < text / 4


def test_latest_over_files_keeps_the_last_record_of_many_compressed_files(spark, monkeypatch):
    """The runs were plain text in four files each, and the place of a record travelled twice."""
    from costwise.operators.ladder import latest_per_key
    from costwise.plans import REGISTRY, io
    from costwise.sources import jsonl

    d = _tmp()
    monkeypatch.setattr(io, "_folder", lambda fx: os.path.join(d, "io"))
    monkeypatch.setattr(jsonl, "RECORDS_PER_FILE", 7, raising=False)
    rows = [(o, 1 + o % 5, 1, 1, 100.0 + o * 37 % 1000) for o in range(300)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_extendedprice double") \
        .write.parquet(os.path.join(d, "lineitem.parquet"))
    got = {r["task_id"]: r["generator_version"] for r in REGISTRY["latest_over_files"].run(spark, d).collect()}
    assert got == {f"P{p}": str(max(o * 8 + 1 for o, q, *_ in rows if q == p)) for p in range(1, 6)}
    assert _folder_bytes(os.path.join(d, "io"), ".json") == (0, 0)
    assert _folder_bytes(os.path.join(d, "io"), ".json.gz")[0] > 300 / 7
    recs = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, seq int, v string")
    assert sorted(map(tuple, latest_per_key(recs, ["k"], ["seq"], keep_order=False).collect())) == [("a", "y"), ("b", "z")]
