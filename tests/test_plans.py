"""Plan shapes the scale design relies on (read from explain output)."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import functions as F

import __spark_entry__ as entry
from costwise.operators import synth as sy

SF = "/root/testdata/sf0.001"


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_leaderboard_reduces_before_joining_prices(spark):
    p = plan_text(entry.queries()["leaderboard"](spark, SF))
    assert "SortMergeJoin" not in p
    assert p.count("HashAggregate") >= 2  # partial + final around the shuffle
    # the price sheet (nation) is broadcast; the fact table is not
    assert "BroadcastExchange" in p
    assert "LessThan(n_nationkey,12)" in p  # filter pushed into the sheet scan


def test_latest_per_pair_is_an_aggregate_not_a_window(spark):
    p = plan_text(entry.queries()["latest_per_pair"](spark, SF))
    assert "Window" not in p


def test_synthesis_is_narrow_on_split_input(spark):
    seeds = spark.range(0, 64, 1, numPartitions=8).select(
        F.col("id").alias("seed"), F.lit(4).alias("depth"), F.lit(1).alias("distractors"))
    p = plan_text(sy.synthesize_chains(seeds))
    assert "Exchange" not in p and "Generate" in p


def test_column_pruning_on_documents(spark):
    p = plan_text(entry.queries()["token_heuristic"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_comparison_views_share_a_written_cell_table(spark, tmp_path):
    from costwise.operators.reports import comparison, comparison_views
    from costwise.sources.fixtures import Fixtures

    fx = Fixtures(spark, SF)
    views = comparison(fx["fx_results"], fx["fx_prices"])
    views["cells"].write.parquet(str(tmp_path / "cells"))
    again = comparison_views(spark.read.parquet(str(tmp_path / "cells")), fx["fx_prices"])
    for name in ("leaderboard", "pivot_cost", "decomposition"):
        assert "lineitem" not in plan_text(again[name])
        assert sorted(map(str, again[name].collect())) == sorted(map(str, views[name].collect()))


def test_building_a_batch_query_runs_no_job(spark):
    """Plans stay lazy: apart from reading schemas, nothing runs until an action."""
    names = ["leaderboard", "pivot_cost", "comparison_pivot_cost", "ladder_prune", "knob_exchange", "score_responses", "chain_synthesis"]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "building plans")
    for name in names:
        entry.queries()[name](spark, SF)
    jobs = tracker.getJobIdsForGroup("lazy")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) <= 2 * len(names)  # parquet footers only
