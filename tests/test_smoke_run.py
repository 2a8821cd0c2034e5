"""Golden end-to-end numbers: the reference's published smoke-run table, recomputed
from its 23 shipped result rows (transcribed to tests/data) at $0.60 / $3.00."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from costwise.functions.buckets import depth_from_bucket
from costwise.operators import economics as econ
from costwise.operators import evidence as ev

DATA = os.path.join(os.path.dirname(__file__), "data", "smoke_run_results.csv")
SCHEMA = (
    "task_id string, model string, terminal_correct boolean, parsed_terminal string, expected_terminal string, "
    "input_tokens bigint, output_tokens bigint, cost double, v_star double, efficiency double, "
    "generator_version string, difficulty_bucket string"
)


def test_smoke_run_published_numbers(spark):
    r = spark.read.schema(SCHEMA).option("header", True).csv(DATA)
    prices = spark.createDataFrame([("moonshot:kimi-k2.5", 0.6, 3.0)], "model string, price_in double, price_out double")
    d = econ.dollars_summary(r, prices).first()
    assert d["n"] == 23 and round(d["accuracy"], 3) == 1.0
    assert round(d["dollars_per_correct"], 5) == 0.00243
    assert round(d["mean_waste_ratio"], 1) == 28.4
    assert round(d["spend_dollars"], 4) == 0.0559
    by_depth = (
        r.withColumn("depth", depth_from_bucket("difficulty_bucket"))
        .groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.avg("output_tokens").alias("out"),
                              F.avg("efficiency").alias("eff"))
        .orderBy("depth").collect()
    )
    got = [(x["depth"], x["n"], round(x["out"]), round(x["eff"], 3)) for x in by_depth]
    assert got == [(3, 9, 669, 0.032), (6, 10, 797, 0.046), (10, 3, 984, 0.052), (14, 1, 1106, 0.055)]
    per_task = {
        x["depth"]: round(x["mean_dollars_per_task"], 5)
        for x in ev.spend_by_depth(r, prices).collect()
    }
    assert per_task == {3: 0.00205, 6: 0.00247, 10: 0.00308, 14: 0.00347}
