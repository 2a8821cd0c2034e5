from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from costwise.session import build_session, checkpoint_dir

    s = build_session("local[4]", shuffle_partitions=4, app_name="costwise-tests")
    checkpoint_dir(s)
    yield s
    s.stop()


def results_df(spark, rows):
    """Results rows as (task_id, model, correct, in_tok, out_tok, v_star, bucket) tuples,
    cost and efficiency derived with weights (1, 4) as the scorer does."""
    out = []
    for task_id, model, correct, tin, tout, v_star, bucket in rows:
        cost = 1.0 * tin + 4.0 * tout
        eff = (v_star / cost if cost > 0 else 0.0) if correct else None
        out.append((task_id, model, correct, "1" if correct else "2", "1", tin, tout, cost, float(v_star),
                    eff, bucket))
    return spark.createDataFrame(
        out,
        "task_id string, model string, terminal_correct boolean, parsed_terminal string, "
        "expected_terminal string, input_tokens bigint, output_tokens bigint, cost double, "
        "v_star double, efficiency double, difficulty_bucket string",
    )


def prices_df(spark, sheet):
    return spark.createDataFrame(
        [(m, float(p[0]), float(p[1])) for m, p in sheet.items()],
        "model string, price_in double, price_out double",
    )
