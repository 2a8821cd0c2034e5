"""Dollar economics on small tables; expected figures are worked out beside each case."""

from __future__ import annotations

import pytest
from conftest import prices_df, results_df
from pyspark.sql import functions as F

from costwise.functions import compact_dollars
from costwise.operators import economics as econ
from costwise.operators import reports as rep


def answers(model, right, wrong=0, *, read=300, written=500, ideal=304.0, bucket="b_d3"):
    """``right`` correct and ``wrong`` incorrect results of one model, all alike."""
    return [(f"{model}/{i}", model, i < right, read, written, ideal, bucket) for i in range(right + wrong)]


def by_model(df):
    return {r["model"]: r for r in df.collect()}


def test_summary_of_a_priced_model(spark):
    # 8 results, 6 right; 1,000 read at $2 and 250 written at $8 per million: $0.004 a result
    rows = answers("p", 6, 2, read=1000, written=250)
    d = by_model(econ.dollars_summary(results_df(spark, rows), prices_df(spark, {"p": (2.0, 8.0)})))["p"]
    assert (d["n"], d["n_correct"], d["priced"]) == (8, 6, True)
    assert d["accuracy"] == pytest.approx(0.75)
    assert d["spend_dollars"] == pytest.approx(0.032)
    assert d["dollars_per_correct"] == pytest.approx(0.032 / 6)


def test_summary_without_a_right_answer_or_a_price(spark):
    rows = answers("never", 0, 3, read=10, written=10) + answers("unpriced", 2, read=100, written=50, ideal=60.0)
    d = by_model(econ.dollars_summary(results_df(spark, rows), prices_df(spark, {"never": (1.0, 1.0)})))
    assert d["never"]["dollars_per_correct"] is None and d["never"]["mean_waste_ratio"] is None
    assert d["never"]["spend_dollars"] == pytest.approx(6e-5)
    assert d["unpriced"]["priced"] is False and d["unpriced"]["dollars_per_correct"] is None
    # cost 100 + 4 * 50 = 300, ideal 60: (300 - 60) / 60
    assert d["unpriced"]["mean_waste_ratio"] == pytest.approx(4.0)


@pytest.mark.parametrize("factor", [0.5, 1.0, 3.0])
def test_spend_follows_the_sheet(spark, factor):
    sheets = spark.createDataFrame([("s", "p", 2.0 * factor, 8.0 * factor)], "sheet_id string, model string, price_in double, price_out double")
    r = econ.reprice(results_df(spark, answers("p", 1, read=1000, written=250)), sheets).first()
    assert (r["sheet_id"], r["spend_dollars"]) == ("s", pytest.approx(0.004 * factor))


def test_priced_models_lead_by_price_the_others_by_efficiency(spark):
    rows = (answers("mid", 5, written=400) + answers("low", 5, written=200) + answers("quick", 5, written=100)
            + answers("slow", 5, written=5000) + answers("none", 0, 2))
    board = econ.leaderboard(results_df(spark, rows), prices_df(spark, {m: (1, 4) for m in ("mid", "low", "none")})).orderBy("rank").collect()
    assert [r["model"] for r in board][:3] == ["low", "mid", "quick"]
    assert {r["model"]: r["status"] for r in board} == {"low": "ok", "mid": "ok", "quick": "unpriced", "slow": "unpriced", "none": "unpriced"}


def risk(spark, rows, models, **kw):
    return by_model(econ.business_view(results_df(spark, rows), prices_df(spark, {m: (1.0, 4.0) for m in models}), **kw))


@pytest.mark.parametrize("right,wrong,k", [(20, 0, 0.0), (19, 1, 1.0), (38, 2, 1.0), (9, 1, 2.0), (17, 3, 3.0)])
def test_the_penalty_grows_with_the_square_of_errors_in_twenty(spark, right, wrong, k):
    v = risk(spark, answers("p", right, wrong), ["p"], beta=0.5)["p"]
    assert v["k"] == pytest.approx(k)
    assert v["risk_adjusted"] == pytest.approx(v["dollars_per_correct"] * 2.0 ** (k * k))


def test_one_error_costs_a_place(spark):
    v = risk(spark, answers("spotless", 20) + answers("slip", 19, 1), ["spotless", "slip"])
    assert (v["spotless"]["rank"], v["slip"]["rank"]) == (1, 2) and v["spotless"]["penalty"] == 1.0


def test_wasteful_models_go_to_the_bottom(spark):
    v = risk(spark, answers("lean", 10, 10) + answers("bloated", 20, written=20_000), ["lean", "bloated"])
    assert v["bloated"]["tier"] == "bottom" and v["bloated"]["rank"] is None
    assert v["bloated"]["verdict"].startswith("gated: efficiency")
    assert v["lean"]["position"] < v["bloated"]["position"]


@pytest.mark.parametrize("written,gated", [(1444, False), (1446, True)])
def test_the_gate_lies_at_its_share(spark, written, gated):
    # ideal 304; 300 + 4 * 1445 = 6,080 would be exactly 5 %
    v = risk(spark, answers("p", 4, written=written), ["p"], eff_gate=0.05)["p"]
    assert v["gated"] is gated and bool(v["verdict"]) is gated


def test_errors_without_end_stay_listed_with_a_short_price(spark):
    rows = answers("hopeless", 5, 15) + answers("sound", 20)
    view = econ.business_view(results_df(spark, rows), prices_df(spark, {"hopeless": (1, 4), "sound": (1, 4)}))
    v = by_model(view.withColumn("shown", compact_dollars(F.col("risk_adjusted"))))
    assert v["hopeless"]["position"] > v["sound"]["position"] and "e+" in v["hopeless"]["shown"]


def test_no_right_answer_is_said_and_unpriced_models_are_left_out(spark):
    v = risk(spark, answers("zero", 0, 4) + answers("fine", 3) + answers("stranger", 3), ["zero", "fine"])
    assert set(v) == {"zero", "fine"}
    assert v["zero"]["verdict"] == "no correct answers in 4" and v["zero"]["risk_adjusted"] is None


def test_cost_by_depth_is_a_least_squares_line(spark):
    # 120 + 40 d at d = 2, 5, 8 lies on the line
    rows = [r for d in (2, 5, 8) for r in answers("line", 1, written=120 + 40 * d, bucket=f"x+y_d{d}")] + answers("point", 2, bucket="depth_4")
    out = by_model(rep.cost_decomposition(results_df(spark, rows)))
    assert out["line"]["per_step_tokens"] == pytest.approx(40) and out["line"]["base_output_tokens"] == pytest.approx(120)
    assert out["point"]["per_step_tokens"] is None and out["point"]["status"] == "needs >=2 depths"


def test_empty_statistics_are_zero_in_the_report(spark):
    rows = answers("p", 0, 1, bucket="d_1") + answers("p", 1, bucket="d_2")
    cells = {r["difficulty_bucket"]: r for r in rep.stratified_report(results_df(spark, rows)).collect()}
    assert (cells["d_1"]["mean_efficiency_when_correct"], cells["d_1"]["efficiency_stddev"]) == (0.0, 0.0)
    assert (cells["d_2"]["accuracy"], cells["d_2"]["efficiency_stddev"]) == (1.0, 0.0)


def test_pivot_cells(spark):
    rows = answers("p", 0, 1, bucket="b_d3") + answers("p", 1, read=10, written=10, ideal=5.0, bucket="b_d10") + answers("q", 1, bucket="b_d10")
    r = results_df(spark, rows)

    def cells(metric, **kw):
        return {(x["model"], x["difficulty_bucket"]): (x["depth"], x["value"], x["status"]) for x in rep.pivot(r, metric, **kw).collect()}

    eff = cells("efficiency")
    assert eff["p", "b_d3"] == (3, None, "n/a") and eff["p", "b_d10"] == (10, pytest.approx(0.1), "ok") and ("q", "b_d3") not in eff
    cost = cells("dollars_per_correct", prices=prices_df(spark, {"p": (1, 1)}))
    assert cost["q", "b_d10"][1:] == (None, "n/a") and cost["p", "b_d3"][1:] == (None, "n/a") and cost["p", "b_d10"][1] == pytest.approx(2e-5)
    wide = rep.pivot(r, "accuracy", buckets=["b_d3", "b_d10"])
    assert wide.columns == ["model", "b_d3", "b_d10"]
    assert {x["model"]: (x["b_d3"], x["b_d10"]) for x in wide.collect()} == {"p": (0.0, 1.0), "q": (None, 1.0)}
