from __future__ import annotations

import math
import random

import numpy as np
import pytest

from costwise.llm import top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in ok:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, a in asked.items():
        scores = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(a))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, p=top_k.Params()):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k.top_k(df, p).collect())


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_against_brute_force(spark, spread):
    rng = np.random.default_rng(int(spread * 2))
    m = rng.normal(size=(700, 12)) * np.exp(spread * rng.normal(size=(700, 1)))
    m[100:160] = m[50] * rng.choice([1, 1, 0.5], size=(60, 1))  # many equal directions
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, top_k.Params(bucket=16, block=4, head=20, coordinate_from=0.1)) == brute(rows)


def test_ties_repeats_and_odd_rows(spark):
    rows = [(i, [0.5, 0.25]) for i in range(101, 0, -1)] + [(0, [0.5, 0.25]), (0, [0.5, 0.25]), (200, [0.0, 0.0]), (250, [-1.0, -0.001])]
    rows += [(300, None), (350, []), (400, [None, 1.0]), (450, [float("nan"), 1.0]), (500, [float("inf"), 0.0]), (None, [1.0, 1.0])]
    rows += [(600, [1.0, 2.0, 3.0]), (7, [0.5, 0.25]), (7, [3.0, 3.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == brute([(0, [1.0]), (1, [2.0])])


def test_extra_columns(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(1)
    rows = [(i, [rnd.random(), rnd.random()]) for i in range(60)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    for c in ("v", "score", "rank", "query_id"):
        df = df.withColumn(c, F.lit("x"))
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k.top_k(df).collect()) == brute(rows)
