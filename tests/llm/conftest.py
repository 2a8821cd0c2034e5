from __future__ import annotations

import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang]) rows, in the columns of the table."""

    def make(rows, extra: bool = False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOC_SCHEMA)
        if extra:  # names that the operators use inside
            from pyspark.sql import functions as F

            for c in ("node", "h", "label", "row", "spans_hex", "may_assign", "component_id", "n", "class", "piece", "part", "score"):
                df = df.withColumn(c, F.lit("x"))
        return df

    return make


def words(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(n))
