"""Price sheets: model -> $ per million input / output tokens.

A sheet is a dimension keyed by model. It is joined to per-model (or per-cell)
aggregates, never to the row-level fact table, so its join input is bounded by
the number of configurations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def load_price_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Read a JSON price sheet ``{model: {"in": x, "out": y}, "_note": ...}``.

    Keys starting with ``_`` are metadata and skipped; prices become DOUBLE.
    Several files (one sheet each) may be given as a glob; ``sheet_id`` is the
    file path so the same run can be repriced under every sheet.
    """
    raw = spark.read.text(path, wholetext=True).select(
        F.col("value"), F.col("_metadata.file_path").alias("sheet_id")
    )
    entries = raw.select(
        "sheet_id", F.explode(F.from_json("value", "map<string, string>")).alias("model", "p")
    ).filter(~F.col("model").startswith("_"))
    parsed = F.from_json("p", "struct<`in`: double, `out`: double>")
    return entries.select(
        "sheet_id",
        "model",
        parsed["in"].alias("price_in"),
        parsed["out"].alias("price_out"),
    )


def attach_prices(df: DataFrame, prices: DataFrame) -> DataFrame:
    """Left-join prices on ``model``: ``priced`` is False for models absent from the sheet.

    ``df`` is reduced per model or per cell, so either side is small and the join
    strategy is left to the optimizer, which knows sizes in bytes."""
    p = prices.select(
        "model", "price_in", "price_out", F.lit(True).alias("priced"),
        *([c for c in ("sheet_id",) if c in prices.columns]),
    )
    out = df.join(p, "model", "left")
    return out.withColumn("priced", F.coalesce(F.col("priced"), F.lit(False)))
