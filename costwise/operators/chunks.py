"""Collapse provider chunk streams into one response per request (I5, batch form).

Rules: chunks are ordered by index, empty strings are ignored, an empty
reasoning text becomes NULL, and the last chunk carrying usage (or a finish
reason) wins.

Plan shape: two-level aggregation. Chunks are first reduced per (request,
block of ``block_size`` indices), so a request with a very long stream is
spread over many tasks; the second level concatenates one partial string per
block. Only the final row of a request holds its whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_SIZE = 4096


def _ordered_concat(value_col: str, order_col: str) -> F.Column:
    kept = F.filter(
        F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(value_col).alias("v"))),
        lambda s: s["v"].isNotNull() & (s["v"] != F.lit("")),
    )
    return F.array_join(F.transform(F.array_sort(kept), lambda s: s["v"]), "")


def _last_non_null(value_col: str, order_col: str) -> F.Column:
    return F.max_by(F.col(value_col), F.when(F.col(value_col).isNotNull(), F.col(order_col)))


def collapse_chunks(chunks: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """``chunks``: (request_id, idx, content, reasoning, completion_tokens, finish_reason)."""
    blocks = chunks.withColumn("block", F.floor(F.col("idx") / F.lit(block_size)).cast("bigint"))
    part = blocks.groupBy("request_id", "block").agg(
        _ordered_concat("content", "idx").alias("content"),
        _ordered_concat("reasoning", "idx").alias("reasoning"),
        _last_non_null("completion_tokens", "idx").alias("completion_tokens"),
        F.max(F.when(F.col("completion_tokens").isNotNull(), F.col("idx"))).alias("usage_idx"),
        _last_non_null("finish_reason", "idx").alias("finish_reason"),
        F.max(F.when(F.col("finish_reason").isNotNull(), F.col("idx"))).alias("finish_idx"),
        F.count(F.lit(1)).alias("n_chunks"),
    )
    whole = part.groupBy("request_id").agg(
        _ordered_concat("content", "block").alias("content"),
        _ordered_concat("reasoning", "block").alias("reasoning"),
        _last_non_null("completion_tokens", "usage_idx").alias("completion_tokens"),
        _last_non_null("finish_reason", "finish_idx").alias("finish_reason"),
        F.sum("n_chunks").alias("n_chunks"),
    )
    return whole.select(
        "request_id", "content", F.nullif(F.col("reasoning"), F.lit("")).alias("reasoning"),
        "completion_tokens", "finish_reason", "n_chunks",
    )
