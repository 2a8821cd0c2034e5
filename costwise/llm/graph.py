"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is an aggregate and a join over edges; a node with many neighbours is
only ever reduced to its minimum, never gathered. Tables between steps are
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costwise.llm.storage import stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    both = edges if not larger else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # edges point from the larger end a to the smaller end b; larger=True sees both directions
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(
        "a", F.least("a", "least").alias("least")
    )
    near = both.join(least, "a")
    if larger:
        new = near.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        new = near.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return (
        new.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``edges``: long columns a, b. Returns node, label (the component's smallest node) of
    every node that has an edge to another one."""
    now = stored(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    digest = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    before = now.agg(*digest).first()
    while before[0]:
        now = stored(_star(_star(now, True), False), "edges")
        after = now.agg(*digest).first()
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
