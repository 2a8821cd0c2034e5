"""Exact top-k by inner product through norm buckets.

Candidates are spread over the tasks and, inside a task, sorted by length into buckets of a bounded
number of rows. Queries travel in blocks of a bounded size. For each query a task knows the score
that its k-th best so far has; divided by the query's length and the bucket's longest length it is
the bucket's local cosine threshold:

* above 1 the bucket is left out, and with it all shorter ones;
* low thresholds select by length alone: rows at least as long as the threshold asks;
* high ones select by coordinates: on the query's ``focus`` strongest coordinates the product is exact,
  on the others the Cauchy-Schwarz bound of the two rests holds; rows whose bound stays below go.

What is left is verified by the whole integer product. Each task gives at most k rows a query, which
a window over the query merges; tasks first raise their thresholds by the longest vectors of all.

Components become floor(256 x); scores are integers and exact while lengths times each other stay under
2**53. Defined cases: vectors that are null, empty or hold a null or a non-finite component take no part, nor
do rows without id; vectors of another number of components are other spaces and not compared;
repeated rows are candidates each, but no row with the query's own id is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from costwise.llm.storage import map_batches, prefixed, ship


@dataclass(frozen=True)
class Params:
    k: int = 5
    every: int = 50
    bucket: int = 1024
    #: Queries of a block, that is of one pass over the candidates; their vectors are what is broadcast.
    block: int = 4096
    #: Longest vectors from which all tasks take their first thresholds.
    head: int = 512
    focus: int = 8
    coordinate_from: float = 0.5


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and v: array<long> floor(256 x) of the rows that take part."""
    whole = (
        F.col("vec_id").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    )
    return prefixed(rows, "vec_id", "embedding").filter(whole).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"),
    )


def _matrices(batch):
    """(ids, matrix) for each number of components in a batch of vec_id, v."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.append(0, np.cumsum(sizes))
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield int(n), ids[rows], flat[at[rows][:, None] + np.arange(n)]


class _Best:
    """The best k (score, id) of each query; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.append(self.score[q], scores), np.append(self.ids[q], ids)
        order = np.lexsort((i, -s))[: self.k]
        self.score[q], self.ids[q] = s[order], i[order]


def scan_bucket(best: _Best, floor: np.ndarray, q_ids, q, q_norm, q_focus, q_rest, ids, m, norms, p: Params) -> None:
    """Offer one bucket (rows by decreasing length) to every query. ``floor``: scores known to be reached k times."""
    threshold = np.maximum(best.score[:, -1], floor)
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = threshold / (q_norm * norms[0])
    cosine[~np.isfinite(threshold)] = -1
    cosine[(q_norm * norms[0] == 0) & np.isfinite(threshold)] = np.where(threshold > 0, 2.0, -1.0)[(q_norm * norms[0] == 0) & np.isfinite(threshold)]
    for i in np.flatnonzero(cosine <= 1 + 1e-9):
        t = threshold[i]
        if cosine[i] <= 0 or q_norm[i] == 0:
            rows = slice(None)
        else:
            rows = slice(0, int(np.searchsorted(-norms, -(t / q_norm[i]) * (1 - 1e-9), "right")))
        own, own_ids = m[rows], ids[rows]
        if cosine[i] > p.coordinate_from and len(own):
            at = q_focus[i]
            part = own[:, at]
            rest = np.sqrt(np.maximum(norms[rows] ** 2 - (part * part).sum(axis=1), 0))
            keep = part @ q[i, at] + rest * q_rest[i] >= t - 1e-6 * max(1.0, abs(t))
            own, own_ids = own[keep], own_ids[keep]
        if len(own):
            score = own @ q[i]
            keep = (own_ids != q_ids[i]) & (score >= t)
            if keep.any():
                best.add(i, score[keep], own_ids[keep])


def _search(batches, queries, floors, p: Params):
    """Best rows of one task for one block: (query_id, vec_id, score)."""
    spaces: dict[int, tuple] = {}
    for n, (q_ids, q) in queries.items():
        strong = np.argsort(-np.abs(q), axis=1)[:, : p.focus]
        norm = np.sqrt((q * q).sum(axis=1))
        inside = np.take_along_axis(q, strong, axis=1)
        rest = np.sqrt(np.maximum(norm**2 - (inside * inside).sum(axis=1), 0))
        spaces[n] = (q_ids, q, norm, strong, rest, _Best(len(q_ids), p.k))
    for batch in batches:
        for n, ids, m in _matrices(batch):
            if n not in spaces:
                continue
            q_ids, q, norm, strong, rest, best = spaces[n]
            norms = np.sqrt((m * m).sum(axis=1))
            order = np.argsort(-norms, kind="stable")
            for a in range(0, len(order), p.bucket):
                rows = order[a : a + p.bucket]
                scan_bucket(best, floors[n], q_ids, q, norm, strong, rest, ids[rows], m[rows], norms[rows], p)
    for q_ids, *_, best in spaces.values():
        real = np.isfinite(best.score)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(q_ids, real.sum(axis=1))), pa.array(best.ids[real]), pa.array(best.score[real].astype(np.int64))],
            ["query_id", "vec_id", "score"],
        )


def _gather(rows) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["v"]), []).append(r)
    return {n: (np.array([r["vec_id"] for r in x], np.int64), np.array([r["v"] for r in x], np.float64)) for n, x in by.items()}


def _query_blocks(rows: DataFrame, p: Params):
    block = []
    # of rows that repeat a query's id the smallest vector asks
    asked = rows.filter(F.col("vec_id") % p.every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    for r in asked.orderBy("vec_id").toLocalIterator():
        block.append(r)
        if len(block) == p.block:
            yield block
            block = []
    if block:
        yield block


def top_k(embeddings: DataFrame, p: Params = Params()) -> DataFrame:
    """query_id, rank, vec_id, score: of every query (an id divisible by ``every``) the k best other rows."""
    spark = embeddings.sparkSession
    ship(spark)
    rows = usable(embeddings)
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    head = _gather(rows.orderBy(F.desc(length), "vec_id").limit(p.head).collect())  # at most p.head rows
    schema = "query_id long, vec_id long, score long"
    found = spark.createDataFrame([], schema)
    for block in _query_blocks(rows, p):
        queries, floors = _gather(block), {}
        for n, (q_ids, q) in queries.items():
            floors[n] = np.full(len(q_ids), -np.inf)
            if n in head and len(head[n][0]) > p.k:
                ids, m = head[n]
                scores = np.where(q_ids[:, None] == ids[None, :], -np.inf, q @ m.T)
                floors[n] = -np.partition(-scores, p.k - 1, axis=1)[:, p.k - 1]
        sent = spark.sparkContext.broadcast((queries, floors, p))

        def run(batches, sent=sent):
            yield from _search(batches, *sent.value)

        found = found.unionByName(map_batches(rows, run, schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
