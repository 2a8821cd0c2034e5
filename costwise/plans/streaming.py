"""Registered plans that run Structured Streaming jobs to completion (availableNow)
over the test tables and return the materialised result for comparison with
the batch computation."""

from __future__ import annotations

from pyspark.sql import functions as F

from costwise.plans.audits import CHUNKS_SQL
from costwise.plans.common import R6, finish, plan
from costwise.plans.scoring import SCORED_SQL
from costwise.sources.fixtures import FX_SQL
from costwise.streaming import jobs
from costwise.streaming.chunk_state import collapse_chunk_streams


def _stream_fixture(fx, name: str, table: str):
    """A fixture view computed over a stream of its base table."""
    s = jobs.stream_table(fx.spark, fx.sf_dir, table)
    return fx.spark.sql(FX_SQL[name], **{table: s})


@plan(
    "stream_score_responses", "I1 A7 C1",
    f"""
WITH {SCORED_SQL}
SELECT task_id, model, terminal_correct, parsed_terminal, input_tokens, output_tokens,
  {R6('efficiency')} AS efficiency
FROM scored2
""",
    "fx_doc_tasks", "fx_doc_responses",
)
def stream_score_responses(fx):
    responses = _stream_fixture(fx, "fx_doc_responses", "documents")
    scored = jobs.score_stream(responses, fx["fx_doc_tasks"])
    path = jobs.run_append(scored.select("task_id", "model", "terminal_correct", "parsed_terminal",
                                         "input_tokens", "output_tokens", "efficiency"), "score")
    return finish(fx.spark.read.parquet(path))


@plan(
    "stream_running_totals", "I3 C4",
    f"""
WITH j AS (SELECT r.*, p.price_in, p.price_out FROM fx_results r LEFT JOIN fx_prices p ON r.model = p.model),
a AS (
  SELECT model, count(*) AS n, count(*) FILTER (WHERE terminal_correct) AS n_correct,
    sum(efficiency) AS se, sum(input_tokens * price_in + output_tokens * price_out) AS su, count(price_in) AS np
  FROM j GROUP BY model)
SELECT model, n, n_correct, {R6('n_correct / n')} AS accuracy,
  {R6('coalesce(se / n_correct, CAST(0 AS DOUBLE))')} AS mean_efficiency,
  {R6('CASE WHEN np > 0 AND n_correct > 0 THEN su / 1e6 / n_correct END')} AS dollars_per_correct
FROM a
""",
    "fx_results", "fx_prices",
)
def stream_running_totals(fx):
    results = _stream_fixture(fx, "fx_results", "lineitem")
    path = jobs.run_complete(jobs.running_totals(results), "totals")
    return finish(jobs.priced_totals(fx.spark.read.parquet(path), fx["fx_prices"]))


@plan(
    "stream_dedupe_pairs", "I2",
    "SELECT DISTINCT user_id, event_type FROM events",
)
def stream_dedupe_pairs(fx):
    ev = jobs.stream_table(fx.spark, fx.sf_dir, "events")
    path = jobs.run_pairs(ev, "pairs", ["user_id", "event_type"])
    return fx.spark.read.parquet(path).drop("_epoch")


@plan(
    "stream_resume_pairs", "A7 I2",
    """
SELECT user_id, event_type, CAST(min(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END) AS INTEGER) AS run
FROM events GROUP BY user_id, event_type
""",
)
def stream_resume_pairs(fx):
    """Two runs of one job: the first sees half of the events, dated two months back, the
    second starts with the rest added and records only pairs that are new."""
    spark = fx.spark
    folder = jobs.work_folder(spark, "resume")
    events = fx["events"].select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    early = events.filter(F.col("event_id") % 2 == 0).withColumn("ts", F.col("ts") - F.expr("INTERVAL 60 DAYS"))
    for n, part in ((1, early), (2, events.filter(F.col("event_id") % 2 != 0))):
        part.write.mode("append").parquet(f"{folder}/events.parquet")
        stream = spark.readStream.schema(part.schema).parquet(f"{folder}/events.parquet")
        path = jobs.run_pairs(stream, "resume", ["user_id", "event_type"], folder=f"{folder}/job")
        if n == 1:
            first = spark.read.parquet(path).agg(F.max("_epoch")).first()[0]
    run = F.when(F.col("_epoch") <= first, 1).otherwise(2)
    return spark.read.parquet(path).select("user_id", "event_type", run.cast("int").alias("run"))


@plan(
    "stream_progress", "I4",
    """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type AS model, count(*) AS n,
  count(*) FILTER (WHERE value >= 50) AS n_ok, count(*) - count(*) FILTER (WHERE value >= 50) AS n_failed,
  round(count(*) / CAST(86400 AS DOUBLE) * 1e6) / 1e6 AS per_second
FROM events GROUP BY 1, 2
""",
)
def stream_progress(fx):
    ev = jobs.stream_table(fx.spark, fx.sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"),
        (F.col("value") >= 50).alias("ok"))
    path = jobs.run_complete(jobs.progress(ev, "ts", "1 day", "1 day"), "progress")
    out = finish(fx.spark.read.parquet(path))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@plan(
    "stream_chunks", "I5 A7",
    CHUNKS_SQL + """, 'end' AS closed_by
FROM fx_chunks GROUP BY request_id
""",
    "fx_chunks",
)
def stream_chunks(fx):
    """Chunks nine minutes apart, in three runs of one job: a response is one row however long its stream pauses."""
    spark = fx.spark
    folder = jobs.work_folder(spark, "chunks")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("idx") * 540)
    chunks = fx["fx_chunks"].withColumn("ts", at)
    for low, high in ((None, 2), (2, 4), (4, None)):
        part = chunks.filter((F.col("idx") >= low) if low else F.lit(True)).filter((F.col("idx") < high) if high else F.lit(True))
        part.write.mode("append").parquet(f"{folder}/chunks.parquet")
        stream = spark.readStream.schema(part.schema).parquet(f"{folder}/chunks.parquet")
        path = jobs.run_append(collapse_chunk_streams(stream, "ts", until="finish"), "chunks", folder=f"{folder}/job")
    return spark.read.parquet(path)
