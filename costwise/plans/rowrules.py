"""Registered plans: answer lookup, message blocks, bucket labels, progress estimate, manifests, report export."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from costwise.functions.buckets import depth_from_parameters, difficulty_bucket
from costwise.functions.usage import block_usage
from costwise.operators import reports as rep
from costwise.operators.scoring import attach_answers
from costwise.plans.common import R6, finish, plan
from costwise.session import checkpoint_dir
from costwise.sources.jsonl import export_json, read_manifests, write_manifests
from costwise.streaming import jobs


@plan(
    "answer_lookup", "C6",
    """
SELECT r.task_id, r.model, r.seq, r.output_tokens, t.expected_terminal AS canonical_terminal_answer
FROM fx_results r JOIN fx_tasks t ON r.task_id = t.task_id
""",
    "fx_results", "fx_tasks",
)
def answer_lookup(fx):
    tasks = fx["fx_tasks"].withColumnRenamed("expected_terminal", "canonical_terminal_answer")
    return attach_answers(fx["fx_results"].select("task_id", "model", "seq", "output_tokens"), tasks)


@plan(
    "message_blocks", "B18",
    """
SELECT event_id AS request_id, CASE WHEN event_id % 4 = 0 THEN 'only' ELSE concat('a', event_id, ' and b') END AS text,
  CASE WHEN event_id % 3 = 0 THEN concat('t', event_id) END AS thinking_content,
  CASE WHEN event_id % 5 <> 0 THEN user_id END AS input_tokens, CASE WHEN event_id % 5 <> 0 THEN event_id % 90 END AS output_tokens,
  CASE WHEN event_id % 2 = 0 THEN 'end_turn' ELSE 'max_tokens' END AS stop_reason
FROM events
""",
)
def message_blocks(fx):
    """Blocks of one answer: thinking in a third of them, text in one or two parts, usage in four of five."""
    number = F.col("event_id").cast("string")
    every = lambda n, then, otherwise="": F.when(F.col("event_id") % n == 0, F.lit(then)).otherwise(F.lit(otherwise))
    payload = F.concat(
        F.lit('{"content":['),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"type":"thinking","thinking":"t'), number, F.lit('"},'))).otherwise(F.lit("")),
        F.when(F.col("event_id") % 4 == 0, F.lit('{"type":"text","text":"only"}')).otherwise(
            F.concat(F.lit('{"type":"text","text":"a'), number, F.lit('"},{"type":"text","text":" and b"}'))),
        F.lit("]"),
        F.when(F.col("event_id") % 5 != 0, F.concat(
            F.lit(',"usage":{"input_tokens":'), F.col("user_id").cast("string"), F.lit(',"output_tokens":'),
            (F.col("event_id") % 90).cast("string"), F.lit("}"))).otherwise(F.lit("")),
        F.lit(',"stop_reason":"'), every(2, "end_turn", "max_tokens"), F.lit('"}'),
    )
    return fx["events"].select(F.col("event_id").alias("request_id"), block_usage(payload).alias("u")).select(
        "request_id", "u.text", "u.thinking_content", "u.input_tokens", "u.output_tokens", "u.stop_reason")


@plan(
    "bucket_labels", "B11 B13",
    """
SELECT p_partkey AS task, CASE WHEN p_partkey % 3 = 0 THEN concat('b_d', p_size) ELSE concat('depth_', 1 + p_size % 4) END AS bucket,
  CASE WHEN p_partkey % 3 = 1 THEN CAST(p_size AS BIGINT) END AS depth
FROM part
""",
)
def bucket_labels(fx):
    size = F.col("p_size").cast("string")
    parameters = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('{"bucket":"b_d'), size, F.lit('"}')))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('{"bucket":7,"recipe":{"per_segment_difficulty":{"depth":'), size, F.lit("}}}")))
        .otherwise(F.lit('{"bucket":""}'))
    )
    t = fx["part"].select(
        F.col("p_partkey").alias("task"), parameters.alias("p"), F.sequence(F.lit(0), F.col("p_size") % 4).alias("nodes"))
    return t.select("task", difficulty_bucket("p", "nodes").alias("bucket"), depth_from_parameters("p").alias("depth"))


@plan(
    "progress_eta", "I4",
    f"""
WITH day AS (
  SELECT event_type AS model, time_bucket(INTERVAL 1 DAY, ts) AS w, count(*) AS n FROM events GROUP BY 1, 2),
rate AS (
  SELECT model, n / CAST(86400 AS DOUBLE) AS per_second FROM day d
  WHERE w = (SELECT max(w) FROM day x WHERE x.model = d.model)),
todo AS (SELECT event_type AS model, count(*) AS n_pending FROM events WHERE value < 10 GROUP BY 1)
SELECT todo.model, n_pending, {R6('per_second')} AS per_second, {R6('n_pending / per_second')} AS eta_seconds
FROM todo LEFT JOIN rate ON rate.model = todo.model
""",
)
def progress_eta(fx):
    ev = fx["events"].select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), "value")
    done = jobs.progress(ev.withColumn("ok", F.col("value") >= 50), "ts", "1 day", "1 day")
    return finish(jobs.eta(done, ev.filter("value < 10")))


@plan(
    "manifest_roundtrip", "A6",
    """
SELECT concat('run-', s_nationkey) AS run_id, count(*) AS task_count, CAST(2 AS INTEGER) AS n_models,
  CAST(min(s_suppkey) AS BIGINT) AS run_seed, TIMESTAMP '2026-07-02 18:37:46' AS created
FROM supplier GROUP BY s_nationkey
""",
)
def manifest_roundtrip(fx):
    """A manifest for each nation's suppliers, written one file a run and read back."""
    runs = fx["supplier"].groupBy("s_nationkey").agg(F.count("*").alias("task_count"), F.min("s_suppkey").alias("run_seed")).select(
        F.concat(F.lit("run-"), F.col("s_nationkey").cast("string")).alias("run_id"), F.lit("2026-07-02T18:37:46+00:00").alias("created_at"),
        F.lit("chain").alias("family"), "run_seed", F.array(F.lit("a"), F.lit("b")).alias("models"), "task_count",
    )
    path = f"{checkpoint_dir(fx.spark).rstrip('/')}/io/manifests-{uuid.uuid4().hex[:12]}"
    write_manifests(runs, path)
    back = read_manifests(fx.spark, f"{path}/*/*.txt")
    return back.select("run_id", "task_count", F.size("models").alias("n_models"), "run_seed", F.col("created_ts").cast("timestamp_ntz").alias("created"))


@plan(
    "report_export", "A8 D1",
    f"""
SELECT model, difficulty_bucket, count(*) AS n,
  {R6('count(*) FILTER (WHERE terminal_correct) / count(*)')} AS accuracy,
  {R6('coalesce(avg(efficiency), CAST(0 AS DOUBLE))')} AS mean_efficiency_when_correct
FROM fx_results GROUP BY model, difficulty_bucket
""",
    "fx_results",
)
def report_export(fx):
    """The stratified report as exported JSON, read back."""
    report = rep.stratified_report(fx["fx_results"]).select("model", "difficulty_bucket", "n", "accuracy", "mean_efficiency_when_correct")
    path = f"{checkpoint_dir(fx.spark).rstrip('/')}/io/report-{uuid.uuid4().hex[:12]}"
    export_json(report, path)
    return finish(fx.spark.read.schema(report.schema).json(path))
