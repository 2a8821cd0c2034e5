"""Streaming jobs give the batch answer (file source, availableNow)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from costwise.operators.chunks import collapse_chunks
from costwise.streaming import jobs

SF = "/root/testdata/sf0.001"


def _chunks(df):
    return df.select(
        F.col("conv_id").alias("request_id"), F.col("turn").alias("idx"),
        F.when(F.col("role") == "assistant", F.col("text")).alias("content"),
        F.when(F.col("role") != "assistant", F.col("text")).alias("reasoning"),
        F.when(F.col("turn") % 2 == 1, F.col("turn") * 10).alias("completion_tokens"),
        F.when(F.col("role") == "assistant", F.lit("stop")).alias("finish_reason"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn")).alias("ts"),
    )


def test_chunk_sessions_stream_equals_batch(spark):
    folder = tempfile.mkdtemp(prefix="costwise-stream-", dir="/tmp")
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    conv.toPandas().to_parquet(os.path.join(folder, "conversations.parquet"))
    # a later file whose event time moves the watermark past every real session
    late = spark.createDataFrame([(10**6, 0, "user", "late")], conv.schema)
    late.toPandas().to_parquet(os.path.join(folder, "conversations_late.parquet"))
    stream = _chunks(jobs.stream_table(spark, folder, "conversations", max_files_per_trigger=1,
                                       pattern="conversations*.parquet"))
    path = jobs.run_append(jobs.collapse_chunk_sessions(stream, "ts", "10 minutes"), "chunks")
    got = spark.read.parquet(path).filter(F.col("request_id") < 10**6)
    want = collapse_chunks(_chunks(conv).drop("ts"), block_size=3)
    cols = ["request_id", "content", "reasoning", "completion_tokens", "finish_reason", "n_chunks"]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(
        tuple(r) for r in want.select(*cols).collect())


def test_block_size_does_not_change_the_result(spark):
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    a = collapse_chunks(_chunks(conv).drop("ts"), block_size=2).collect()
    b = collapse_chunks(_chunks(conv).drop("ts"), block_size=10_000).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def _split_files(spark, df, folder, table, parts):
    """Write ``df`` as ``parts`` parquet files named <table>_<i>.parquet (one micro-batch each)."""
    pdf = df.toPandas()
    n = len(pdf)
    for i in range(parts):
        pdf.iloc[i * n // parts:(i + 1) * n // parts].to_parquet(
            os.path.join(folder, f"{table}_{i}.parquet"), coerce_timestamps="us", allow_truncated_timestamps=True)


def test_running_totals_across_micro_batches(spark):
    from costwise.operators.economics import dollars_summary
    from costwise.sources.fixtures import FX_SQL, Fixtures

    fx = Fixtures(spark, SF)
    folder = tempfile.mkdtemp(prefix="costwise-stream-", dir="/tmp")
    _split_files(spark, fx["lineitem"], folder, "lineitem", 3)
    li = jobs.stream_table(spark, SF, "lineitem")
    li = spark.readStream.schema(li.schema).option("maxFilesPerTrigger", 1) \
        .option("pathGlobFilter", "lineitem_*.parquet").parquet(folder)
    results = spark.sql(FX_SQL["fx_results"], lineitem=li)
    path = jobs.run_complete(jobs.running_totals(results), "totals3")
    got = {r["model"]: r for r in jobs.priced_totals(spark.read.parquet(path), fx["fx_prices"]).collect()}
    want = {r["model"]: r for r in dollars_summary(fx["fx_results"], fx["fx_prices"]).collect()}
    assert set(got) == set(want)
    for m, w in want.items():
        assert got[m]["n"] == w["n"] and got[m]["n_correct"] == w["n_correct"]
        if w["dollars_per_correct"] is None:
            assert got[m]["dollars_per_correct"] is None
        else:
            assert abs(got[m]["dollars_per_correct"] - w["dollars_per_correct"]) < 1e-12


def test_pair_dedupe_across_overlapping_files(spark):
    folder = tempfile.mkdtemp(prefix="costwise-stream-", dir="/tmp")
    ev = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    pdf = ev.toPandas()
    n = len(pdf)
    # three files overlapping by a third each: every pair appears in up to two files
    for i, (a, b) in enumerate([(0, n // 2), (n // 3, 5 * n // 6), (2 * n // 3, n)]):
        pdf.iloc[a:b].to_parquet(os.path.join(folder, f"events_{i}.parquet"), coerce_timestamps="us",
                                 allow_truncated_timestamps=True)
    schema = spark.read.parquet(os.path.join(folder, "events_0.parquet")).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1) \
        .option("pathGlobFilter", "events_*.parquet").parquet(folder)
    path = jobs.run_pairs(s, "dedupe3", ["user_id", "event_type"])
    got = spark.read.parquet(path).drop("_epoch")
    assert got.count() == ev.select("user_id", "event_type").distinct().count()
    assert got.count() == got.distinct().count()


def test_eta_from_latest_rate(spark):
    import datetime as dt

    prog = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1), "a", 0.5), (dt.datetime(2024, 1, 2), "a", 2.0), (dt.datetime(2024, 1, 1), "b", 0.0)],
        "window_start timestamp, model string, per_second double")
    pending = spark.createDataFrame([("t1", "a"), ("t2", "a"), ("t3", "b"), ("t4", "c")], "task_id string, model string")
    got = {r["model"]: r for r in jobs.eta(prog, pending).collect()}
    assert got["a"]["eta_seconds"] == 1.0 and got["a"]["n_pending"] == 2
    assert got["b"]["eta_seconds"] is None and got["c"]["per_second"] is None


CHUNK = "request_id long, idx long, content string, reasoning string, completion_tokens long, finish_reason string, ts timestamp"


def _run_chunks(spark, batches, **kw):
    """One run of the job a batch, all on one work folder; rows are (request, idx, content, usage, finish, minute)."""
    import datetime as dt

    from costwise.streaming.chunk_state import collapse_chunk_streams

    folder = tempfile.mkdtemp(prefix="costwise-stream-", dir="/tmp")
    for b in batches:
        rows = [(r, i, c, None, u, f, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for r, i, c, u, f, m in b]
        spark.createDataFrame(rows, CHUNK).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(CHUNK).parquet(f"{folder}/in")
        path = jobs.run_append(collapse_chunk_streams(stream, "ts", **kw), "chunks", folder=f"{folder}/job")
    return {(r.request_id, r.content, r.completion_tokens, r.finish_reason, r.n_chunks, r.closed_by)
            for r in spark.read.parquet(path).collect()}


def test_chunk_streams_close_by_their_end(spark):
    batches = [
        [(1, 0, "a", None, None, 0), (2, 0, "x", None, None, 0), (3, 0, "alone", None, None, 1), (4, 1, "late end", 3, "stop", 1)],
        [(1, 2, "c", None, "stop", 9), (2, 1, "y", 5, "length", 9)],  # the usage of 1 is still to come, and its chunk 1
        [(1, 3, "", 7, None, 18), (1, 1, "b", None, None, 18), (5, 0, "no usage", None, "stop", 18)],
        [(4, 0, "first ", None, None, 19)],
        [(9, 0, "far", None, None, 60)],
        [(9, 1, "farther", None, None, 3000)],
    ]
    assert _run_chunks(spark, batches) == {
        (1, "abc", 7, "stop", 4, "end"), (2, "xy", 5, "length", 2, "end"), (4, "first late end", 3, "stop", 2, "end"),
        (5, "no usage", None, "stop", 1, "timer"),  # a marker came, the usage did not
        (3, "alone", None, None, 1, "timer"),  # abandoned
    }


def test_chunk_streams_until_finish(spark):
    batches = [[(1, 0, "a", None, None, 0)], [(1, 2, "c", None, "stop", 9)], [(1, 1, "b", 4, None, 18), (2, 0, None, None, "stop", 18)]]
    assert _run_chunks(spark, batches, until="finish") == {(1, "abc", 4, "stop", 3, "end"), (2, "", None, "stop", 1, "end")}


def test_pairs_are_recorded_once_over_many_runs(spark):
    folder = tempfile.mkdtemp(prefix="costwise-stream-", dir="/tmp")
    seen = -1
    want = [{(1, "a"), (2, "b")}, {(3, None)}, {(4, "d")}]
    for n, rows in enumerate(([(1, "a"), (2, "b"), (1, "a")], [(2, "b"), (3, None), (1, "a")], [(3, None), (4, "d"), (2, "b")])):
        spark.createDataFrame(rows, "k long, v string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("k long, v string").parquet(f"{folder}/in")
        table = spark.read.parquet(jobs.run_pairs(stream, "pairs", ["k", "v"], folder=f"{folder}/job"))
        assert {tuple(r) for r in table.filter(F.col("_epoch") > seen).select("k", "v").collect()} == want[n]
        seen = table.agg(F.max("_epoch")).first()[0]
    assert table.count() == 4


def test_a_table_may_be_one_file_or_a_folder_of_files(spark):
    """A folder of files gave no row, and the query over it failed for want of an output."""
    from costwise.plans import REGISTRY

    whole, parts = (tempfile.mkdtemp(prefix="costwise-stream-", dir="/tmp") for _ in range(2))
    rows = [(i, f"text {i} of 1,{i:03d}", "en", f"m{i % 3}", 1000 + i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.toPandas().to_parquet(os.path.join(whole, "documents.parquet"))
    docs.repartition(3).write.parquet(os.path.join(parts, "documents.parquet"))
    docs.limit(5).toPandas().to_parquet(os.path.join(whole, "documents_other.parquet"))
    found = []
    for folder in (whole, parts):
        stream = jobs.stream_table(spark, folder, "documents", max_files_per_trigger=1)
        assert spark.read.parquet(jobs.run_append(stream, "folder")).count() == 60
        found.append(sorted(map(repr, REGISTRY["stream_score_responses"].run(spark, folder).collect())))
    assert len(found[0]) == 60 and found[0] == found[1]
