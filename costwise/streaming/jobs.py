"""Structured Streaming variants of scoring and the running reports.

* I1  incremental scoring: file-source responses, stream-static join with the
      task table, the batch scoring projection, append to a Parquet sink whose
      commit log gives exactly-once files.
* I2  exactly-once pairs: the pairs recorded so far, however long ago, are keys of
      the state store, so a micro-batch looks up its own pairs and reads none of the
      recorded files; its new pairs go to its epoch's folder, so a replayed epoch
      replaces itself.
* I3  running leaderboard: the state per model holds only counts and sums; the
      sheet and the ratios are a projection of the aggregate.
* I4  progress and rate: tumbling event-time windows per model.
* I5  chunk streams: ``chunk_state.collapse_chunk_streams`` closes a response by
      its own end marker, from keyed state; ``collapse_chunk_sessions`` below is
      the form for streams without markers, a session window per request that
      closes once event time has moved ``gap`` past its last chunk.

Checkpoints and sink folders of a run lie in one work folder on shared storage.
A job that is given the same work folder again resumes where it stopped; without
one it starts anew below the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costwise.functions.cost import spend_units, to_dollars
from costwise.operators.scoring import score
from costwise.session import checkpoint_dir
from costwise.sources.prices import attach_prices
from costwise.streaming.chunk_state import ROCKSDB


def stream_table(
    spark: SparkSession,
    folder: str,
    table: str,
    max_files_per_trigger: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """A file-source stream over one table in ``folder``: ``<table>.parquet``, a file or a folder of
    files, or the files matching ``pattern``."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if pattern:
        return r.option("pathGlobFilter", pattern).parquet(folder)
    # as a glob the path may name a file as well as a folder
    return r.parquet(f"{folder}/{table}.parque[t]")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new work folder; keep it to resume the job."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def run_append(stream: DataFrame, name: str, partition_by: tuple[str, ...] = (), folder: str | None = None) -> str:
    """Append-only Parquet sink with a checkpoint; runs all input not yet taken in now."""
    base = folder or work_folder(stream.sparkSession, name)
    w = stream.writeStream.format("parquet").outputMode("append") \
        .option("checkpointLocation", f"{base}/_checkpoint").option("path", f"{base}/data")
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{base}/data"


def run_complete(stream: DataFrame, name: str, folder: str | None = None) -> str:
    """Complete-mode aggregate materialised as a table, rewritten per micro-batch."""
    base = folder or work_folder(stream.sparkSession, name)

    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/data")

    q = (stream.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{base}/data"


def run_pairs(stream: DataFrame, name: str, keys: list[str], folder: str | None = None) -> str:
    """I2 + A7: record each pair once, with the first batch that brings it.

    The pairs are kept as keys of the state store (RocksDB: on disk, spread over the shuffle partitions, written
    on by changes only), so what a batch reads and writes follows the batch, not the pairs recorded before. There is
    no watermark: a pair is neither lost for being late nor recorded again after a long time."""
    base = folder or work_folder(stream.sparkSession, name)
    data = f"{base}/data"
    own = stream.select(*keys)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    stream.sparkSession.createDataFrame([], own.schema).write.mode("ignore").parquet(f"{data}/_epoch=-1")

    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{data}/_epoch={epoch_id}")

    q = (own.dropDuplicates(keys).writeStream.foreachBatch(write)
         .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return data


def score_stream(responses: DataFrame, tasks: DataFrame, **kw) -> DataFrame:
    """The batch scoring plan applied to a stream of responses (stream-static join)."""
    return score(tasks, responses, **kw)


def running_totals(results: DataFrame) -> DataFrame:
    """Running per-model totals; only sums and counts are kept in state."""
    return results.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("terminal_correct").alias("n_correct"),
        F.sum("efficiency").alias("sum_efficiency"),
        F.sum("input_tokens").alias("sum_input_tokens"),
        F.sum("output_tokens").alias("sum_output_tokens"),
    )


def priced_totals(totals: DataFrame, prices: DataFrame) -> DataFrame:
    """The running leaderboard, priced after the aggregate."""
    p = attach_prices(totals, prices)
    units = spend_units("sum_input_tokens", "sum_output_tokens", "price_in", "price_out")
    return p.select(
        "model", "n", "n_correct",
        (F.col("n_correct") / F.col("n")).alias("accuracy"),
        F.coalesce(F.col("sum_efficiency") / F.col("n_correct"), F.lit(0.0)).alias("mean_efficiency"),
        F.when(F.col("priced") & (F.col("n_correct") > 0), to_dollars(units) / F.col("n_correct")).alias("dollars_per_correct"),
    )


def progress(stream: DataFrame, event_time: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """I4: completed, correct and failed per model per tumbling window of event
    time, with the throughput (completions per second) of the window."""
    w = F.window(event_time, window)
    agg = stream.withWatermark(event_time, delay).groupBy(w.alias("w"), "model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("ok").alias("n_ok"),
    )
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    return agg.select(
        F.col("w.start").alias("window_start"), "model", "n", "n_ok",
        (F.col("n") - F.col("n_ok")).alias("n_failed"),
        (F.col("n") / seconds).alias("per_second"),
    )


def eta(progress_table: DataFrame, pending: DataFrame) -> DataFrame:
    """I4: seconds until the pending pairs of each model are done at the model's
    latest window rate. Both inputs are reduced per model before the join."""
    latest = progress_table.groupBy("model").agg(
        F.max_by("per_second", "window_start").alias("per_second"))
    todo = pending.groupBy("model").agg(F.count(F.lit(1)).alias("n_pending"))
    j = todo.join(latest, "model", "left")
    return j.select("model", "n_pending", "per_second",
                    F.when(F.col("per_second") > 0, F.col("n_pending") / F.col("per_second")).alias("eta_seconds"))


def collapse_chunk_sessions(stream: DataFrame, event_time: str, gap: str = "5 minutes") -> DataFrame:
    """I5 (streaming): one response per request once its chunk stream is idle for ``gap``."""
    sess = F.session_window(event_time, gap)
    kept = lambda c: F.filter(
        F.collect_list(F.struct(F.col("idx").alias("o"), F.col(c).alias("v"))),
        lambda s: s["v"].isNotNull() & (s["v"] != F.lit("")))
    cat = lambda c: F.array_join(F.transform(F.array_sort(kept(c)), lambda s: s["v"]), "")
    agg = stream.withWatermark(event_time, gap).groupBy("request_id", sess.alias("s")).agg(
        cat("content").alias("content"),
        cat("reasoning").alias("reasoning"),
        F.max_by("completion_tokens", F.when(F.col("completion_tokens").isNotNull(), F.col("idx")))
        .alias("completion_tokens"),
        F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col("idx"))).alias("finish_reason"),
        F.count(F.lit(1)).alias("n_chunks"),
    )
    return agg.select("request_id", "content", F.nullif("reasoning", F.lit("")).alias("reasoning"),
                      "completion_tokens", "finish_reason", "n_chunks")


def run_updates(stream: DataFrame, name: str, folder: str | None = None) -> str:
    """Update-mode sink: every micro-batch's changed rows lie in their epoch's folder, which a
    replay overwrites; readers take the latest row per key (see ``latest_updates``)."""
    base = folder or work_folder(stream.sparkSession, name)

    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/data/_epoch={epoch_id}")

    q = (stream.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{base}/data"


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current value of every key of an update-mode table (last epoch wins)."""
    from costwise.operators.ladder import latest_per_key

    return latest_per_key(spark.read.parquet(path), keys, ["_epoch"]).drop("_epoch")
