"""JSON-lines results and tasks, manifests, Parquet and report export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costwise.schemas import (
    MANIFEST_SCHEMA,
    RESULT_REQUIRED,
    RESULT_SCHEMA,
    TASK_SCHEMA,
)


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    """Fail the job (lazily, at execution) when a required field is missing in a row."""
    missing = None
    for c in columns:
        cond = F.col(c).isNull()
        missing = cond if missing is None else (missing | cond)
    if missing is None:
        return df
    check = F.when(missing, F.raise_error(F.lit(f"{what}: required field missing"))).otherwise(
        F.lit(True)
    )
    return df.filter(check.cast("boolean"))


def _read_json(spark: SparkSession, schema: str, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(list(paths) if not isinstance(paths, str) else paths)


def read_results(
    spark: SparkSession, paths: str | Sequence[str], *, with_source: bool = False, with_order: bool = False
) -> DataFrame:
    """Read one or many results files (A1, A5).

    Blank lines are skipped by the JSON reader, malformed lines fail the job. ``response_extra`` keeps the types of
    its values (VARIANT); legacy rows without it, and rows where it is null or empty, get an empty object. Several
    files are concatenated as a bag (no de-duplication of (task_id, model)).

    ``with_order`` adds ``ingest``, a struct that orders records as they stand: by place in the list ``paths``, file
    name, block of the file and row in the block. A block is read by one task from its start, so the row number needs
    no shuffle. ``latest_per_key(..., ["ingest"])`` then keeps the last record of a key (D9)."""
    if with_order:
        parts = [
            _read_json(spark, RESULT_SCHEMA, path).withColumn("ingest", F.struct(
                F.lit(i).alias("place"), F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))
            for i, path in enumerate([paths] if isinstance(paths, str) else paths)
        ]
        df = merge_results(parts)
        if with_source:
            df = df.withColumn("source_file", F.col("ingest.file"))
    else:
        df = _read_json(spark, RESULT_SCHEMA, paths)
        if with_source:
            df = df.withColumn("source_file", F.col("_metadata.file_path"))
    empty = F.coalesce(F.to_json("response_extra").isin("null", "{}", "[]", '""', "false", "0"), F.lit(True))
    df = df.withColumn("response_extra", F.when(empty, F.parse_json(F.lit("{}"))).otherwise(F.col("response_extra")))
    return require_columns(df, RESULT_REQUIRED, "results")


def read_tasks(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Read tasks JSONL (A2); free-form dictionaries (parameters, template arguments, metadata) are VARIANT."""
    df = _read_json(spark, TASK_SCHEMA, paths)
    return require_columns(
        df, ("task_id", "generator_version", "template_id", "merged_prompt",
             "canonical_terminal_answer", "v_star_input_tokens", "v_star_output_tokens"), "tasks"
    )


#: Records of a compressed file at most: it is read by one task.
RECORDS_PER_FILE = 100_000


def write_jsonl(df: DataFrame, path: str, mode: str = "append", *, compression: str | None = None) -> None:
    """Write rows as JSON lines keeping explicit nulls; VARIANT columns become JSON values (A4, A7 batch form).

    Plain text repeats every field's name in every line; ``compression="gzip"`` takes about a tenth of its disk.
    Readers tell compressed files by their names. They cannot be split, so a task writes several of bounded length,
    named in the order of its rows (up to 1,000 of them)."""
    w = df.write.mode(mode).option("ignoreNullFields", "false")
    if compression:
        w = w.option("compression", compression).option("maxRecordsPerFile", RECORDS_PER_FILE)
    w.json(path)


def write_parquet(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), mode: str = "append") -> None:
    """Native columnar sink; partition results by ``model`` or ``run_id`` for pruning."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def merge_results(frames: Sequence[DataFrame], *, dedupe: bool = False) -> DataFrame:
    """Union result sets by name (G1); optional (task_id, model) de-duplication."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.dropDuplicates(["task_id", "model"]) if dedupe else out


def read_manifests(spark: SparkSession, pattern: str) -> DataFrame:
    """Run manifests (multi-line JSON, one file per run) as a run dimension."""
    return (
        spark.read.schema(MANIFEST_SCHEMA)
        .option("multiLine", True)
        .json(pattern)
        .withColumn("created_ts", F.to_timestamp("created_at"))
    )


def write_manifests(runs: DataFrame, path: str) -> None:
    """One JSON manifest a run, in a folder of its own (``run_id=...``)."""
    body = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")
    runs.select(body, "run_id").write.partitionBy("run_id").text(path)


def export_json(df: DataFrame, path: str) -> None:
    """Report export (A8): one JSON object per row."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
