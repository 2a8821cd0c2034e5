"""Registered plans for the sources and sinks: a results / price-sheet round trip
through JSON lines and a JSON sheet file, and the seed grid."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from costwise.functions.buckets import depth_from_parameters, difficulty_bucket
from costwise.operators import economics as econ
from costwise.operators import ladder as lad
from costwise.operators import synth as sy
from costwise.plans.common import finish, plan
from costwise.plans.economics import TOTALS_SQL
from costwise.plans.common import R6
from costwise.session import checkpoint_dir
from costwise.sources.jsonl import read_results, read_tasks, write_jsonl
from costwise.sources.prices import load_price_sheet


def _as_results(r):
    """fx_results with the remaining result fields (text, version, weights)."""
    return r.select(
        "task_id", "model", "terminal_correct", "parsed_terminal", "expected_terminal", "input_tokens",
        "output_tokens", "cost", "v_star", "efficiency",
        F.coalesce("parsed_terminal", F.lit("")).alias("response_text"),
        F.lit("fx-1.0").alias("generator_version"),
        F.array(F.lit(1.0), F.lit(4.0)).alias("weights"), "difficulty_bucket",
    )


def _with_extra(r, extra):
    """Results with ``extra`` as response_extra and seq as the generator version."""
    own = {"response_text": F.coalesce("parsed_terminal", F.lit("")), "generator_version": F.col("seq").cast("string"),
           "weights": F.array(F.lit(1.0), F.lit(4.0)), "response_extra": extra}
    return r.withColumns(own).drop("raw", "seq", "depth", "group_seed")


@plan(
    "jsonl_roundtrip", "A1 A3 A4 A5 A8 G1 C4 D2",
    f"""
WITH {TOTALS_SQL}
SELECT model, n, n_correct, {R6('accuracy')} AS accuracy, {R6('spend_dollars')} AS spend_dollars,
  {R6('dollars_per_correct')} AS dollars_per_correct, {R6('mean_waste')} AS mean_waste_ratio, priced
FROM priced2
""",
    "fx_results", "fx_prices",
)
def jsonl_roundtrip(fx):
    base = f"{checkpoint_dir(fx.spark).rstrip('/')}/io/{uuid.uuid4().hex[:12]}"
    r = _as_results(fx["fx_results"])
    # two result files (two runs), merged on read as a bag
    write_jsonl(r.filter(F.hash("task_id") % 2 == 0), f"{base}/run_a", mode="overwrite", compression="gzip")
    write_jsonl(r.filter(F.hash("task_id") % 2 != 0), f"{base}/run_b", mode="overwrite", compression="gzip")
    # the sheet as one JSON document {model: {"in": .., "out": ..}, "_note": ..}
    entries = F.map_from_entries(F.collect_list(F.struct(
        "model", F.struct(F.col("price_in").alias("in"), F.col("price_out").alias("out")))))
    doc = F.concat(F.lit('{"_note": "dollars per million tokens", '), F.regexp_replace(F.to_json(entries), r"\A\{", ""))
    sheet = fx["fx_prices"].agg(doc.alias("value"))
    sheet.write.mode("overwrite").text(f"{base}/prices")
    results = read_results(fx.spark, [f"{base}/run_a", f"{base}/run_b"])
    prices = load_price_sheet(fx.spark, f"{base}/prices/*.txt").drop("sheet_id")
    return finish(econ.dollars_summary(results, prices))


def _folder(fx) -> str:
    return f"{checkpoint_dir(fx.spark).rstrip('/')}/io/{uuid.uuid4().hex[:12]}"


@plan(
    "results_roundtrip", "A1 A4 A5",
    """
SELECT task_id, model, seq, CASE WHEN seq % 5 = 0 THEN '{}' ELSE
  concat('{"attempt":', seq % 7, ',"cut":', CASE WHEN terminal_correct THEN 'false' ELSE 'true' END, ',"note":null,"share":', output_tokens % 100, '.25,',
    '"tags":["m",', input_tokens, ',{"deep":null}],"usage":{"id":"007","reasoning":', output_tokens, '}}') END AS response_extra,
  CASE WHEN seq % 5 <> 0 THEN seq % 7 END AS attempt, CASE WHEN seq % 5 <> 0 THEN NOT terminal_correct END AS cut,
  CASE WHEN seq % 5 <> 0 THEN output_tokens END AS reasoning, CASE WHEN seq % 5 <> 0 THEN '007' END AS id
FROM fx_results
""",
    "fx_results",
)
def results_roundtrip(fx):
    """Results with nested, typed extra fields through JSON lines, Parquet and JSON lines again."""
    r = fx["fx_results"].withColumn("raw", F.concat(
        F.lit('{"usage":{"reasoning":'), F.col("output_tokens"), F.lit(',"id":"007"},"tags":["m",'), F.col("input_tokens"),
        F.lit(',{"deep":null}],"share":'), F.col("output_tokens") % 100, F.lit('.25,"note":null,"attempt":'), F.col("seq") % 7,
        F.lit(',"cut":'), (~F.col("terminal_correct")).cast("string"), F.lit("}")))
    # every fifth row is a legacy one: no object (the field null), seq travels as the version
    extra = F.when(F.col("seq") % 5 != 0, F.parse_json("raw"))
    rows = _with_extra(r, extra)
    base = _folder(fx)
    write_jsonl(rows, f"{base}/lines", compression="gzip")
    read_results(fx.spark, f"{base}/lines").write.option("compression", "zstd").parquet(f"{base}/table")
    write_jsonl(fx.spark.read.parquet(f"{base}/table"), f"{base}/again", compression="gzip")
    back = read_results(fx.spark, f"{base}/again")
    get = lambda path, kind: F.variant_get("response_extra", path, kind)
    return back.select(
        "task_id", "model", F.col("generator_version").cast("bigint").alias("seq"), F.to_json("response_extra").alias("response_extra"),
        get("$.attempt", "bigint").alias("attempt"), get("$.cut", "boolean").alias("cut"),
        get("$.usage.reasoning", "bigint").alias("reasoning"), get("$.usage.id", "string").alias("id"),
    )


@plan(
    "tasks_roundtrip", "A2 A4 B11 B13",
    """
SELECT task_id, depth AS depth_of_parameters, CASE WHEN group_seed % 2 = 0 THEN difficulty_bucket ELSE 'depth_2' END AS bucket,
  concat('{"bucket":', CASE WHEN group_seed % 2 = 0 THEN concat('"', difficulty_bucket, '"') ELSE 'null' END,
    ',"recipe":{"per_segment_difficulty":{"depth":', depth, '},"weights":[1,4.5,true]}}') AS parameters,
  CAST(18446744073709551000 + group_seed AS DECIMAL(20,0)) AS seed, v_star_input_tokens, depth * 2 AS hops, 2 AS n_nodes
FROM fx_tasks
""",
    "fx_tasks",
)
def tasks_roundtrip(fx):
    """Tasks with nested parameters and item metadata through JSON lines and back, fields read from the VARIANT."""
    t = fx["fx_tasks"]
    bucket = F.when(F.col("group_seed") % 2 == 0, F.concat(F.lit('"'), F.col("difficulty_bucket"), F.lit('"'))).otherwise("null")
    parameters = F.parse_json(F.concat(
        F.lit('{"recipe":{"weights":[1,4.5,true],"per_segment_difficulty":{"depth":'), F.col("depth"), F.lit('}},"bucket":'), bucket, F.lit("}")))
    metadata = F.parse_json(F.concat(F.lit('{"hops":'), F.col("depth") * 2, F.lit("}")))
    item = F.struct(
        F.lit("i").alias("id"), F.lit("q").alias("question"), F.lit("1").alias("known_answer"), F.lit("integer").alias("answer_type"),
        F.lit("s").alias("source"), F.lit("1").alias("source_version"), F.array(F.lit("p")).alias("parameter_templates_supported"),
        metadata.alias("metadata"))
    template = F.struct(F.lit("p").alias("name"), F.parse_json(F.lit('{"k":[1]}')).alias("args"), F.lit("integer").alias("output_type"))
    node = F.struct(item.alias("item"), template.alias("parameter_template"), F.lit("q").alias("instantiated_question"))
    rows = t.select(
        "task_id", F.lit("fx-1.0").alias("generator_version"), F.lit("chain").alias("template_id"),
        (F.lit("18446744073709551000").cast("decimal(20,0)") + F.col("group_seed")).cast("decimal(20,0)").alias("seed"),
        parameters.alias("parameters"), F.array(node, node).alias("nodes"), F.lit("How many?").alias("merged_prompt"),
        F.col("expected_terminal").alias("canonical_terminal_answer"), F.lit("integer").alias("terminal_answer_type"),
        F.col("v_star_input_tokens").cast("bigint").alias("v_star_input_tokens"), "v_star_output_tokens")
    path = f"{_folder(fx)}/tasks"
    write_jsonl(rows, path, compression="gzip")
    back = read_tasks(fx.spark, path)
    return back.select(
        "task_id", depth_from_parameters("parameters").cast("int").alias("depth_of_parameters"),
        difficulty_bucket("parameters", "nodes").alias("bucket"), F.to_json("parameters").alias("parameters"), "seed", "v_star_input_tokens",
        F.variant_get(F.col("nodes")[1]["item"]["metadata"], "$.hops", "int").alias("hops"), F.size("nodes").alias("n_nodes"),
    )


@plan(
    "latest_over_files", "D9 A1 A5",
    """
SELECT task_id, model, terminal_correct, output_tokens, CAST(seq AS VARCHAR) AS generator_version FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id, model ORDER BY seq DESC, output_tokens DESC, terminal_correct DESC) AS back FROM fx_results) WHERE back = 1
""",
    "fx_results",
)
def latest_over_files(fx):
    """Two runs of several files each, records in the order of seq: of a repeated pair the last one in the files stays."""
    r = fx["fx_results"]
    half = r.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0
    base = _folder(fx)
    files = max(4, int(fx.spark.conf.get("spark.sql.shuffle.partitions")))
    for name, part in (("z_first", r.filter(F.col("seq") <= half)), ("a_second", r.filter(F.col("seq") > half))):
        ordered = part.repartitionByRange(files, "seq").sortWithinPartitions("seq", "output_tokens", "terminal_correct")
        write_jsonl(_with_extra(ordered, F.lit(None).cast("variant")), f"{base}/{name}", compression="gzip")
    back = read_results(fx.spark, [f"{base}/z_first", f"{base}/a_second"], with_order=True)
    latest = lad.latest_per_key(
        back.select("task_id", "model", "terminal_correct", "output_tokens", "generator_version", "ingest"), ["task_id", "model"], ["ingest"],
        keep_order=False)
    return latest


_CELLS = [(3, 1), (6, 2), (10, 0)]
_N = 4


@plan(
    "seed_grid", "K1",
    "SELECT CAST(c_custkey * 1000 AS BIGINT) + c.ci * 100003 + i.i * 2027 AS seed, c.depth, c.distractors "
    "FROM customer CROSS JOIN (VALUES " + ", ".join(f"({i}, {d}, {x})" for i, (d, x) in enumerate(_CELLS))
    + ") c(ci, depth, distractors) CROSS JOIN (SELECT unnest(range(" + str(_N) + ")) AS i) i",
)
def seed_grid(fx):
    base = fx["customer"].select((F.col("c_custkey") * 1000).alias("seed0"))
    return sy.seed_grid(base, _CELLS, _N)
