"""Schemas of the fact and dimension tables (DDL strings, no inference)."""

from __future__ import annotations

# One row per (task, model): the central table every report reads.
RESULT_SCHEMA = (
    "task_id string not null, model string not null, terminal_correct boolean not null, "
    "parsed_terminal string, expected_terminal string not null, "
    "input_tokens bigint not null, output_tokens bigint not null, "
    "cost double not null, v_star double not null, efficiency double, "
    "response_text string not null, generator_version string not null, "
    "weights array<double> not null, difficulty_bucket string not null, "
    "response_extra variant"
)

RESULT_REQUIRED = (
    "task_id", "model", "terminal_correct", "expected_terminal", "input_tokens",
    "output_tokens", "cost", "v_star", "response_text", "generator_version", "weights",
    "difficulty_bucket",
)

# Free-form dictionaries are VARIANT: numbers, booleans, nulls and nesting keep their types,
# fields are read with variant_get, and they are written as JSON values again.
TASK_SCHEMA = (
    "task_id string not null, generator_version string not null, template_id string not null, "
    "seed decimal(20,0) not null, parameters variant, "
    "nodes array<struct<item: struct<id: string, question: string, known_answer: string, "
    "answer_type: string, source: string, source_version: string, "
    "parameter_templates_supported: array<string>, metadata: variant>, "
    "parameter_template: struct<name: string, args: variant, output_type: string>, "
    "instantiated_question: string>>, "
    "merged_prompt string not null, canonical_terminal_answer string not null, "
    "terminal_answer_type string not null, v_star_input_tokens bigint not null, "
    "v_star_output_tokens bigint not null"
)

RESPONSE_SCHEMA = (
    "task_id string not null, model string not null, response_text string not null, "
    "input_tokens bigint, output_tokens bigint, response_metadata map<string, string>"
)

PRICE_SCHEMA = "model string not null, price_in double not null, price_out double not null"

MANIFEST_SCHEMA = (
    "run_id string, created_at string, family string, family_version string, "
    "run_seed bigint, seed_was_fresh_entropy boolean, "
    "cells array<struct<depth: bigint, distractors: bigint>>, n_per_cell bigint, "
    "recipe string, models array<string>, weights array<double>, task_count bigint, "
    "replay string"
)
