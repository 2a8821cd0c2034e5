"""Normalisation of raw provider payloads held as JSON text (Column builders)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHAT_USAGE = (
    "struct<prompt_tokens: bigint, completion_tokens: bigint, "
    "completion_tokens_details: struct<reasoning_tokens: bigint>>"
)
CHAT_PAYLOAD_SCHEMA = (
    "choices array<struct<message: struct<content: string, reasoning_content: string, refusal: string>, "
    f"finish_reason: string, usage: {_CHAT_USAGE}>>, usage {_CHAT_USAGE}, "
    "finish_reason string, reasoning_content string"
)

BLOCKS_PAYLOAD_SCHEMA = (
    "content array<struct<type: string, text: string, thinking: string>>, "
    "usage struct<input_tokens: bigint, output_tokens: bigint, "
    "output_tokens_details: struct<thinking_tokens: bigint>>, stop_reason string"
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chat_usage(payload: str | Column) -> Column:
    """Struct of a chat-completion payload: answer text, token counts (NULL when
    the provider sent no usage), reasoning tokens, finish reason, reasoning text,
    refusal.

    The first choice is read; usage stands on the payload or on the choice. A
    payload without ``choices`` may carry finish reason and reasoning itself."""
    p = F.from_json(_col(payload), CHAT_PAYLOAD_SCHEMA)

    def parts(p: Column) -> Column:
        choice = F.try_element_at(p["choices"], F.lit(1))
        usage = F.coalesce(p["usage"], choice["usage"])
        message = choice["message"]
        return F.struct(
            F.coalesce(message["content"], F.lit("")).alias("text"),
            usage["prompt_tokens"].alias("input_tokens"),
            usage["completion_tokens"].alias("output_tokens"),
            usage["completion_tokens_details"]["reasoning_tokens"].alias("reasoning_tokens"),
            usage.isNotNull().alias("provider_usage"),
            F.coalesce(choice["finish_reason"], p["finish_reason"]).alias("finish_reason"),
            F.nullif(F.coalesce(message["reasoning_content"], p["reasoning_content"]), F.lit("")).alias("reasoning_content"),
            F.nullif(message["refusal"], F.lit("")).alias("refusal"),
        )

    # bound once, so that the text is parsed a single time
    return F.transform(F.array(p), parts)[0]


def block_usage(payload: str | Column) -> Column:
    """Struct of a message-blocks payload: joined text blocks, joined thinking
    blocks (empty -> NULL), token counts, stop reason."""
    p = F.from_json(_col(payload), BLOCKS_PAYLOAD_SCHEMA)
    blocks = p["content"]
    text = F.array_join(F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()),
                                    lambda b: b["text"]), "")
    thinking = F.array_join(
        F.transform(F.filter(blocks, lambda b: b["thinking"].isNotNull() & (b["thinking"] != "")),
                    lambda b: b["thinking"]), "")
    return F.struct(
        F.coalesce(text, F.lit("")).alias("text"),
        F.nullif(thinking, F.lit("")).alias("thinking_content"),
        p["usage"]["input_tokens"].alias("input_tokens"),
        p["usage"]["output_tokens"].alias("output_tokens"),
        p["usage"]["output_tokens_details"]["thinking_tokens"].alias("thinking_tokens"),
        p["stop_reason"].alias("stop_reason"),
    )
