"""Model spec strings ``provider:model[#knob=value]`` (Column builders).

Fixed values that must equal the reference for identical results:
  providers: moonshot, openai, anthropic, deepseek
  knobs: effort=low|medium|high (openai only), thinking=off (moonshot only)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROVIDERS = ("moonshot", "openai", "anthropic", "deepseek")
EFFORT_VALUES = ("low", "medium", "high")


def _cut(s: Column, sep: str) -> tuple[Column, Column]:
    """(before first ``sep`` or all of ``s``, after first ``sep`` or '') like str.partition."""
    parts = F.split(s, sep, 2)
    return F.element_at(parts, 1), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))


def split_spec(spec: str | Column) -> Column:
    """Struct (provider, model_id, knob, knob_value, error); invalid specs get an error code
    instead of failing the job, so bad rows can be quarantined."""
    s = F.col(spec) if isinstance(spec, str) else spec
    provider, rest = _cut(s, ":")
    model_id, frag = _cut(rest, "#")
    knob, value = _cut(frag, "=")
    is_effort = (knob == "effort") & value.isin(*EFFORT_VALUES)
    is_thinking = (knob == "thinking") & (value == "off")
    error = (
        F.when((frag != "") & is_effort & (provider != "openai"), F.lit("effort_requires_openai"))
        .when((frag != "") & ~is_effort & is_thinking & (provider != "moonshot"),
              F.lit("thinking_off_requires_moonshot"))
        .when((frag != "") & ~is_effort & ~is_thinking, F.lit("unsupported_fragment"))
        .when(~provider.isin(*PROVIDERS), F.lit("unknown_provider"))
    )
    return F.struct(
        provider.alias("provider"),
        model_id.alias("model_id"),
        F.nullif(knob, F.lit("")).alias("knob"),
        F.when(frag != "", value).alias("knob_value"),
        error.alias("error"),
    )
