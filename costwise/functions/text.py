"""Text measures and surface-form predicates (Column builders)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from costwise.functions import patterns as P
from costwise.params import TOKEN_WORD_FACTOR


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_count(text: str | Column) -> Column:
    """Number of whitespace-separated words (Python ``len(text.split())``)."""
    return F.regexp_count(_col(text), F.lit(P.NON_WS + "+"))


def heuristic_tokens(text: str | Column) -> Column:
    """0 for empty text, else max(1, trunc(words * 1.3))."""
    t = _col(text)
    est = F.floor(word_count(t).cast("double") * F.lit(TOKEN_WORD_FACTOR)).cast("bigint")
    return F.when(t.isNull() | (t == F.lit("")), F.lit(0).cast("bigint")).otherwise(
        F.greatest(F.lit(1).cast("bigint"), est)
    )


def utf8_bytes(text: str | Column) -> Column:
    return F.octet_length(_col(text)).cast("bigint")


def _marker_candidate(t: Column) -> Column:
    """Cheap necessary condition of the marker pattern: one of its literal words
    (ASCII, case-insensitive) occurs, or 'q' is followed by a digit."""
    # bound once: inside a lambda every use of an expression evaluates it again
    words = F.transform(F.array(F.lower(t)), lambda lo: (
        lo.contains("step") | lo.contains("stage") | lo.contains("problem") | lo.contains("part")))
    return words[0] | t.rlike("(?i)q\\p{Nd}")


def has_decomposition_marker(text: str | Column) -> Column:
    """True when the prompt reads like it was split into steps for the model.

    The full pattern only runs on texts that pass the literal prefilter (a
    CASE branch is evaluated lazily), which skips almost every document."""
    t = _col(text)
    return F.coalesce(
        F.when(_marker_candidate(t), t.rlike(P.DECOMPOSITION_MARKERS)).otherwise(F.lit(False)),
        F.lit(False),
    )


def number_runs(text: str | Column) -> Column:
    """Maximal digit/dot runs of the text; extract once, test many values."""
    return F.regexp_extract_all(_col(text), F.lit(P.NUMBER_RUN), 0)


_NEG_RUN = "(?:^|[^\\p{Nd}.])(-[\\p{Nd}.]+)"


def leaked_values(text: str | Column, hidden: str | Column) -> Column:
    """Hidden integers that appear as standalone numbers in the text.

    A value leaks when it is not glued to another digit or a dot on either
    side, so ``42.`` at the end of a sentence does not count.

    The text is scanned once per row for its number runs (the runs are bound
    outside the per-value lambda); negative runs are extracted only for rows
    that have a negative hidden value.
    """
    t = _col(text)
    h = _col(hidden)
    runs = number_runs(t)
    neg_runs = F.when(
        F.exists(h, lambda v: v < 0), F.regexp_extract_all(t, F.lit(_NEG_RUN), 1)
    ).otherwise(F.array().cast("array<string>"))
    both = F.array(F.struct(runs.alias("pos"), neg_runs.alias("neg")))
    return F.element_at(F.transform(both, lambda r: F.filter(
        h,
        lambda v: F.when(v >= 0, F.array_contains(r["pos"], v.cast("string")))
        .otherwise(F.array_contains(r["neg"], v.cast("string"))),
    )), 1)


def any_leak(text: str | Column, hidden: str | Column) -> Column:
    return F.size(leaked_values(text, hidden)) > 0
