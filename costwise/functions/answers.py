"""Answer extraction and grading (row-level Column builders)."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from costwise.functions import patterns as P


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


_OTHER_DIGITS = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_THEIR_VALUES = "".join(str(unicodedata.decimal(c)) for c in _OTHER_DIGITS)


def canonical_integer(raw: Column) -> Column:
    """ASCII text of an integer's digits in any script: no leading zeros, no minus zero."""
    ascii_ = F.when(F.rlike(raw, F.lit("^-?[0-9]*$")), raw).otherwise(
        F.translate(raw, "".join(_OTHER_DIGITS), _THEIR_VALUES))
    stripped = F.regexp_replace(ascii_, "^(-?)0+([0-9])", "$1$2")
    return F.when(stripped == "-0", F.lit("0")).otherwise(stripped)


def last_integer(text: str | Column) -> Column:
    """Canonical decimal string of the last integer in ``text``, NULL if none.

    Group separators are dropped and leading zeros stripped, so ``007`` gives
    ``7`` and ``-0`` gives ``0``; digits of any script count, and the value
    stays a string so no width limit applies.
    """
    matches = F.regexp_extract_all(_col(text), F.lit(P.LAST_INTEGER), 0)
    raw = F.try_element_at(matches, F.lit(-1))
    return canonical_integer(F.regexp_replace(raw, P.GROUP_SEPARATORS, ""))


_LIMB = 17


def is_sum(total: Column, one: Column, other: Column) -> Column:
    """total = one + other for canonical integers of any length; NULL if one is missing.

    total - one - other is taken limb by limb (17 decimal digits each, so that
    three limbs and a carry fit a long) and is zero when every limb is, with a
    carry that ends at zero."""
    width = F.greatest(F.length(total), F.length(one), F.length(other))
    limbs = F.floor((width - 1) / _LIMB).cast("int")

    def limb(x: Column, i: Column) -> Column:
        digits = F.ltrim(x, F.lit("-"))
        padded = F.lpad(digits, (limbs + 1) * _LIMB, F.lit("0"))
        value = F.substring(padded, (limbs - i) * _LIMB + 1, F.lit(_LIMB)).cast("bigint")
        return F.when(F.startswith(x, F.lit("-")), -value).otherwise(value)

    size = F.lit(10**_LIMB)
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit(True).alias("zero"))

    def step(acc: Column, i: Column) -> Column:
        value = limb(total, i) - limb(one, i) - limb(other, i) + acc["carry"]
        rest = F.pmod(value, size)
        return F.struct(((value - rest) / size).cast("bigint").alias("carry"), (acc["zero"] & (rest == 0)).alias("zero"))

    done = F.aggregate(F.sequence(F.lit(0), limbs), start, step)
    short = total.cast("bigint") == one.cast("bigint") + other.cast("bigint")
    return F.when(width <= _LIMB, short).otherwise(done["zero"] & (done["carry"] == 0))


def grade_exact(parsed: str | Column, expected: str | Column) -> Column:
    """True when an answer was parsed and equals the expected canonical text."""
    return F.coalesce(_col(parsed) == _col(expected), F.lit(False))


def _first_group(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def consistency_fields(text: str | Column) -> Column:
    """Struct (a, b, c, verdict) of a consistency reply; missing parts NULL.

    Integers are canonical digit strings, so the rule ``a = b + c`` is exact at
    any length.
    """
    t = _col(text)
    return F.struct(
        canonical_integer(_first_group(t, P.CONSISTENCY_A)).alias("a"),
        canonical_integer(_first_group(t, P.CONSISTENCY_B)).alias("b"),
        canonical_integer(_first_group(t, P.CONSISTENCY_C)).alias("c"),
        F.lower(_first_group(t, P.CONSISTENCY_VERDICT)).alias("verdict"),
    )


def grade_consistency(fields: str | Column) -> Column:
    """Correct when the claimed verdict matches ``a = b + c`` on the emitted values.

    Any missing part makes the reply incorrect.
    """

    def grade(f: Column) -> Column:
        return F.coalesce(is_sum(f["a"], f["b"], f["c"]) == (f["verdict"] == F.lit("consistent")), F.lit(False))

    # bound once: the fields' expressions are evaluated a single time
    return F.transform(F.array(_col(fields)), grade)[0]
