"""Regular expressions shared by the Column builders and the SQL oracles.

Every pattern is written so that Java's regex engine (Spark) and RE2 (DuckDB)
give the same answer: no lookaround, explicit character classes instead of the
engine-specific meaning of \\s, \\d and \\b.

Fixed values that must equal the reference for identical results:
  digits are those of any script (category Nd); an answer is compared by value
  integer answer: optional minus, then either 1-3 digits followed by groups of
    three digits separated by ',' (U+002C), '，' (U+FF0C), NBSP (U+00A0) or
    NNBSP (U+202F), or a plain digit run; the last match wins
  group separators removed before canonicalising: U+002C U+FF0C U+00A0 U+202F
  consistency reply fields: 'a = <int>', 'b = <int>', 'c = <int>',
    'verdict = consistent|inconsistent', case-insensitive, first match wins
  decomposition markers (case-insensitive): 'Step<ws>*<digit>' and
    'Stage<ws>*<digit>' at a word start, 'sub-problem' or 'subproblem'
    anywhere, 'Part<ws>+<letter or digit>' as a whole word, 'Q<digit>' as a
    whole word
  whitespace (Python str.isspace): U+0009-000D, U+001C-001F, U+0020, U+0085,
    U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000
"""

from __future__ import annotations

# Python's notion of whitespace, as one character class.
WS = (
    "[\\t\\n\\x{0B}\\x{0C}\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
NON_WS = "[^" + WS[1:]

# Word characters in the Unicode sense (letters, numbers, underscore).
WORD = "[\\p{L}\\p{N}_]"
NON_WORD = "[^\\p{L}\\p{N}_]"

GROUP_SEPARATORS = "[,\\x{FF0C}\\x{A0}\\x{202F}]"

LAST_INTEGER = "-?(?:\\p{Nd}{1,3}(?:" + GROUP_SEPARATORS + "\\p{Nd}{3})+|\\p{Nd}+)"

CONSISTENCY_A = "(?i)a" + WS + "*=" + WS + "*(-?\\p{Nd}+)"
CONSISTENCY_B = "(?i)b" + WS + "*=" + WS + "*(-?\\p{Nd}+)"
CONSISTENCY_C = "(?i)c" + WS + "*=" + WS + "*(-?\\p{Nd}+)"
CONSISTENCY_VERDICT = "(?i)verdict" + WS + "*=" + WS + "*(consistent|inconsistent)"

_START = "(?:^|" + NON_WORD + ")"
_END = "(?:$|" + NON_WORD + ")"
DECOMPOSITION_MARKERS = (
    "(?i)"
    + _START + "Step" + WS + "*\\p{Nd}"
    + "|" + _START + "Stage" + WS + "*\\p{Nd}"
    + "|sub-?problem"
    + "|" + _START + "Part" + WS + "+[A-Z0-9]" + _END
    + "|" + _START + "Q\\p{Nd}" + _END
)

# Maximal runs of digits and dots; a value is visible as a standalone integer
# exactly when one run equals its decimal text.
NUMBER_RUN = "[\\p{Nd}.]+"

TRAILING_INT = "([0-9]+)$"


def sql_literal(pattern: str) -> str:
    """Quote a pattern as a SQL string literal (single quotes doubled)."""
    return "'" + pattern.replace("'", "''") + "'"
