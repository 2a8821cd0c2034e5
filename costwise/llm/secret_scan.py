"""Secret scanning through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams: a conjunction of
clauses, one for each stretch of the expression that only few literal strings can match; a clause is
the disjunction of those strings, a string the conjunction of its trigrams. The index holds, for the
trigrams that some query asks for, the documents that contain them (A-Z lowered); postings are
intersected per document, and only candidates of a rule are searched with its expression. A rule
without a mandatory trigram searches every text.

Spans are exact: the pieces between matches and the matches themselves alternate, so their lengths
add up to the positions. Defined cases: a null text counts as empty; rows that repeat an id are
searched each by its own text; a null id is an id like others; extra columns are kept by ``with_spans``
unless they bear its result names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costwise.llm.storage import prefixed, stored


@dataclass(frozen=True)
class Rule:
    kind: str
    #: In the syntax that Java and Python share; matches are taken leftmost, without overlap.
    pattern: str
    #: A match counts if this group has at least ``least`` characters.
    group: int = 0
    least: int = 1
    #: What takes the place of a match where the secret is removed.
    replacement: str = "[SECRET]"
    #: Removed before the others: a match of theirs could take its first characters and leave the rest.
    first: bool = False


#: A private key from its BEGIN line through its END line; where that is missing, the key's headers and base64 lines
#: that follow. Groups repeat possessively, which Java does without recursion, so a key of any length is matched.
_KEY_GAP = r"""(?:[\s"'+>#*|]|\\[nrt])"""
_PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_KEY_GAP}*+(?:Proc-Type|DEK-Info): (?:(?!\\[nr])[^\r\n])*+)*+"
    rf"(?:{_KEY_GAP}++[A-Za-z0-9+/]{{20,}}+={{0,2}}+)*+"
    r"(?:(?:\s|\\[nr])++[A-Za-z0-9+/]++={0,2}+(?![^\r\n\\]))?+)"
)


#: The first three are the contract's base kinds, in its order.
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=6, replacement="$1=[SECRET]",
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", _PRIVATE_KEY, first=True),
    Rule("hosting_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)

Clause = list[list[str]]


def trigram_query(pattern: str, most: int = 64) -> list[Clause]:
    """Clauses (all must hold) of alternatives (one must hold) of lower-case trigrams (all must occur).

    No clause: the expression has no mandatory trigram."""
    clauses: list[Clause] = []

    def close(strings: set[str]) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            # an alternative that asks for more than another one adds nothing
            clauses.append(sorted(sorted(a) for a in sets if not any(b < a for b in sets)))

    def strings_of(op, arg) -> set[str] | None:
        """All strings that a node can match, if they are few."""
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN:
            if any(o is sre.NEGATE for o, _ in arg):
                return None
            got: set[str] = set()
            for o, a in arg:
                if o is sre.LITERAL:
                    got.add(chr(a).lower())
                elif o is sre.RANGE and a[1] - a[0] < most:
                    got |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
                else:
                    return None
            return got if len(got) <= 8 else None
        if op is sre.SUBPATTERN:
            return whole(arg[-1])
        if op is sre.BRANCH:
            parts = [whole(x) for x in arg[1]]
            return set().union(*parts) if all(p is not None for p in parts) else None
        if op is sre.MAX_REPEAT and arg[1] == 1:
            inner = whole(arg[2])
            return None if inner is None else inner | ({""} if arg[0] == 0 else set())
        return None

    def whole(nodes) -> set[str] | None:
        got = {""}
        for op, arg in nodes:
            part = strings_of(op, arg)
            if part is None or len(got) * len(part) > most:
                return None
            got = {a + b for a, b in product(got, part)}
        return got

    held = {""}
    for op, arg in _parser.parse(pattern):
        part = strings_of(op, arg)
        if part is None or len(held) * len(part) > most:
            close(held)
            held = part if part is not None else {""}
            if part is None and op is sre.SUBPATTERN:
                clauses.extend(trigram_clauses_of(arg[-1], close))
        else:
            held = {a + b for a, b in product(held, part)}
    close(held)
    return clauses


def trigram_clauses_of(nodes, close) -> list[Clause]:
    """Clauses of literal stretches directly inside a group that as a whole has too many strings."""
    text = ""
    for op, arg in nodes:
        if op is sre.LITERAL:
            text += chr(arg).lower()
        else:
            close({text} if text else set())
            text = ""
    close({text} if text else set())
    return []


def build_index(docs: DataFrame, rules=RULES) -> DataFrame:
    """Postings (gram, doc_id), once for each document and trigram that some rule asks for."""
    grams = sorted({g for r in rules for c in trigram_query(r.pattern) for s in c for g in s})
    if not grams:
        return docs.select(F.lit("").alias("gram"), "doc_id").limit(0)
    low = docs.select("doc_id", F.lower("text").alias("low")).filter(F.col("low").isNotNull())
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select(F.explode(held).alias("gram"), "doc_id")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """doc_id and, by rule, whether its trigram query holds: the intersection of the postings."""
    by_doc = index.groupBy("doc_id").agg(F.collect_set("gram").alias("grams"))  # as many as the rules name, at most

    def holds(rule: Rule) -> Column:
        clauses = trigram_query(rule.pattern)
        every = [
            reduce(Column.__or__, [reduce(Column.__and__, [F.array_contains("grams", g) for g in s]) for s in c]) for c in clauses
        ]
        return reduce(Column.__and__, every) if every else F.lit(True)

    asked = [r for r in rules if trigram_query(r.pattern)]
    out = by_doc.select("doc_id", *[holds(r).alias(f"may_{r.kind}") for r in asked])
    return out.filter(reduce(Column.__or__, [F.col(f"may_{r.kind}") for r in asked]))


_BLOCK = 512


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind_order, end>> of one rule in one text."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = F.arrays_zip(
        F.transform(F.slice(F.split(text, rule.pattern, -1), 1, F.size(matches)), F.length).alias("gap"),
        F.transform(matches, F.length).alias("own"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("part"),
    )
    # positions are running sums, by blocks, so that a text with many matches takes little more than linear time
    def blocks_of(steps: Column) -> Column:
        last = F.floor((F.size(steps) - 1) / _BLOCK).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda s, x: s + x)
        )

    def located(sizes: Column, steps: Column, blocks: Column) -> Column:
        def end(i: Column) -> Column:
            b = F.floor(i / _BLOCK).cast("int")
            before = F.aggregate(F.slice(blocks, F.lit(1), b), F.lit(0), lambda s, x: s + x)
            return before + F.aggregate(F.slice(steps, b * _BLOCK + 1, i - b * _BLOCK + 1), F.lit(0), lambda s, x: s + x)

        ends = F.transform(sizes, lambda x, i: F.struct(end(i).alias("end"), x["own"].alias("own"), x["part"].alias("part")))
        return F.transform(
            F.filter(ends, lambda x: x["part"] >= rule.least),
            lambda x: F.struct((x["end"] - x["own"]).alias("start"), F.lit(order).alias("kind"), x["end"].alias("end")),
        )

    return _bound(sizes, lambda z: _bound(
        F.transform(z, lambda x: x["gap"] + x["own"]), lambda steps: _bound(blocks_of(steps), lambda blocks: located(z, steps, blocks))
    ))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; expressions inside a lambda would be computed for each element."""
    return F.transform(F.array(value), use)[0]


def _empty() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def _searched(docs: DataFrame, rules) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ... in their order and what each rule finds as s0, s1, ...: no name can clash."""
    names = docs.columns
    index = stored(build_index(prefixed(docs, "doc_id", "text"), rules), "trigrams")
    # candidates grow with the input: they are dealt out beside the texts, whatever their number, and build the hash side
    may = candidates(index, rules).withColumnRenamed("doc_id", "candidate_id").hint("shuffle_hash")
    own = [f"c{i}" for i in range(len(names))]
    joined = docs.toDF(*own).join(may, F.col("candidate_id").eqNullSafe(F.col(own[names.index("doc_id")])), "left")
    text = F.coalesce(F.col(own[names.index("text")]), F.lit(""))

    def spans(order: int, rule: Rule) -> Column:
        asked = F.coalesce(F.col(f"may_{rule.kind}"), F.lit(False)) if trigram_query(rule.pattern) else F.lit(True)
        # the guard spares texts without a match what follows
        return F.when(asked & F.rlike(text, F.lit(rule.pattern)), _spans(text, rule, order)).otherwise(_empty())

    return joined.select(*own, *[spans(i, r).alias(f"s{i}") for i, r in enumerate(rules)])


def with_spans(docs: DataFrame, rules=RULES) -> DataFrame:
    """All columns of ``docs`` and, by rule, ``spans_<kind>``: array<struct<start, kind, end>>, kind being the rule's place.
    Columns that already have such a name are replaced."""
    found, added = _searched(docs, rules), [f"spans_{r.kind}" for r in rules]
    return found.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in added], *[F.col(f"s{i}").alias(c) for i, c in enumerate(added)]
    )


def span_text(arrays: list[Column], rules=RULES) -> Column:
    """kind:start:end of all spans, by start, then kind, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.concat_ws(
        ",",
        F.transform(
            F.array_sort(F.concat(*arrays)),
            lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")),
        ),
    )


def redact(docs: DataFrame, rules=RULES, length_column: str | None = "n_chars") -> DataFrame:
    """The same rows and columns; where a rule found something its matches are replaced, and
    ``length_column``, if there is one, is brought up to date."""
    found, names = _searched(docs, rules), docs.columns
    text = F.col(f"c{names.index('text')}")
    clean = reduce(
        lambda t, r: F.regexp_replace(t, r.pattern if r.least <= 1 else re.sub(r"\+\)$", f"{{{r.least},}})", r.pattern), r.replacement),
        sorted(rules, key=lambda r: not r.first), text,
    )
    hit = reduce(Column.__or__, [F.size(f"s{i}") > 0 for i in range(len(rules))])
    # what is replaced is computed once, beside the columns as they were
    new = found.withColumn("clean", F.when(hit, clean).otherwise(text)).withColumn("hit", hit)

    def out(i: int, name: str) -> Column:
        if name == "text":
            return F.col("clean").alias(name)
        own = F.col(f"c{i}")
        if name == length_column:
            own = F.when(F.col("hit"), F.length("clean").cast(docs.schema[name].dataType)).otherwise(own)
        return own.alias(name)

    return new.select(*[out(i, c) for i, c in enumerate(names)])
