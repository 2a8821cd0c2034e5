"""Conversations as training windows of a token budget, in DataFrame functions only.

Prefix sums of the turns' tokens cut every conversation into blocks; within a block turns are taken in order into
windows as long as the budget holds, so that a window begins and ends with a turn. A window repeats the conversation's
first system turn and as many of the turns before it as fit the history's share, and the loss mask covers the
assistant's turns that are new in it: each of them is a target once. A turn longer than the room of a window has one for itself,
whole. A conversation of any length is dealt out by blocks; only a block's turns meet in one row.

A turn is written ``<turn>role\\n text </turn>\\n`` without the blanks. In roles and texts the two marks lose their
``<`` to ``\\l``, a line end in a role becomes ``\\n``, and for that a backslash ``\\b``; this is undone exactly.

Defined cases: a null role, text or conversation id is an empty one or an id like others; turns are taken by ``turn``,
null first, equal turns by role, then by a hash of the text; repeated rows are turns of their own; an empty table
gives no windows; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costwise.llm.ordered import running_totals
from costwise.llm.storage import prefixed

OPEN, CLOSE = "<turn>", "</turn>"


@dataclass(frozen=True)
class Params:
    #: Tokens of a window, and how many of them may be repeated turns.
    budget: int = 1024
    history: int = 256
    #: Tokens of a turn's marks.
    overhead: int = 4
    #: A system turn of more than this share of the budget (in percent) is not repeated.
    system_percent: int = 25
    #: Budgets of one block.
    block: int = 16
    target_role: str = "assistant"
    system_role: str = "system"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for mark in (OPEN, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit("\\l" + mark[1:]))
    return text


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def tokens(text: Column) -> Column:
    """Runs of letters and digits by sixes, other characters one by one; blanks count with what follows."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}\p{Nd}]{1,6}|[^\p{L}\p{M}\p{Nd}\x20\x09-\x0D]")).cast("long")


_KEY = ["has_conv", "conv", "has_turn", "turn", "role", "h1", "h2"]


def _turns(conversations: DataFrame, params: Params) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return prefixed(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").isNotNull().alias("has_conv"), F.coalesce("conv_id", F.lit(0)).cast("long").alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2"),
        text.alias("text"), (tokens(text) + params.overhead).alias("tokens"),
    )


#: What a row is in its block: a repeated system turn, a turn of the block before that may be repeated, a turn of its own.
_SYSTEM, _BEFORE, _OWN = 0, 1, 2


def placed_turns(conversations: DataFrame, params: Params = Params()) -> DataFrame:
    """has_conv, conv, block, pos, start, tokens, kind, role, text: every turn in its block, and what the block may repeat."""
    turns = _turns(conversations, params)
    # equal rows travel as one with their number
    whole = turns.groupBy(*_KEY).agg(F.max("text").alias("text"))
    narrow = turns.groupBy(*_KEY).agg(F.count("*").alias("copies"), F.max("tokens").alias("tokens"))
    placed = running_totals(
        narrow, _KEY[:2], _KEY[2:], {"pos": F.col("copies"), "start": F.col("copies") * F.col("tokens")}
    )
    size, history = params.block * params.budget, params.history
    block = F.floor(F.col("start") / size)
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    each = whole.join(placed, _KEY).withColumn("copy", copy).withColumns(
        {"pos": F.col("pos") + F.col("copy"), "start": F.col("start") + F.col("copy") * F.col("tokens")}
    )
    # turns near a block's end may be history in the next one; where a long turn jumps over that, none is
    near = (F.col("start") + history >= (block + 1) * size) & (F.col("tokens") <= history)
    kinds = F.array(F.struct(block.alias("block"), F.lit(_OWN).alias("kind")))
    both = F.concat(kinds, F.array(F.struct((block + 1).alias("block"), F.lit(_BEFORE).alias("kind"))))
    columns = ["has_conv", "conv", "block", "pos", "start", "tokens", "kind", "role", "text"]
    out = each.withColumn("b", F.explode(F.when(near, both).otherwise(kinds))).select("*", "b.block", "b.kind").select(*columns)
    # the first system turn, if it is short, goes to all blocks from its own on; a block without turns gives no window
    system = placed.groupBy(*_KEY[:2]).agg(
        F.min(F.when(F.col("role") == params.system_role, F.struct("pos", "start", "tokens", *_KEY[2:]))).alias("s"),
        F.floor(F.max(F.col("start") + (F.col("copies") - 1) * F.col("tokens")) / size).alias("end"),
    ).filter(F.col("s.tokens") * 100 <= params.budget * params.system_percent)
    system = (
        system.select(*_KEY[:2], "s.pos", "s.start", "s.tokens", *[f"s.{k}" for k in _KEY[2:]], "end")
        .join(whole.filter(F.col("role") == params.system_role), _KEY)
        .withColumn("block", F.explode(F.sequence(block, "end"))).withColumn("kind", F.lit(_SYSTEM)).select(*columns)
    )
    return out.unionByName(system)


def _own_spans(room: Column) -> Column:
    """Cuts of a block's turns ``t``: array<struct<a, b>>, the places of each window's new turns [a, b)."""
    first = F.size(F.filter("t", lambda x: x["kind"] != _OWN))
    state = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).cast("long").alias("used"))

    def step(s: Column, i: Column) -> Column:
        more = F.col("t")[i]["tokens"]
        full = (F.size(s["cuts"]) == 0) | (s["used"] + more > room)
        return F.struct(
            F.when(full, F.concat(s["cuts"], F.array(i))).otherwise(s["cuts"]).alias("cuts"),
            F.when(full, more).otherwise(s["used"] + more).alias("used"),
        )

    cuts = F.aggregate(F.sequence(first, F.size("t") - 1), state, step, lambda s: s["cuts"])
    return F.transform(F.array(cuts), lambda c: F.transform(c, lambda a, k: F.struct(
        a.alias("a"), F.coalesce(F.get(c, k + 1), F.size("t")).alias("b")
    )))[0]


def format_chats(conversations: DataFrame, params: Params = Params()) -> DataFrame:
    """One row for each window: conv_id, first_turn (place of its first new turn, from 0), n_new and n_repeated turns,
    tokens, text, and loss: array<struct<start, end>> in code points of the text, the end not included."""
    room = params.budget - params.history
    body = escape(F.col("text"))
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    written = placed_turns(conversations, params).select(
        "has_conv", "conv", "block",
        F.struct(
            "pos", "kind", "start", "tokens", (F.col("role") == params.system_role).alias("system"),
            (F.col("role") == params.target_role).alias("target"), F.length(head).alias("head"), F.length(body).alias("body"),
            F.concat(head, body, F.lit(CLOSE + "\n")).alias("text"),
        ).alias("t"),
    )
    blocks = written.groupBy("has_conv", "conv", "block").agg(
        F.array_sort(F.collect_list(F.when(F.col("t.kind") != _SYSTEM, F.col("t")))).alias("t"),
        F.min(F.when(F.col("t.kind") == _SYSTEM, F.col("t"))).alias("system"),
    )
    blocks = blocks.filter(F.get("t", F.size("t") - 1)["kind"] == _OWN)
    left = F.lit(room) - F.coalesce(F.col("system.tokens"), F.lit(0))

    def window(w: Column) -> Column:
        begin = F.col("t")[w["a"]]["start"]
        return F.struct(
            F.slice("t", w["a"] + 1, w["b"] - w["a"]).alias("new"),
            F.filter(F.slice("t", F.lit(1), w["a"]), lambda x: x["start"] + params.history >= begin).alias("history"),
        )

    windows = blocks.select(
        "has_conv", "conv", "system", F.explode(F.transform(_own_spans(left), window)).alias("w")
    ).select("has_conv", "conv", "system", "w.new", "w.history")
    leads = F.coalesce(F.get("history", F.lit(0))["pos"], F.col("new")[0]["pos"])
    kept = F.when(F.col("system.pos") < leads, F.array("system")).otherwise(F.slice("new", 1, 0))
    windows = windows.withColumn("repeated", F.concat(kept, "history"))
    start = F.aggregate("repeated", F.lit(0), lambda s, x: s + F.length(x["text"]))
    state = F.struct(start.alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    spans = F.aggregate(
        "new", state,
        lambda s, x: F.struct(
            (s["at"] + F.length(x["text"])).alias("at"),
            F.when(
                x["target"], F.concat(s["spans"], F.array(F.struct((s["at"] + x["head"]).alias("start"), (s["at"] + x["head"] + x["body"]).alias("end"))))
            ).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    every = F.concat("repeated", "new")
    return windows.select(
        F.when(F.col("has_conv"), F.col("conv")).alias("conv_id"), F.col("new")[0]["pos"].alias("first_turn"),
        F.size("new").alias("n_new"), F.size("repeated").alias("n_repeated"),
        F.aggregate(every, F.lit(0).cast("long"), lambda s, x: s + x["tokens"]).alias("tokens"),
        F.array_join(F.transform(every, lambda x: x["text"]), "").alias("text"), spans.alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, first_turn, turns: array<struct<role, text>> of the new turns of each window, and loss_text, the text under
    its mask, both as they were before formatting; formatted_chars."""
    pieces = F.slice(F.split("text", CLOSE + "\n", -1), F.col("n_repeated") + 1, F.col("n_new"))
    inner = F.transform(pieces, lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    turns = F.transform(
        inner,
        lambda p: F.struct(
            unescape(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text"),
        ),
    )
    masked = F.transform("loss", lambda s: unescape(F.substring("text", s["start"] + 1, s["end"] - s["start"])))
    return windows.select("conv_id", "first_turn", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"), F.length("text").alias("formatted_chars"))


def digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: one row for each conversation.

    The contract's digests are taken of a whole conversation's text, which is why it becomes one value here (and only here)."""
    read = read_back(windows).select(
        "conv_id", "first_turn", F.size("turns").alias("n"), "loss_text", "formatted_chars",
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turn_text"),
    )
    parts = F.array_sort(F.collect_list(F.struct("first_turn", "turn_text", "loss_text"))).alias("p")
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), parts, F.sum(F.length("loss_text")).alias("loss_chars"), F.sum("formatted_chars").alias("formatted_chars")
    )
    joined = {k: F.sha2(F.array_join(F.col("p")[k], ""), 256) for k in ("turn_text", "loss_text")}
    return whole.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), joined["turn_text"].alias("turns_sha256"),
        F.col("loss_chars").cast("long").alias("loss_chars"), joined["loss_text"].alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
