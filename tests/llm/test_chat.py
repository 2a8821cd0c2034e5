from __future__ import annotations

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from costwise.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = ["\\### Assistant: </turn> ok", "<turn>user\n", "</turn>\n<turn>assistant\nno", "\\l\\b\\n\\", "<", "</tur", "\\", "é𝕏\n\n", "", "\\<turn>", "<<turn>>", None]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_conversation(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}


def expected(rows):
    out = {}
    for c, turns in by_conversation(rows).items():
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
    return out


def made_up():
    rnd = random.Random(11)
    rows = [(1, i, rnd.choice(["user", "assistant", "tool\nuse", "<turn>", None]), x) for i, x in enumerate(HARD * 3)]
    rows += [(2, i, rnd.choice(["user", "assistant"]), "w " * rnd.randint(0, 30)) for i in range(400)]  # many blocks
    rows += [(3, 0, "system", "be kind"), (3, 1, "user", "x " * 5000), (3, 2, "assistant", "y " * 700)] + [(3, 3 + i, "assistant", f"z{i}") for i in range(90)]
    rows += [(4, 0, "user", "first"), (4, 1, "system", "late rule"), *[(4, 2 + i, "assistant", "t " * 9) for i in range(40)]]
    rows += [(5, 0, "system", "s " * 90), *[(5, 1 + i, "user", "t " * 9) for i in range(40)]]  # too long to repeat
    rows += [(None, None, None, "no id"), (6, None, "assistant", "null first"), (6, 0, "assistant", "then this")]
    rows += [(7, 1, "assistant", "same")] * 200  # equal rows over several blocks
    return rows


SMALL = chat.Params(budget=64, history=16, block=4)


@pytest.mark.parametrize("params", [chat.Params(), SMALL, chat.Params(budget=16, history=16, block=1)])
def test_read_back(spark, params):
    rows = made_up()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS pos", "'x' AS kind", "2 AS start", "3 AS block")
    found = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.format_chats(df, params)).collect()}
    assert found == expected(rows)


def test_windows(spark):
    """Windows against the rule, turn by turn: what fits, what is repeated, what is masked."""
    rows = [r for r in made_up() if r[0] in (2, 3, 4, 5, 7)]
    df = spark.createDataFrame(rows, SCHEMA)
    cost = {x: n for x, n in df.select(F.coalesce("text", F.lit("")), chat.tokens(F.coalesce("text", F.lit(""))) + SMALL.overhead).distinct().collect()}
    found = collections.defaultdict(list)
    for w in chat.format_chats(df, SMALL).collect():
        found[w.conv_id].append(w)
    for c, turns in by_conversation(rows).items():
        start = [0]
        for _, x in turns:
            start.append(start[-1] + cost[x])
        sys = next((i for i, (r, _) in enumerate(turns) if r == "system"), None)
        if sys is not None and cost[turns[sys][1]] * 100 > SMALL.budget * SMALL.system_percent:
            sys = None
        size = SMALL.block * SMALL.budget
        cuts, used = [], 0
        for i, (_, x) in enumerate(turns):
            held = sys is not None and start[sys] // size <= start[i] // size
            room = SMALL.budget - SMALL.history - (cost[turns[sys][1]] if held else 0)
            if not cuts or start[i] // size != start[i - 1] // size or used + cost[x] > room:
                cuts.append(i)
                used = 0
            used += cost[x]
        want = []
        for k, a in enumerate(cuts):
            b = cuts[k + 1] if k + 1 < len(cuts) else len(turns)
            back = [i for i in range(a) if start[i] + SMALL.history >= start[a]]
            if sys is not None and sys < (back[0] if back else a):
                back = [sys, *back]
            text, loss = "", []
            for i in [*back, *range(a, b)]:
                text += f"<turn>{turns[i][0]}\n"
                if i >= a and turns[i][0] == "assistant":
                    loss.append((len(text), len(text) + len(turns[i][1])))
                text += f"{turns[i][1]}</turn>\n"
            want.append((a, b - a, len(back), text, loss))
        got = sorted((w.first_turn, w.n_new, w.n_repeated, w.text, [tuple(s) for s in w.loss]) for w in found[c])
        assert got == want
        for w in found[c]:
            assert w.tokens <= SMALL.budget or w.n_new == 1
    assert any(w.n_repeated for w in found[4])


def test_escaping_is_exact(spark):
    rnd = random.Random(2)
    texts = [x for x in HARD if x is not None] + ["".join(rnd.choice("\\<>/turnlb\n") for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", chat.escape(F.col("text")).alias("e"))
    for r in df.withColumn("back", chat.unescape(F.col("e"))).collect():
        assert r.back == r.text and chat.OPEN not in r.e and chat.CLOSE not in r.e


def test_empty_and_native(spark):
    out = chat.digests(chat.format_chats(spark.createDataFrame([], SCHEMA)))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
