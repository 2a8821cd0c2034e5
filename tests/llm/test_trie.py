from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from costwise.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows, family=None):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    built = dict(own)
    if family:
        for c in own:
            h = zlib.crc32(str(c).encode()) % 4
            built[c] = own.get(c - int(math.fmod(c, family)), [])[:h] + own[c][h:]
    members, kids, total = collections.defaultdict(list), collections.defaultdict(list), {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved = (len(members[k]) - 1) * words + sum(total[x][1] for x in kids[k])
        total[k] = (sum(total[x][0] for x in kids[k]) if kids[k] else 1, saved)
        ends = hashlib.sha256(",".join(str(c) for c in members[k] if len(built[c]) == len(k)).encode()).hexdigest()
        out[members[k][0], len(k)] = (members[k[:-1]][0] if k else None, len(members[k]), len(kids[k]), *total[k], ends)
    return out


def got(df, params):
    rows = trie.prefix_trie(df, params).collect()
    found = {(r.conv_id, r.depth): tuple(r)[2:] for r in rows}
    assert len(found) == len(rows)
    return found


def made_up(seed, convs=70):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(-25, convs), 10**17]:
        if c % 9 == 4:
            continue
        for t in range(rnd.choice([1, 2, 3, 4, 7])):
            rows.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice(["a b", "c", " d\te  f ", ""])))
    return rows


@pytest.mark.parametrize(("family", "height", "block"), [(20, 8, 1024), (20, 2, 2), (None, 3, 4)])
def test_against_brute_force(spark, family, height, block):
    rows = made_up(height)
    # one conversation with far more turns than a band or block, ending like another one; nulls
    rows += [(40, 100 + i, "user", f"long {i % 3}") for i in range(60)] + [(200, i, "user", f"long {i % 3}") for i in range(50)]
    rows += [(41, None, None, None), (41, None, "user", None), (None, 1, "user", "x"), (201, 0, None, "")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS h1", "2 AS d", "'x' AS words", "3 AS n_convs")
    params = trie.Params(family=family, height=height, block=block)
    if family is None:
        rows = [r for r in rows if r[0] != 41]  # its two null turns may stand either way
        df = df.filter("conv_id <> 41 OR conv_id IS NULL")
    assert got(df, params) == expected(rows, family)


def test_repeated_rows_and_copies(spark):
    rows = [(c, t, "user", "same") for c in range(300) for t in (0, 1)] + [(5, 1, "user", "same")] * 40
    assert got(spark.createDataFrame(rows, SCHEMA), trie.Params(height=4)) == expected(rows)


def test_conversations_may_lose_all_turns(spark):
    # one turn each and none in the base: those with crc32 % 4 > 0 are rebuilt without a turn
    rows = [(c, 0, "user", "hi") for c in range(21, 40)]
    want = expected(rows, 20)
    assert got(spark.createDataFrame(rows, SCHEMA), trie.Params(family=20)) == want
    alone = [next(r for r in rows if zlib.crc32(str(r[0]).encode()) % 4)]
    assert got(spark.createDataFrame(alone, SCHEMA), trie.Params(family=20)) == expected(alone, 20)


def test_empty(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA), trie.Params(family=20)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
