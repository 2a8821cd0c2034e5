from __future__ import annotations

import collections
import random
import re
import zlib

import pytest

from costwise.llm import spelling


def counted(rows, least_length=6, least_count=5, misspell=None):
    n = collections.Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if misspell and h % misspell == 0:
                p = h % len(w)
                w = w[:p] + w[p + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(n, ratio=5):
    near = {w: [v for v in n if v != w and one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n}


def made_up(seed, docs=60):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(5, 9))) for _ in range(60)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(120):
            w = list(rnd.choice(base[: rnd.randint(1, 60)]))
            if rnd.random() < 0.3:
                k = rnd.randrange(len(w))
                w[k : k + 1] = rnd.choice(["", rnd.choice("abcdé"), w[k] + rnd.choice("abcdé")])
            words.append("".join(w).upper() if rnd.random() < 0.05 else "".join(w))
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("widest", [256, 2])
def test_against_all_pairs(spark, make_docs, widest):
    rows = made_up(3)
    rows += [(None, "nulled nulled nulled"), (7, None), (8, ""), (9, "x" * 50_000 + " nulled nulled"), rows[0], rows[0]]
    want = expected(counted(rows, misspell=19))
    params = spelling.Params(misspell=19, widest=widest)
    got = {r.word: tuple(r)[1:] for r in spelling.variants(make_docs(rows, extra=True), params).collect()}
    assert got == want
    assert any(v[2] for v in want.values())


def test_links_are_followed_to_the_end(spark, make_docs):
    chain = [("abcdefg", 5), ("abcdefgh", 25), ("abcdefghi", 125), ("abcdefghij", 625), ("abcdefghijk", 3125)]
    text = " ".join(" ".join([w] * k) for w, k in chain)
    got = {r.word: r.root for r in spelling.variants(make_docs([(1, text)])).collect()}
    assert got == {w: "abcdefghijk" for w, _ in chain}


def test_ties_and_limits(spark, make_docs):
    # of two forms with equal counts the first by code point; four occurrences or five letters are no word
    text = "abcdez " * 25 + "abcdey " * 25 + "abcdex " * 5 + "abcdew " * 4 + "abcde " * 9 + "ABCDEÉ " * 5 + "abcdeé " * 2
    got = {r.word: (r.n, r.n_near, r.form) for r in spelling.variants(make_docs([(1, text)])).collect()}
    assert got == {"abcdez": (25, 3, None), "abcdey": (25, 3, None), "abcdex": (5, 3, "abcdey"), "abcdeÉ": (5, 3, "abcdey")}


def test_empty(spark, make_docs):
    assert spelling.variants(make_docs([])).count() == 0
    assert spelling.variants(make_docs([(1, None)])).count() == 0


def test_signatures_meet_within_the_distance():
    rnd = random.Random(5)
    for _ in range(300):
        w = "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(6, 14)))
        k = rnd.randrange(len(w))
        v = w[:k] + rnd.choice(["", rnd.choice("abcdefgh") + w[k], rnd.choice("abcdefgh")]) + w[k + 1 :]
        rows, kinds, sigs = spelling.signature_rows([w, v], spelling.Params())
        sets = [{(int(s), int(q)) for r, q, s in zip(rows, kinds, sigs, strict=True) if r == i} for i in (0, 1)]
        a, b = (sets[0], sets[1]) if len(w) <= len(v) else (sets[1], sets[0])
        if len(w) == len(v):
            assert {s for s, q in a if q == 0} & {s for s, q in b if q == 0}
        else:
            assert {s for s, q in a if q == 1} & {s for s, q in b if q == 2}
