from __future__ import annotations

import random

import pytest

from costwise.llm import token_count as t

from .conftest import words

pytest.importorskip("sentencepiece")
SMALL = t.Params(whole=300, chunk=200, overlap=16, margin=6)


@pytest.fixture(scope="module")
def counter():
    return t.PieceCounter(SMALL)


@pytest.mark.parametrize("blank", [" ", "  ", "\n", "", " \t ", "é ", "🤗 ", "▁", " ▁ ", "<s> "])
def test_splices_give_the_count_of_the_whole(counter, blank):
    rnd = random.Random(len(blank))
    for n in (60, 90, 200, 700):
        text = blank.join(words(rnd, 1) for _ in range(n))
        for one in (text, " " + text, text + "   ", "x" * 700 + text, text + " " + "ab" * 900 + " " + text):
            assert counter.count_long(one) == len(counter.model.encode(one))


def test_widening_is_used(counter, monkeypatch):
    calls = []
    real = t.PieceCounter._splice
    monkeypatch.setattr(t.PieceCounter, "_splice", lambda self, *a: calls.append(real(self, *a)) or calls[-1])
    text = " ".join(words(random.Random(3), 400)) + "q" * 60 + " " + words(random.Random(4), 200)
    assert counter.count_long(text) == len(counter.model.encode(text))
    assert None in calls and any(c is not None for c in calls)


def test_table(make_docs, counter):
    rows = [(1, "some words"), (2, None), (3, ""), (4, " "), (None, "é"), (1, "some words"), (5, words(random.Random(5), 30_000)), (6, "x" * 70_000)]
    for p in (t.Params(), SMALL):
        found = t.count_tokens(make_docs(rows, extra=True), p).collect()
        want = [(i, len((x or "").encode()), len(counter.model.encode(x or ""))) for i, x in rows]
        assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert t.count_tokens(make_docs([])).count() == 0
