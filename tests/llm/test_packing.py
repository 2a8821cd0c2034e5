from __future__ import annotations

import random
import zlib
from itertools import combinations_with_replacement

import numpy as np
import pytest

from costwise.llm import packing as p

from .conftest import words

tokenizers = pytest.importorskip("tokenizers")
SPECIAL = ["", "a\x1cb c\x1d\x1e d", "x <|endoftext|>y <|startoftext|> <|endoftext|", "É é ﬁ ¼ Ⅷ İ Σς ΑΣ ΑΣ.", "a\xa0b 　c\x85d", "é ́x", "日本語 テキスト 🤗🤗", "don't we'll\n\n\t 1234"]


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(p.tokenizer_path(p.TOKENIZER))


def test_words_give_the_ids_of_whole_texts(tokenizer):
    rnd = random.Random(1)
    texts = SPECIAL + [" ".join(rnd.choice(SPECIAL) + words(rnd, 3) for _ in range(20)) for _ in range(50)]
    encoder = p.WordEncoder(p.tokenizer_path(p.TOKENIZER), 50)
    for _ in range(2):
        for t, own in zip(texts, encoder.ids(texts), strict=True):
            assert np.frombuffer(own, encoder.kind).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_signs_behind_letters_make_no_new_words(tokenizer):
    encoder = p.WordEncoder(p.tokenizer_path(p.TOKENIZER), 1000)
    texts = ["wort### wort&&& wort_- wort. wort", "été$$$ it's### l'l' ß&", "a1### <x> x<|y x|>"]
    for t, own in zip(texts, encoder.ids(texts), strict=True):
        assert np.frombuffer(own, encoder.kind).tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert {w for w in encoder.known if w.startswith("wort")} == {"wort"}


def test_words_in_use_stay_known_when_the_memory_is_full(tokenizer, monkeypatch):
    encoder = p.WordEncoder(p.tokenizer_path(p.TOKENIZER), 3)
    encoder.ids(["one two three four five"])
    learned = []
    monkeypatch.setattr(encoder, "_learn", lambda words, own=encoder._learn: (learned.extend(words), own(words)))
    own = encoder.ids(["two six four"])[0]
    assert learned == ["six"] and set(encoder.known) == {"two", "four", "six"}
    assert np.frombuffer(own, encoder.kind).tolist() == tokenizer.encode("two six four", add_special_tokens=False).ids


def test_plain_texts_are_split_and_put_together_as_arrays(tokenizer, monkeypatch):
    encoder = p.WordEncoder(p.tokenizer_path(p.TOKENIZER), 1000)
    plain = ["Wort, WORT.wort... (wort) ,wort a.\t.b\r\n\x0bc!", "", "  ", "É ÉÉ?! ß. Ŀŀ' ɏ; x'. 1. 1,", "a_b_ __ ``q``"]
    alone = []
    monkeypatch.setattr(encoder, "_one_by_one", lambda texts, own=encoder._one_by_one: (alone.extend(texts), own(texts))[1])
    for texts in (plain + SPECIAL[1:], plain[::-1], [], [""]):
        for t, own in zip(texts, encoder.ids(texts), strict=True):
            assert np.frombuffer(own, encoder.kind).tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert alone and not set(alone) & set(plain)


def test_lower_case_of_arrays_is_that_of_texts():
    letters = [chr(c) for c in range(0x250) if c != 0x130]
    assert p.pc.utf8_lower(p.pa.array(letters)).to_pylist() == [c.lower() for c in letters]


def check(rows, docs, tokenizer, size):
    """Every id in one piece, sequences gapless and no longer than ``size``."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for key, own in pieces.items():
        ids = np.array(tokenizer.encode(docs[key] or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size and all(r.sequence_tokens == at for r in own)
    return len(sequences), sum(r.length for r in rows)


def test_pack(make_docs, tokenizer):
    rnd = random.Random(2)
    docs = {i: words(rnd, rnd.choice([1, 30, 200, 800])) for i in range(300)} | {1000: words(rnd, 9000), 1001: None, 1002: "", None: "no id"}
    df = make_docs(list(docs.items()), extra=True)
    rows = p.pack(df).collect()
    assert {r.doc_id for r in rows} == set(docs)
    n, tokens = check(rows, docs, tokenizer, 4096)
    assert n * 4096 < 1.04 * tokens + 2 * 4096


def test_ids_come_with_the_pieces(make_docs, tokenizer):
    from costwise.llm.storage import stored

    params = p.Params()
    pieces = stored(p.cut(make_docs([(1, "some words here"), (1, "some words here")]), params), "pieces")
    rows = p.with_ids(p.layout(pieces, params), pieces).collect()
    want = np.array(tokenizer.encode("some words here", add_special_tokens=False).ids + [2], "<u4").tobytes()
    assert [bytes(r.ids) for r in rows] == [want, want]
    assert sorted(r.offset for r in rows) == [0, len(want) // 4]


def test_one_length_fills_whole_sequences_and_no_rows(make_docs, tokenizer):
    docs = dict.fromkeys(range(64), "a b c d e f g h i j k l m n o")  # 16 ids with the end
    rows = p.pack(make_docs(list(docs.items())), p.Params(size=256)).collect()
    assert check(rows, docs, tokenizer, 256)[0] == 4
    assert p.pack(make_docs([])).count() == 0


def test_knapsack_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(30):
        capacity = 9
        values = np.round(rng.random(capacity), 3) * (rng.random(capacity) < 0.6)
        best, counts = p.knapsack(values, capacity)
        every = [c for n in range(capacity + 1) for c in combinations_with_replacement(range(1, capacity + 1), n) if sum(c) <= capacity]
        assert best == pytest.approx(max(sum(values[i - 1] for i in c) for c in every))
        assert counts @ np.arange(1, capacity + 1) <= capacity and counts @ values == pytest.approx(best)


def test_patterns_meet_demand_close_to_the_bound():
    rng = np.random.default_rng(4)
    for scale in (3, 100, 10**7):
        demand = (rng.random(64) * scale).astype(np.int64)
        found = p.patterns(demand)
        assert all(c @ np.arange(1, 65) <= 64 for c, _ in found)
        assert (sum(c * n for c, n in found) >= demand).all()
        used, least = sum(n for _, n in found), -(-int(demand @ np.arange(1, 65)) // 64)
        assert used <= 1.02 * least + 70
    assert p.patterns(np.zeros(5, np.int64)) == []


@pytest.mark.parametrize("text", ["a b c d e f g h i j k l m n o p q r", None, "one two"])
def test_short_texts_leave_little_padding(make_docs, tokenizer, text):
    docs = dict.fromkeys(range(9000), text)
    rows = p.pack(make_docs(list(docs.items())), p.Params(ids=False)).collect()
    n, tokens = check(rows, docs, tokenizer, 4096)
    assert n <= 1 + 1.05 * tokens / 4096


def test_short_and_long_pieces_share_sequences(make_docs, tokenizer):
    rnd = random.Random(8)
    docs = {i: words(rnd, rnd.choice([0, 1, 3, 5, 17, 40, 300, 1500])) for i in range(700)}
    rows = p.pack(make_docs(list(docs.items()))).collect()
    assert len({(r.doc_id, r.start) for r in rows}) == len(rows)
    room: list[int] = []  # first-fit by true lengths
    for length in sorted((r.length for r in rows), reverse=True):
        k = next((k for k, left in enumerate(room) if left >= length), None)
        if k is None:
            room.append(4096 - length)
        else:
            room[k] -= length
    assert check(rows, docs, tokenizer, 4096)[0] <= len(room) + 2


def test_case_and_last_punctuation_do_not_change_the_ids(tokenizer):
    rnd = random.Random(6)
    pieces = ["The", "END.", "Été,", "it's!", "x.y", "(a.)", "1.5.", "ÀB!?", "İx.", "ǅ.", "Σ.", "ß.", "a..b", "No.", "'S.", "don'T,", "\xd7.", "ÿ;", "ŉ.", "a\u0301.", "w.\u00a0z", "end.\r"]
    texts = [" ".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12))) for _ in range(800)] + [a + b for a in pieces for b in pieces]
    encoder = p.WordEncoder(p.tokenizer_path(p.TOKENIZER), 1000)
    assert encoder.folds
    for t, own in zip(texts, encoder.ids(texts), strict=True):
        assert np.frombuffer(own, encoder.kind).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
