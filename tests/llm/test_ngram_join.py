from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from costwise.llm import ngram_join
from costwise.llm.graph import components
from costwise.llm.storage import bounded
from costwise.llm.words import text_buffers, word_hashes

from .conftest import words

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def shingle_set(text):
    w = WORD.findall((text or "").encode().lower())
    k = min(4, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(rows):
    """(doc_id, size of the set, smallest id reachable) by comparing every two rows."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def near_copies(rnd, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split(" ")
        for _ in range(edits):
            w[rnd.randrange(len(w))] = "edit%d" % rnd.randrange(10**6)
        out.append(" ".join(w))
    return out


def test_groups_chains_and_shared_passages(make_docs):
    rnd = random.Random(5)
    base, passage = words(rnd, 300), words(rnd, 60)
    texts = [base] * 20 + near_copies(rnd, base, 40, 3) + near_copies(rnd, base, 10, 9)
    chain = words(rnd, 200).split(" ")
    for step in range(12):  # each one links with the next, the first not with the last
        chain = chain[4:] + words(rnd, 4).split(" ")
        texts.append(" ".join(chain))
    texts += [words(rnd, 150) + " " + passage + " " + words(rnd, 150) for _ in range(40)]
    texts += [passage + " " + words(rnd, n) for n in range(0, 12)]
    texts += ["", None, "  \n ", "one", "One", "a b c", "A  b\tc", "a b c d", "é É", "é É x y z"]
    rnd.shuffle(texts)
    rows = list(enumerate(texts, 100))
    assert got(ngram_join.link_components(make_docs(rows))) == brute(rows)


def test_long_text_and_clashing_columns(make_docs):
    rnd = random.Random(6)
    long = words(rnd, 30_000)
    rows = [(3, long), (1, long + " tail"), (2, long[: len(long) // 2]), (9, words(rnd, 50))]
    df = make_docs(rows, extra=True)
    assert got(ngram_join.link_components(df)) == brute(rows)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 9]


def test_null_ids_repeated_rows_and_empty_table(make_docs):
    df = make_docs([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (7, "A b c d e"), (None, None)])
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_components(df).collect()), key=str)
    assert found == sorted([(None, 2, None), (4, 2, 4), (4, 2, 4), (7, 2, 4), (None, 0, None)], key=str)
    kept = [r.doc_id for r in ngram_join.one_of_each(df).collect()]
    assert sorted(kept, key=str) == sorted([None, 4, None], key=str)
    assert ngram_join.link_components(make_docs([])).count() == 0


@pytest.mark.parametrize("n", range(1, 200))
def test_links_survive_the_bounds(n):
    """A row's leading columns and the least shared number keep every pair that can link."""
    p = ngram_join.Params()
    lead = ngram_join.leading(n, p)
    assert 1 <= lead <= n
    need = -(-p.percent * n // 100)
    assert n - lead == need - max(1, -(-p.extra * n // 100))


def test_overlap_stops_early_but_never_wrong():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.append(rng.choice(a, max(1, int(len(a) * rng.random()))), rng.integers(0, 400, 20).astype(np.uint64)))
        o = len(np.intersect1d(a, b))
        assert ngram_join.linked(a, b, 85) == (100 * o >= 85 * (len(a) + len(b) - o))


def test_word_hashes_across_windows(monkeypatch):
    import pyarrow as pa

    from costwise.llm import words as w

    rnd = random.Random(2)
    texts = [words(rnd, 40), None, "", "x" * 500, "A b\x0bC", "é\xa0ü ß", words(rnd, 200)]
    column = pa.array(texts)
    whole, at = word_hashes(*text_buffers(column))
    monkeypatch.setattr(w, "WINDOW", 64)
    again, at2 = word_hashes(*text_buffers(column))
    assert (whole == again).all() and (at == at2).all()
    assert [b - a for a, b in zip(at, at[1:], strict=False)] == [len(WORD.findall((t or "").encode())) for t in texts]
    one = {}
    for t, a, b in zip(texts, at, at[1:], strict=False):
        for x, h in zip(WORD.findall((t or "").encode().lower()), whole[a:b].tolist(), strict=True):
            assert one.setdefault(x, h) == h
    assert len(set(one.values())) == len(one)
    sliced, _ = word_hashes(*text_buffers(column.slice(3, 2)))
    assert sliced.tolist() == whole[at[3] : at[5]].tolist()


def test_components_of_random_graphs(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: m for x, m in label.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pair_bounds_allow_every_size_that_links(spark):
    from pyspark.sql import functions as F

    p, rnd = ngram_join.Params(), random.Random(11)
    rows = []
    while len(rows) < 4000:
        u = rnd.randint(1, 400)
        m = rnd.randint(-(-85 * u // 100), 100 * u // 85)
        rows.append((u, rnd.randint(1, m), rnd.randint(m, 3 * m), m) if rnd.random() < 0.7 else (u, m, m, m))
    df = spark.createDataFrame(rows, "u long, least long, most long, m long")
    own, other, need = ngram_join.pair_bounds(F.col("u"), F.col("least"), F.col("most"), p)
    for r in df.select("*", own.alias("own"), other.alias("other"), need.alias("need")).collect():
        overlap, extra = -(-85 * (r.u + r.m) // 185), max(1, -(-5 * min(r.u, r.m) // 100))
        assert r.own >= r.u - overlap + extra and r.other >= r.m - overlap + extra and r.need <= extra
        assert r.u - overlap + extra <= ngram_join.leading(r.u, p)  # the places are there to be counted
        if r.least == r.most:
            assert (r.own, r.other, r.need) == (r.u - overlap + extra, r.m - overlap + extra, extra)


def test_rows_that_share_an_id_are_judged_by_their_own_text(make_docs):
    rnd = random.Random(17)
    a, b, c = (words(rnd, 40) for _ in range(3))
    rows = [(3, a), (5, a + " x"), (5, b), (6, c), (6, c), (7, None), (7, ""), (None, a), (None, a)]
    kept = ngram_join.one_of_each(make_docs(rows, extra=True)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(3, a), (5, b), (6, c), (7, None), (7, ""), (None, a), (None, a)], key=str)


def test_batches_are_worked_on_in_bounded_runs_of_rows():
    texts = ["word " * 100] * 3000 + ["x" * 300_000] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    runs = list(bounded([batch.slice(0, 0), batch], 100_000))
    assert pa.Table.from_batches(runs).to_pylist() == batch.to_pylist()
    assert len(runs) > 10 and all(r.nbytes < 100_000 + 300_000 for r in runs)
