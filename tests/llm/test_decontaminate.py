from __future__ import annotations

import random

import pytest

from costwise.llm import decontaminate as d

from .conftest import words


def levenshtein_search(pattern, text):
    """Least distance of the pattern to any part of the text, and the leftmost end of such a part."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    best = min(row)
    return best, row.index(best)


def edited(rnd, text, n):
    t = list(text)
    for _ in range(n):
        i, kind = rnd.randrange(len(t)), rnd.randrange(3)
        t[i] = "" if kind == 0 else t[i] + rnd.choice("xyz") if kind == 1 else rnd.choice("xyz")
    return "".join(t)


def test_edit_search_is_exact():
    rnd = random.Random(4)
    for _ in range(300):
        pattern = "".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 90)))
        text = "".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 120)))
        assert d.edit_search(pattern, text) == levenshtein_search(pattern, text)


def test_filter_by_hashes_leaves_out_no_place_that_the_exact_one_keeps():
    rnd = random.Random(11)
    met, kept, left = d.np.zeros(1 << 16, bool), 0, 0
    for _ in range(600):
        pattern = words(rnd, rnd.randint(8, 30))
        text = words(rnd, rnd.randint(0, 20)) + " " + edited(rnd, pattern, int(rnd.random() * 0.3 * len(pattern))) + " " + words(rnd, 10)
        codes, most = d.collapsed(text)[0], int(0.2 * len(pattern))
        low = rnd.randint(-20, len(text))
        places = [low, low + rnd.randint(0, 5)]
        runs, slots = (d._run_slots(d.collapsed(x)[0]) for x in (pattern, text))
        may = d._may_run(runs, slots, met, places, most)
        exact = d._enough_runs(d._plain(d.collapsed(pattern)[0]), d._plain(codes), *places, most)
        assert may or not exact
        assert not met.any()
        kept, left = kept + exact, left + (not may)
    assert kept > 20 and left > 20


@pytest.fixture(scope="module")
def benchmark_items():
    rnd = random.Random(7)
    return [(i, words(rnd, rnd.randint(15, 80))) for i in range(40)]


@pytest.mark.parametrize("share", [0.0, 0.05, 0.1, 0.15, 0.2])
def test_recall_of_planted_passages(benchmark_items, share):
    rnd = random.Random(int(share * 100))
    index = d.Index(benchmark_items, d.Params())
    texts, items = [], []
    for _ in range(100):
        item, text = rnd.choice(benchmark_items)
        items.append(item)
        texts.append(words(rnd, 120) + " " + edited(rnd, text, int(share * len(text))) + " " + words(rnd, 120))
    found = d.find(texts, index)
    recall = sum(any(index.ids[r[0]] == i for r in rows) for rows, i in zip(found, items, strict=True)) / len(items)
    assert recall >= 0.9
    for t, rows in zip(texts, found, strict=True):
        for k, a, b, distance in rows:
            pattern = index.text[k]
            assert distance <= 0.2 * len(pattern)
            assert levenshtein_search(pattern, " ".join(t[a:b].split()))[0] == distance  # runs of blanks count as one


def test_clean_documents_stay(benchmark_items):
    rnd = random.Random(1)
    index = d.Index(benchmark_items, d.Params())
    # half an item is far from the whole
    texts = [words(rnd, 300) for _ in range(200)] + [words(rnd, 50) + " " + t[: len(t) // 2] for _, t in benchmark_items]
    assert all(not rows for rows in d.find(texts, index))


def test_matches_and_clean(spark, make_docs, benchmark_items):
    rnd = random.Random(2)
    item = benchmark_items[3][1]
    docs = [
        (1, "Some Words " + item.upper().replace(" ", "\n") + " more"), (2, words(rnd, 200)), (3, None), (4, ""), (None, item), (5, item), (5, item),
        (6, words(rnd, 40_000) + " " + item + " " + words(rnd, 10)), (7, 'the "tiny one", then (Tiny\tone).'), (8, "attiny oned"),
        (9, "日本語 テキスト " * 30),
    ]
    bench = spark.createDataFrame([*benchmark_items, (100, None), (101, ""), (102, "tiny one"), (103, benchmark_items[3][1])], "item_id long, text string")
    df = make_docs(docs, extra=True)
    found = d.matches(df, bench).collect()
    hits = {(r.doc_id, r.item_id) for r in found}
    assert hits == {(x, y) for x in (1, None, 5, 6) for y in (3, 103)} | {(7, 102)}
    assert sum(r.doc_id == 5 for r in found) == 4  # each row by itself
    assert sorted((r.start, r.end) for r in found if r.doc_id == 7) == [(5, 13), (22, 30)]  # a short item wherever it stands
    span = next(r for r in found if r.doc_id == 6 and r.item_id == 3)
    assert docs[7][1][span.start : span.end] == item and span.distance == 0
    kept = d.clean(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 8, 9]
    small = d.Params(block=7)  # several passes over the documents
    assert {(r.doc_id, r.item_id) for r in d.matches(df, bench, small).collect()} == hits
    assert d.matches(make_docs([]), bench).count() == 0
    assert d.matches(df, bench.limit(0)).count() == 0


def test_small_table_against_all_pairs(spark, make_docs):
    """Every pair of document and item by brute force: nothing wrong is reported, and of what is near nine tenths are found."""
    rnd = random.Random(21)
    items = [(f"item-{i}", words(rnd, rnd.randint(8, 40))) for i in range(12)]
    docs = []
    for i in range(60):
        _, text = rnd.choice(items)
        near = edited(rnd, text, int(rnd.choice([0.0, 0.05, 0.1, 0.18, 0.25, 0.4]) * len(text)))
        docs.append((i, " ".join(near.split()) if i % 3 else words(rnd, 20) + " " + " ".join(near.split()) + " " + words(rnd, 15)))
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = {(r.doc_id, r.item_id): r.distance for r in d.matches(make_docs(docs), bench).collect()}
    want = {}
    for i, text in docs:
        for k, item in items:
            distance, _ = levenshtein_search(item, text)
            if distance <= int(0.2 * len(item)):
                want[i, k] = distance
    assert set(found) <= set(want) and len(found) >= 0.9 * len(want) and len(want) > 30
    assert all(found[k] == want[k] for k in found)


def test_distance_is_taken_on_code_points():
    rnd = random.Random(3)
    han = [chr(0x4E00 + i) for i in range(3000)]
    item = " ".join("".join(rnd.choice(han) for _ in range(3)) for _ in range(20))
    index = d.Index([(1, item)], d.Params())
    assert [r[0] for r in d.find(["前 " + item + " 後"], index)[0]] == [0]
    # characters of the same class in the walks, other code points: far away, whatever the walks say
    classes: dict[int, list[str]] = {}
    for ch in han:
        classes.setdefault(int(d._bytes(d.collapsed(ch)[0])[0]), []).append(ch)
    other = {ch: next((x for x in own if x != ch), ch) for own in classes.values() for ch in own}
    assert d.find(["".join(other.get(ch, ch) for ch in item)], index) == [[]]


@pytest.mark.parametrize("kind", ["int", "string", "long", "decimal(20,0)", "binary"])
def test_ids_of_any_type(spark, kind, benchmark_items):
    docs = spark.createDataFrame([(7, benchmark_items[2][1]), (None, benchmark_items[2][1])], "i int, text string").selectExpr(f"CAST(CAST(i AS string) AS {kind}) AS doc_id", "text")
    bench = spark.createDataFrame(benchmark_items[2:3], "i int, text string").selectExpr(f"CAST(CAST(i AS string) AS {kind}) AS item_id", "text")
    found = d.matches(docs, bench)
    assert found.schema["doc_id"].dataType == docs.schema["doc_id"].dataType and found.schema["item_id"].dataType == bench.schema["item_id"].dataType
    assert sorted(r.doc_id is None for r in found.collect()) == [False, True]


def test_runs_of_white_space_are_one_blank(benchmark_items):
    index = d.Index(benchmark_items, d.Params())
    for k, (_, text) in enumerate(benchmark_items):
        wide = text.replace(" ", "  ")
        assert d.find(["before \n " + wide + "\t\tafter"], index) == [[(k, 9, 9 + len(wide), 0)]]


def alike_words(rnd, pair, n):
    """Words that all begin with the same two letters."""
    return " ".join(pair + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 7))) for _ in range(n))


@pytest.mark.parametrize("n", [20, 40, 150, 600])
def test_every_word_start_is_looked_at(n):
    rnd = random.Random(n)
    items = [(pair, alike_words(rnd, pair, n)) for pair in ("ae", "ce", "me", "st", "wo", "zu")]
    index = d.Index(items, d.Params())
    for k, (_, text) in enumerate(items):
        assert (k, 10, 10 + len(text), 0) in d.find(["some text " + text + " and more"], index)[0]


@pytest.mark.parametrize("n", [40, 80, 150, 900])
def test_passages_in_text_without_blanks(n):
    rnd = random.Random(n)
    han = [chr(0x4E00 + i) for i in range(3000)]

    def run(size):
        return "".join(rnd.choice(han) for _ in range(size))

    items = [(i, run(n)) for i in range(5)]
    index = d.Index(items, d.Params())
    for k, (_, text) in enumerate(items):
        assert d.find([run(70) + text + run(50), run(200)], index) == [[(k, 70, 70 + n, 0)], []]


def test_recall_of_long_items():
    rnd = random.Random(13)
    items = [(i, words(rnd, rnd.randint(150, 900))) for i in range(10)]
    index = d.Index(items, d.Params())
    texts = [words(rnd, 50) + " " + edited(rnd, t, int(0.17 * len(t))) + " " + words(rnd, 50) for _, t in items]
    assert sum(any(r[0] == k for r in rows) for k, rows in enumerate(d.find(texts, index))) >= 9


def test_walks_that_meet_read_what_each_reads_alone():
    rnd = random.Random(17)
    text = words(rnd, 300) + " " + "x" * 80 + " " + "".join(rnd.choice("abcd") for _ in range(300))
    codes = d._bytes(d.collapsed(text)[0])
    at = d._starts(codes)
    assert set(range(len(text) - 300, len(text))) & set(at.tolist())
    padded, walk = d.np.append(codes, d.np.zeros(200, d.np.uint8)), d.Walk(192, 5)
    places = [d._places(size, 5, d.Params()) for size in (16, 64, 128)]
    rows, hashes = walk.read(padded, at, 192, places)
    for n, a in enumerate(at.tolist()):
        i, seen = a, []
        for j in range(192):
            seen.append(padded[i])
            i += int(walk.go[j][padded[i]])
        assert rows[n].tolist() == seen
        _, own = walk.read(padded, at[n : n + 1], 192, places)
        assert all((h[:, n] == x[:, 0]).all() for h, x in zip(hashes, own, strict=True))


def test_parts_of_pairs_and_blocks_find_the_same(spark, make_docs, monkeypatch, benchmark_items):
    rnd = random.Random(19)
    # lines of one sign, and of one word, meet many windows
    same = [(90, "=" * 60 + " results of the first run " + "=" * 60), (91, "a b " * 60)]
    docs = [(i, words(rnd, 30) + " " + edited(rnd, t, len(t) // 10) + " " + "=" * 500) for i, t in [*benchmark_items[:6], *same]]
    docs.append((99, "a b " * 400))
    index = d.Index([*benchmark_items, *same], d.Params())
    found = d.find([t for _, t in docs], index)
    assert all(rows for rows in found)
    bench = spark.createDataFrame([*benchmark_items, *same], "item_id long, text string")
    rows = {tuple(r) for r in d.matches(make_docs(docs), bench).collect()}
    assert rows == {(i, index.ids[r[0]], *r[1:]) for (i, _), own in zip(docs, found, strict=True) for r in own}
    monkeypatch.setattr(d, "_PAIRS", 5000)
    monkeypatch.setattr(d, "_FOLLOWED", 500)
    monkeypatch.setattr(d, "_TOGETHER", 100)
    assert [sorted(x) for x in d.find([t for _, t in docs], d.Index([*benchmark_items, *same], d.Params()))] == [sorted(x) for x in found]
    monkeypatch.setattr(d, "_WINDOWS", 200)
    blocks = list(d._blocks(bench, d.Params()))
    assert len(blocks) > 5 and sorted(i for b in blocks for i, _ in b) == [i for i, _ in [*benchmark_items, *same]]


def test_clean_drops_passages_of_words_that_begin_alike(spark, make_docs):
    rnd = random.Random(23)
    items = [(pair, alike_words(rnd, pair, 40)) for pair in ("ae", "ce", "me", "st", "wo", "zu")]
    docs = make_docs([(i, "before it " + t + " behind it") for i, (_, t) in enumerate(items)] + [(9, words(rnd, 200))])
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert [r.doc_id for r in d.clean(docs, bench).collect()] == [9]
    assert {(r.doc_id, r.item_id) for r in d.matches(docs, bench).collect()} == {(i, pair) for i, (pair, _) in enumerate(items)}
