"""The pipeline's stages in a row against brute force, on documents with planted cases."""

from __future__ import annotations

import random
import re

import corpus_pipeline

from .conftest import words
from .test_langid import text as prose

ITEM = "a benchmark question that is long enough to be looked for, with words of its own such as quixotic and zephyr"


def planted():
    rnd = random.Random(9)
    rows = [(i, prose(rnd, rnd.choice(["xx", "yy", "zz"]), 80), None) for i in range(300)]
    rows = [(i, t, "xx" if "ka" in t or "mi" in t else "yy" if "sch" in t else "zz") for i, t, _ in rows]
    base = rows[7][1]
    rows += [(400, base, "xx"), (401, base + " tail", "xx"), (402, base, "xx")]  # copies of 7
    rows += [(410, words(rnd, 5) + " " + ITEM + " " + rows[9][1], "xx"), (411, rows[11][1] + " " + ITEM.replace("question", "questoin"), "xx")]
    rows += [(420, rows[13][1][:200] + ' token = "0123456789abcdef0123456789abcdef" ' + rows[15][1], "xx")]
    rows += [(430, None, "xx"), (431, "", "xx"), (432, "12345 67890", "xx")]
    return rows


def test_stages(spark, make_docs, tmp_path):
    rows = planted()
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = make_docs(rows)
    columns = docs.columns
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"stage-{n}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if n + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
            last = {r.doc_id: r.text for r in docs.collect()}
    ids = {r[0] for r in rows}
    assert kept["language_id"] == ids - {430, 431, 432}
    assert kept["ngram_join"] == kept["language_id"] - {400, 401, 402}
    assert kept["decontamination"] == kept["ngram_join"] - {410, 411}
    assert kept["secret_scan"] == kept["decontamination"] == kept["packing"]
    by = {r[0]: r[1] for r in rows}
    for i, t in last.items():
        assert t == (by[i] if i != 420 else re.sub(r'token = "[0-9a-f]+', "token=[SECRET]", by[i]))


def test_run_on_the_table(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "decontamination", "secret_scan", "packing"]


def test_near_copies_from_four_fifths_of_the_five_word_shingles_go(spark, make_docs):
    def five(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    def likeness(a, b):
        return len(five(a) & five(b)) / len(five(a) | five(b))

    rnd = random.Random(12)
    base = words(rnd, 194).split()
    edited = list(base)
    for i in (30, 80, 130, 180):  # single words, apart: 20 of 190 shingles change, and 16 of 191 of four words (84.5 %)
        edited[i] = "zzz" + edited[i]
    longer = words(rnd, 200)
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, longer), (4, longer + " " + words(rnd, 45)), (5, words(rnd, 200)), (6, words(rnd, 200))]
    rows.append((7, rows[4][1] + " " + words(rnd, 52)))  # just too far
    assert 0.80 <= likeness(rows[0][1], rows[1][1]) < 0.82 and 0.80 <= likeness(rows[2][1], rows[3][1]) < 0.82
    assert likeness(rows[4][1], rows[6][1]) < 0.8
    out = corpus_pipeline.one_of_each_group(spark, make_docs(rows), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 5, 6, 7]


def test_decontamination_drops_items_wherever_their_words_begin(spark, make_docs, tmp_path):
    rnd = random.Random(31)
    han = [chr(0x4E00 + i) for i in range(3000)]
    plain = ["".join(rnd.choice(han) for _ in range(90)) for _ in range(3)]
    alike = [" ".join(pair + words(rnd, 1) for _ in range(60)) for pair in ("ae", "ce", "me", "st", "wo", "zu")]
    items = [*plain, *alike]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(i, "".join(rnd.choice(han) for _ in range(60)) + t + "".join(rnd.choice(han) for _ in range(40))) for i, t in enumerate(plain)]
    docs += [(10 + i, prose(rnd, "xx", 30) + " " + t + " " + prose(rnd, "xx", 30)) for i, t in enumerate(alike)]
    docs += [(30, prose(rnd, "xx", 90)), (31, "".join(rnd.choice(han) for _ in range(300)))]
    kept = corpus_pipeline.drop_benchmark_passages(spark, make_docs(docs), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [30, 31]
