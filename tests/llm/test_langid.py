from __future__ import annotations

import random
import zlib

import numpy as np

from costwise.llm import langid

SYLLABLES = {"xx": "ka lo mi tu ne".split(), "yy": "sch ung ver ein ach".split(), "zz": "eau oux ê ç ion".split()}


def text(rnd, lang, n=40):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def corpus(n=400):
    rnd = random.Random(1)
    return [(i, text(rnd, lang := rnd.choice(list(SYLLABLES))), lang) for i in range(n)]


def test_held_out_accuracy_and_calibration(make_docs):
    rows = corpus()
    truth = {i: lang for i, _, lang in rows}
    out = langid.identify(make_docs(rows, extra=True)).collect()
    assert len(out) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    right = np.mean([r.lang_pred == truth[r.doc_id] for r in held])
    assert right >= 0.98 and all(0 <= r.score <= 1 for r in out)
    assert abs(np.mean([r.score for r in held]) - right) < 0.1


def test_held_out_labels_teach_nothing(make_docs):
    rows = corpus(200)
    other = [(i, t, "only-held-out" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    a = sorted(tuple(r) for r in langid.identify(make_docs(rows)).collect())
    b = sorted(tuple(r) for r in langid.identify(make_docs(other)).collect())
    assert a == b


def test_edges(make_docs):
    rnd = random.Random(3)
    long = " ".join(text(rnd, "yy", 500) for _ in range(60))
    rows = corpus(200) + [(900, None, "xx"), (901, "", "xx"), (902, "123 ?! _ 456", "xx"), (903, long, None), (904, "ka", None), (None, text(rnd, "zz"), "zz"),
                          (905, text(rnd, "xx"), None), (905, text(rnd, "xx"), None)]
    out = langid.identify(make_docs(rows)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i in (900, 901, 902):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[903].lang_pred == "yy" and by[None].lang_pred == "zz" and by[None].held_out is False
    assert [r.lang_pred for r in out if r.doc_id == 905] == ["xx", "xx"]
    assert langid.identify(make_docs([])).count() == 0
    nothing = langid.identify(make_docs([(1, "some text", None)])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]
    df = make_docs(rows, extra=True)
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} >= {i for i, _, _ in rows[:200]} and kept.filter("doc_id in (900, 901, 902)").count() == 0


def test_gram_counts_do_not_depend_on_windows(monkeypatch):
    p = langid.Params()
    t = "Añb  ç🤗 déf\n" * 50
    whole = langid.gram_counts(t, p)
    monkeypatch.setattr(langid, "_WINDOW", 16)
    assert (langid.gram_counts(t, p) == whole).all()
    n = len(" " + " ".join(t.lower().split()) + " ")
    assert whole.sum() == 3 * n - 3


def test_penalties_make_the_weights_sparse():
    rng = np.random.default_rng(2)
    size, rows, targets = 200, [], []
    for i in range(600):
        y = i % 2
        at = np.sort(rng.choice(np.arange(2, size), 6, replace=False))
        rows.append((np.append(y, at), np.full(7, 7**-0.5)))
        targets.append(y)
    w, _ = langid.ftrl(rows, targets, size, 2, langid.Params(l1=0.8))
    assert w[0, 0] > 0.1 > w[0, 1] and w[1, 1] > 0.1 > w[1, 0]
    assert (w[2:] == 0).mean() > 0.5


def test_temperature_undoes_a_scale():
    rng = np.random.default_rng(5)
    logits = rng.normal(size=(4000, 3)) * 2
    q = langid._softmax(logits)
    y = (q.cumsum(axis=1) < rng.random((4000, 1))).sum(axis=1)
    assert 2.6 < langid.temperature(logits * 3, y) < 3.5


def test_junk_and_languages_not_learned_go(spark, make_docs):
    rnd = random.Random(31)
    rows = [(i, text(rnd, ["xx", "yy", "zz"][i % 3], rnd.choice([6, 30, 80])), ["xx", "yy", "zz"][i % 3]) for i in range(240)]
    junk = [
        (900, "\u0421\u044a\u0435\u0448\u044c \u0435\u0449\u0451 \u044d\u0442\u0438\u0445 \u043c\u044f\u0433\u043a\u0438\u0445 \u0431\u0443\u043b\u043e\u043a", None),
        (901, "\u543e\u8f29\u306f\u732b\u3067\u3042\u308b\u3002\u540d\u524d\u306f\u307e\u3060\u7121\u3044\u3002", None),
        (902, "xqzv0 jq9qj wqxzq9 v7vqx " * 5, None),
    ]
    kept = {r.doc_id for r in langid.keep_identified(make_docs(rows + junk)).collect()}
    assert kept == {i for i, _, _ in rows}


def test_calibration_ends_inside_its_range_on_a_separable_sample():
    logits, y = np.eye(3)[[0, 1, 2, 0]] * 4.0, np.array([0, 1, 2, 0])
    assert 0.05 < langid.temperature(logits, y) < 15
