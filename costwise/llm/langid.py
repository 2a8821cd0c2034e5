"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, fitted with FTRL-proximal under an elastic net, followed by
temperature calibration on documents kept out of the fit.

Document frequencies cover every training row. The classifier itself is fitted
on a bounded sample: ``per_language`` rows of each label, the smallest by a hash
of the id; feature vectors (at most ``2 ** bits`` entries each) are what reaches
the driver, never texts. The fitted weights (``2 ** bits`` x labels) are what is
sent to the executors.

Defined cases: a null text or one without a letter gives ``und`` with score 0;
null labels are not learned; with no labelled row at all every text is ``und``;
repeated rows are predicted each; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costwise.llm.storage import bounded, map_batches, prefixed, ship

UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_WINDOW = 1 << 18


@dataclass(frozen=True)
class Params:
    bits: int = 14
    orders: tuple[int, ...] = (1, 2, 3)
    per_language: int = 1000
    epochs: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    calibration_share: float = 0.2
    #: Share of a calibration row's label that counts for all labels alike: without it the loss of a separable sample
    #: falls for ever as the temperature falls.
    smoothing: float = 0.02


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray = field(repr=False)  # features x labels
    bias: np.ndarray = field(repr=False)
    idf: np.ndarray = field(repr=False)
    temperature: float
    params: Params


def gram_counts(text: str, p: Params) -> np.ndarray:
    """Counts of the hashed character n-grams of one whole text, in windows that share n - 1 characters."""
    size = 1 << p.bits
    folded = " " + " ".join(text.lower().split()) + " "
    most = max(p.orders)
    counts = None
    for a in range(0, len(folded), _WINDOW):
        code = np.frombuffer(folded[a : a + _WINDOW + most - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        own = min(_WINDOW, len(folded) - a)
        spread = code * np.uint32(0x9E3779B1)
        h, slots = spread, []
        for n in range(1, min(most, len(code)) + 1):
            if n > 1:
                h = (h[:-1] * np.uint32(0x01000193)) ^ spread[n - 1 :]
            if n in p.orders:
                slots.append(((h[:own] + np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - p.bits))
        part = np.bincount(np.concatenate(slots), minlength=size)
        counts = part if counts is None else counts + part
    return counts


def _normalised(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    v = np.log1p(counts[at]) * idf[at]
    norm = float(np.sqrt(v @ v))
    return at, v / norm if norm else v


def document_frequencies(rows: DataFrame, p: Params) -> tuple[int, np.ndarray]:
    """Number of texts with a letter, and by feature the number of those that have it, over all rows."""
    size = 1 << p.bits

    def count(batches):
        seen, total = np.zeros(size, np.int64), 0
        for batch in bounded(batches):
            for text in batch.column(0).to_pylist():
                if text and _LETTER.search(text):
                    seen += gram_counts(text, p) > 0
                    total += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, size), pa.int32()), pa.array(np.append(seen[at], total), pa.int64())], ["feature", "df"]
        )

    parts = map_batches(rows.select("text"), count, "feature int, df long")
    summed = parts.groupBy("feature").agg(F.sum("df").alias("df")).collect()  # at most 2 ** bits + 1 rows
    df = np.zeros(size + 1, np.int64)
    for r in summed:
        df[r["feature"]] = r["df"]
    return int(df[size]), df[:size]


def _sample(rows: DataFrame, p: Params) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Sparse counts of the sampled training rows, in the order of their hashed ids."""
    # a row is drawn by the hash of its id alone, against a bound from its label's count: no label's rows meet in a task.
    # A fifth more than asked for is drawn, and the smallest hashes are kept.
    draw = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text")), F.lit(7))
    drawn = rows.withColumn("draw", draw)
    share = F.least(F.lit(1.0), 1.2 * (p.per_language + 50) / F.col("n"))
    bound = rows.groupBy("label").agg(F.count("*").alias("n")).select("label", ((share - 0.5) * float(2**64)).alias("bound"))
    drawn = drawn.join(F.broadcast(bound), "label").filter(F.col("draw").cast("double") <= F.col("bound"))

    def vectors(batches):
        for batch in bounded(batches):
            label, draw, text = (batch.column(i).to_pylist() for i in range(3))
            at, n = [], []
            for t in text:
                counts = gram_counts(t, p)
                k = np.flatnonzero(counts)
                at.append(k.astype(np.int32).tobytes())
                n.append(counts[k].astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(label, pa.string()), pa.array(draw, pa.int64()), pa.array(at, pa.binary()), pa.array(n, pa.binary())],
                ["label", "draw", "at", "n"],
            )

    got = map_batches(drawn.select("label", "draw", "text"), vectors, "label string, draw long, at binary, n binary").collect()
    got.sort(key=lambda r: (r["draw"], r["label"]))
    taken: dict[str, int] = {}
    for r in got:
        taken[r["label"]] = taken.get(r["label"], 0) + 1
    for label, n in taken.items():  # the smallest hashes of each label
        taken[label] = sorted(r["draw"] for r in got if r["label"] == label)[min(n, p.per_language) - 1]
    got = [r for r in got if r["draw"] <= taken[r["label"]]]
    return [(r["label"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int64)) for r in got]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(vectors, targets, size: int, k: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with L1 and L2 on sparse rows; the bias (last row) is not penalised."""
    z, g2 = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def weights(rows):
        zi, gi = z[rows], g2[rows]
        w = -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(gi)) / p.alpha + p.l2)
        w[np.abs(zi) <= p.l1] = 0
        if rows[-1] == size:
            w[-1] = -zi[-1] / ((p.beta + np.sqrt(gi[-1])) / p.alpha + p.l2)
        return w

    for _ in range(p.epochs):
        for (at, v), y in zip(vectors, targets, strict=True):
            rows, x = np.append(at, size), np.append(v, 1.0)
            w = weights(rows)
            err = _softmax(x @ w)
            err[y] -= 1
            g = x[:, None] * err
            old = g2[rows]
            sigma = (np.sqrt(old + g * g) - np.sqrt(old)) / p.alpha
            z[rows] += g - sigma * w
            g2[rows] = old + g * g
    w = weights(np.arange(size + 1))
    return w[:size], w[size]


def temperature(logits: np.ndarray, targets: np.ndarray, smoothing: float = 0.02) -> float:
    """The temperature with the least negative log likelihood of smoothed labels, by golden section on its logarithm."""
    if len(targets) == 0:
        return 1.0

    def loss(log_t: float) -> float:
        x = logits / np.exp(log_t)
        x = x - x.max(axis=1, keepdims=True)
        q = x - np.log(np.exp(x).sum(axis=1, keepdims=True))
        return -float((1 - smoothing) * q[np.arange(len(targets)), targets].mean() + smoothing * q.mean())

    lo, hi, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(labelled: DataFrame, p: Params = Params()) -> Model:
    """``labelled``: columns doc_id, text, label. Rows with a null or no letter teach nothing."""
    rows = labelled.filter(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    total, df = document_frequencies(rows, p)
    idf = np.log((1 + total) / (1 + df)) + 1
    sample = _sample(rows, p)
    labels = sorted({x[0] for x in sample})
    size, k = 1 << p.bits, len(labels)
    if k == 0:
        return Model([], np.zeros((size, 0)), np.zeros(0), idf, 1.0, p)
    vectors, targets = [], []
    for label, at, n in sample:
        dense = np.zeros(size, np.int64)
        dense[at] = n
        vectors.append(_normalised(dense, idf))
        targets.append(labels.index(label))
    held = int(len(vectors) * p.calibration_share)
    w, b = ftrl(vectors[held:], targets[held:], size, k, p)
    logits = np.array([v @ w[at] + b for at, v in vectors[:held]]).reshape(held, k)
    return Model(labels, w, b, idf, temperature(logits, np.array(targets[:held], int), p.smoothing), p)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the calibrated probability) for each row, from its text alone."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in bounded(batches):
            label, score = [], []
            for text in batch.column(1).to_pylist():
                if not text or not m.labels or not _LETTER.search(text):
                    label.append(UNDETERMINED)
                    score.append(0.0)
                    continue
                at, v = _normalised(gram_counts(text, m.params), m.idf)
                q = _softmax((v @ m.weights[at] + m.bias) / m.temperature)
                best = int(q.argmax())
                label.append(m.labels[best])
                score.append(float(min(1.0, q[best])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(label, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(prefixed(docs, "doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double")


def fold(doc_id, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id is in no held-out fold."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)), F.lit(-1))


def identify(docs: DataFrame, label: str = "lang", folds: int = 4, held_fold: int = 2, p: Params = Params()) -> DataFrame:
    """Fit outside the held-out fold, then predict every row: doc_id, held_out, lang_pred, score."""
    labelled = docs.select("doc_id", "text", F.col(label).alias("label")).filter(fold(F.col("doc_id"), folds) != held_fold)
    out = predict(docs, fit(labelled, p))
    return out.withColumn("held_out", fold(F.col("doc_id"), folds) == held_fold).select("doc_id", "held_out", "lang_pred", "score")


def known_share(counts: np.ndarray, m: Model) -> float:
    """Share of a text's n-grams that at least one in a hundred of the training texts has."""
    common = np.log(100.0) + 1
    return float(counts[m.idf <= common].sum() / max(1, counts.sum()))


def keep_identified(docs: DataFrame, min_score: float = 0.27, min_known: float = 0.72, label: str = "lang") -> DataFrame:
    """The rows whose text is identified: with at least ``min_score``, and of whose n-grams at least ``min_known`` are
    usual in the training texts, so that junk and languages that were not learned go. All columns are kept.

    The prediction rides beside the row in one pass, so nothing is joined back."""
    labelled = docs.select("doc_id", "text", F.col(label).alias("label")).filter(fold(F.col("doc_id"), 4) != 2)
    model = fit(labelled)
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        m = sent.value
        for batch in bounded(batches):
            keep = []
            for text in batch.column(place).to_pylist():
                ok = bool(text and m.labels and _LETTER.search(text))
                if ok:
                    counts = gram_counts(text, m.params)
                    at, v = _normalised(counts, m.idf)
                    ok = known_share(counts, m) >= min_known and float(_softmax((v @ m.weights[at] + m.bias) / m.temperature).max()) >= min_score
                keep.append(ok)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, run, docs.schema)
