"""Spelling variants: words one edit apart, grouped by following each word to its commonest neighbour.

Words are taken as letter multisets, that is binary vectors over (letter, how many times so far). One replaced letter
changes such a vector in two places, one inserted or deleted letter in one. PartEnum signatures: the places are dealt
into partitions and a signature is what remains of a vector when as many partitions are left out as places may differ,
with the words' length. Two words within that distance agree in at least one signature, so an equi-join on signatures
finds them all, and the edit distance of every candidate is verified.

A signature that many words share would be joined in pairs: beyond ``widest`` words it is joined by the word with one
letter left out as well, which no more words share than there are letters to put back. The same pairs come out.

Defined cases: a null text has no words; a null id counts as an empty string before the colon; rows that repeat an id
count each; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costwise.llm.ordered import HEAVY
from costwise.llm.storage import map_batches, prefixed, stored
from costwise.llm.words import mix


@dataclass(frozen=True)
class Params:
    #: Letters (a run of them is a word) and which of them are lowered.
    letters: str = r"A-Za-zÀ-ÿ"
    #: Words with fewer code points or fewer occurrences are left out.
    least_length: int = 6
    least_count: int = 5
    #: A form occurs at least this many times as often as the word.
    ratio: int = 5
    #: Runs whose checksum this number divides lose a letter (the contract's misspellings); None: none.
    misspell: int | None = None
    #: Partitions for two differing places (same length) and for one (lengths differ by one).
    parts_two: int = 7
    parts_one: int = 4
    #: Words of one signature that are joined directly.
    widest: int = 256


def count_words(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """word, n: all words of the texts and their occurrences."""
    runs = prefixed(docs, "doc_id", "text").select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{params.letters}]+"), F.lit(0))).alias("word")
    )
    runs = runs.withColumn("word", F.translate("word", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    if params.misspell:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
        at = (h % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.select(F.when(h % params.misspell == 0, cut).otherwise(F.col("word")).alias("word"))
    return runs.filter(F.length("word") >= params.least_length).groupBy("word").agg(F.count("*").alias("n"))


#: Kinds of signature rows: of equal lengths; the shorter and the longer of lengths that differ by one.
_EVEN, _SHORT, _LONG = 0, 1, 2


def _hashed(codes: np.ndarray, nth: np.ndarray, seed: int) -> np.ndarray:
    return mix((codes.astype(np.uint64) << np.uint64(32)) ^ nth.astype(np.uint64) ^ mix(np.array([seed], np.uint64)))


def signature_rows(words: list[str], params: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each signature: the index of its word, its kind and its value."""
    size = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    owner = np.repeat(np.arange(len(words)), size)
    order = np.lexsort((codes, owner))
    codes = codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    places = np.arange(len(codes))
    nth = places - np.maximum.accumulate(np.where(new, places, 0))
    value = _hashed(codes, nth, 1)
    rows, kinds, sigs = [], [], []

    def emit(left_out: tuple[int, ...], sums: np.ndarray, kind: int, length: np.ndarray) -> None:
        rest = sums.sum(axis=1, dtype=np.uint64)
        tag = np.uint64(len(left_out))
        for p in left_out:
            rest = rest - sums[:, p]
            tag = tag * np.uint64(64) + np.uint64(p)
        rows.append(np.arange(len(words), dtype=np.int32))
        kinds.append(np.full(len(words), kind, np.int8))
        sigs.append(mix(rest ^ mix((length.astype(np.uint64) << np.uint64(32)) + tag)).view(np.int64))

    for parts, differ, seed in ((params.parts_two, 2, 2), (params.parts_one, 1, 3)):
        sums = np.zeros((len(words), parts), np.uint64)
        np.add.at(sums, (owner, (_hashed(codes, nth, seed) % np.uint64(parts)).astype(np.int64)), value)
        for left_out in combinations(range(parts), differ):
            if differ == 2:
                emit(left_out, sums, _EVEN, size)
            else:
                emit(left_out, sums, _SHORT, size + 1)
                emit(left_out, sums, _LONG, size)
    return np.concatenate(rows), np.concatenate(kinds), np.concatenate(sigs)


def signatures(vocabulary: DataFrame, params: Params = Params()) -> DataFrame:
    """sig, kind, word, n: every signature of every word."""
    schema = "sig long, kind byte, word string, n long"

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, kinds, sigs = signature_rows(batch["word"].to_pylist(), params)
            index = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sigs), pa.array(kinds), batch["word"].take(index), batch["n"].take(index)],
                names=["sig", "kind", "word", "n"],
            )

    return map_batches(vocabulary.select("word", "n"), run, schema)


def near_words(vocabulary: DataFrame, params: Params = Params()) -> DataFrame:
    """word, n, near, near_n: every pair of words one edit apart, in both directions."""
    signed = stored(signatures(vocabulary, params), "signatures")
    wide = stored(signed.groupBy("sig").agg(F.count("*").alias("size")).filter(F.col("size") > params.widest), "wide-signatures")

    left = [F.col(c).alias(f"l_{c}") for c in ("kind", "word", "n")]
    right = [F.col(c).alias(f"r_{c}") for c in ("kind", "word", "n")]
    ordered = ((F.col("l_kind") == _EVEN) & (F.col("r_kind") == _EVEN) & (F.col("l_word") < F.col("r_word"))) | (
        (F.col("l_kind") == _SHORT) & (F.col("r_kind") == _LONG)
    )
    one_edit = F.levenshtein("l_word", "r_word", 1) == 1

    def joined(rows: DataFrame, *on: str) -> DataFrame:
        a = rows.filter(F.col("kind") != _LONG).select(*on, *left)
        b = rows.filter(F.col("kind") != _SHORT).select(*[F.col(c).alias(f"at_{c}") for c in on], *right)
        same = [F.col(c) == F.col(f"at_{c}") for c in on]
        return a.join(b, [*same, ordered & one_edit]).select("l_word", "l_n", "r_word", "r_n")

    # a signature of a 10,000th of all rows is on a list that is broadcast, so no task gets its words
    total = signed.count()
    listed = wide.filter(F.col("size") > max(params.widest, total // HEAVY)).select("sig")
    others = wide.filter(F.col("size") <= max(params.widest, total // HEAVY)).select("sig")
    away = signed.join(F.broadcast(listed), "sig", "left_anti")
    crowded = signed.join(F.broadcast(listed), "sig", "left_semi").unionByName(away.join(others, "sig", "left_semi"))
    # the words of a crowded signature: left out letter by letter; equal lengths lose the letter at the same place
    place = F.explode(F.when(F.col("kind") == _SHORT, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.length("word"))))
    split = crowded.withColumn("at", place).withColumn(
        "rest", F.when(F.col("kind") == _SHORT, F.col("word")).otherwise(
            F.concat(F.substring("word", F.lit(1), F.col("at") - 1), F.substring("word", F.col("at") + 1, F.length("word")))
        ),
    )
    split = split.withColumn("at", F.when(F.col("kind") == _EVEN, F.col("at")).otherwise(0))
    pairs = joined(away.join(others, "sig", "left_anti"), "sig").unionByName(joined(split, "sig", "at", "rest")).distinct()
    return pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("l_word").alias("word"), F.col("l_n").alias("n"), F.col("r_word").alias("near"), F.col("r_n").alias("near_n")),
                F.struct(F.col("r_word").alias("word"), F.col("r_n").alias("n"), F.col("l_word").alias("near"), F.col("l_n").alias("near_n")),
            )
        ).alias("p")
    ).select("p.*")


def follow(links: DataFrame, steps: int) -> DataFrame:
    """word, root: where each word of ``links`` (word, form; stored, without circles) ends after up to ``steps`` links.

    Each round doubles the links that have been followed."""
    now, reach = links.select("word", F.col("form").alias("root")), 1
    while reach < steps:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = stored(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        reach *= 2
    return now


def variants(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """word, n, n_near, form, form_n, root: one row for each word of the vocabulary.

    ``form`` is the near word with the most occurrences (of equal ones the first in code-point order) where it has at
    least ``ratio`` times the word's, else null; ``root`` is where the forms lead, the word itself without one."""
    vocabulary = stored(count_words(docs, params).filter(F.col("n") >= params.least_count), "vocabulary")
    best = near_words(vocabulary, params).groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    )
    enough = -F.col("best.order") >= params.ratio * F.col("n")
    formed = stored(
        best.select(
            "word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.order")).alias("form_n")
        ),
        "forms",
    )
    most = vocabulary.agg(F.max("n")).first()[0] or 1
    steps = 1  # every link multiplies the occurrences by the ratio, which bounds their number
    while params.least_count * params.ratio**steps <= most and params.ratio > 1:
        steps += 1
    roots = follow(stored(formed.filter("form IS NOT NULL").select("word", "form"), "links"), steps)
    return (
        vocabulary.join(formed, "word", "left").join(roots, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
    )
