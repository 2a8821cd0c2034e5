"""Packing by cutting-stock column generation.

Documents become token ids and an end id; pieces are whole documents, longer ones are cut into full
sequences and a rest. Short pieces (up to ``short`` tokens) of equal length are bundled first, by the number that
rounding costs least (at most ``bundle`` tokens), so that their lengths are not rounded one by one. A histogram of the lengths of pieces and
bundles, in classes of ``unit`` tokens, is what reaches the driver (``size / unit + short`` numbers whatever
the input). There a linear program over patterns (how many
pieces of each class share a sequence) is solved by the revised simplex method; new patterns are priced
by an unbounded knapsack over the dual values. The solution is rounded down, what it leaves is placed
first-fit by decreasing class. The patterns (a bounded table) go back to Spark, where the pieces of a
class, ranked, are dealt to the patterns' places in turn.

Ranks are running counts by (class, part of the written pieces), so that a class that holds most of the
rows is ranked by many tasks.

Defined cases: a null text is empty and still has its end id; repeated rows are packed each; a null
id is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from costwise.llm.storage import map_batches, prefixed, stored

#: The tokenizer's file is found on each executor by this name unless a path is given.
TOKENIZER = "word_bpe_49k.json"


@dataclass(frozen=True)
class Params:
    tokenizer: str = TOKENIZER
    end_id: int = 2
    size: int = 4096
    unit: int = 16
    #: Pieces of up to this many tokens are bundled by their true length, into bundles of up to so many tokens.
    short: int = 128
    bundle: int = 512
    #: Whether the ids themselves are written with the pieces (``with_ids`` brings them to the rows).
    ids: bool = True
    #: Words whose ids a worker remembers (about 200 bytes each).
    remembered: int = 250_000
    #: Bytes of text that are encoded together.
    together: int = 1 << 21
    #: Pivots of the simplex method; the basis is feasible at each, so stopping early only costs padding.
    pivots: int = 20_000


def tokenizer_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts, put together from those of their white-space words.

    The tokenizer drops white space and its words never reach across it, so a text's ids are
    those of its words one after the other; only words not met before are encoded."""

    #: White space by Unicode; str.split() also takes U+001C to U+001F, which are not.
    _NOT_SPACE = re.compile("[\\x1c-\\x1f]")
    _SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")

    def __init__(self, path: str, remembered: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered, self.known = Tokenizer.from_file(path), remembered, {}
        made = json.loads(self.tokenizer.to_str())
        if not re.search(r"\\s", json.dumps(made["pre_tokenizer"])):
            raise ValueError("the tokenizer does not drop white space: its texts cannot be put together from words")
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        rules = json.dumps(made["pre_tokenizer"], ensure_ascii=False)
        #: Whether case is dropped and a word's last punctuation stands apart from its letters: then a text is prepared
        #: so that fewer words differ. Only texts below U+0250 are, where one character is one lower-case character.
        self.folds = '"Lowercase"' in json.dumps(made["normalizer"]) and r"[^\\s\\p{L}\\p{N}]+" in rules and r"[\\p{L}]+" in rules
        #: Strings that the tokenizer takes out of a text before anything else; one of them can stand between words.
        self.special = [(x["content"], x["id"]) for x in made["added_tokens"] if x["special"] and not x["normalized"]]
        #: By id whether it ends a run of letters or of other signs, where the vocabulary says so.
        suffix = made["model"].get("end_of_word_suffix")
        self.ends = None
        if self.folds and suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    #: Beyond these a lower-case letter may be several characters; strings like <|...|> are found before case is dropped.
    _OTHER = re.compile("[^\\x00-\u012f\u0131-\u024f]|<\\|")
    _LAST = re.compile("(?<=[a-z\xdf-\xf6\xf8-\xff])([!-&(-/:-@[-`{-~]+)(?=[ \\n]|$)")
    #: One run of letters that no rule changes.
    _LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")

    def _prepared(self, text: str) -> str:
        if not self.folds or self._OTHER.search(text):
            return text
        return self._LAST.sub(r" \1", text.lower())

    _SIGNS = "".join(filter(re.compile("[!-&(-/:-@[-`{-~]").match, map(chr, range(128))))
    #: Texts without these are split and put together as arrays: there white space is that of ASCII.
    _NOT_PLAIN = "[^\\x{00}-\\x{1b}\\x{20}-\\x{84}\\x{86}-\\x{9f}\\x{a1}-\\x{12f}\\x{131}-\\x{24f}]|<\\|"

    def _learn(self, words: list[str]) -> None:
        """Encode words not met before: those of letters alone in one text, where an id tells that it is a word's last; the
        others in one with a special string between them where there is one."""
        if self.ends is not None:
            own = [w for w in words if self._LETTERS.fullmatch(w)]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, np.int64)
            last = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(last) == len(own):
                raw, width, a = ids.astype(self.kind).tobytes(), self.kind.itemsize, 0
                for w, b in zip(own, last, strict=True):
                    self.known[w] = raw[a * width : b * width]
                    a = b
                words = [w for w in words if w not in self.known]
        plain = [w for w in words if self.special and not any(t in w for t, _ in self.special)]
        if plain:
            mark, mark_id = self.special[0]
            ids = np.array(self.tokenizer.encode_batch_fast([mark.join(plain)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.append(np.flatnonzero(ids == mark_id), len(ids)).tolist()
            ids, a = ids.astype(self.kind), 0
            for w, b in zip(plain, ends, strict=True):
                self.known[w] = ids[a:b].tobytes()
                a = b + 1
        rest = [w for w in words if w not in self.known]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, self.kind).tobytes()

    def _of(self, words: list[str]) -> list[bytes]:
        """Ids of different words."""
        known = self.known
        new = [w for w in words if w not in known]
        if words and len(known) > self.remembered:  # words that these texts use are the likeliest to come again
            known = self.known = {w: known[w] for w in words if w in known}
        for a in range(0, len(new), 50_000):
            self._learn(new[a : a + 50_000])
        return list(map(known.__getitem__, words))

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        by_text = [self._SPACE.split(t) if self._NOT_SPACE.search(t) else t.split() for t in map(self._prepared, texts)]
        met = sorted(set().union(*by_text))
        own = dict(zip(met, self._of(met), strict=True))
        return [b"".join(map(own.__getitem__, words)) for words in by_text]

    def _together(self, texts: pa.Array) -> list[bytes]:
        """Of texts that are prepared alike: each different word is looked up once, and its ids are dealt to its places."""
        split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        body = pc.ascii_rtrim(words, characters=self._SIGNS)  # signs behind a letter stand apart
        body = pc.if_else(pc.match_substring_regex(body, "[a-z\xdf-\xf6\xf8-\xff]$"), body, words)
        cut = pc.binary_length(words).to_numpy() - pc.binary_length(body).to_numpy()
        has = np.flatnonzero(cut)
        signs = [w[-k:] for w, k in zip(words.take(pa.array(has)).to_pylist(), cut[has].tolist(), strict=True)]
        known = pa.concat_arrays([body, pa.array(signs, pa.string())]).dictionary_encode()
        own = [*self._of(known.dictionary.to_pylist()), b""]
        pair = np.full((len(words), 2), len(own) - 1)
        pair[:, 0] = known.indices[: len(words)].to_numpy()
        pair[has, 1] = known.indices[len(words) :].to_numpy()
        width = self.kind.itemsize
        size = np.fromiter(map(len, own), np.int64, len(own)) // width
        ids, first = np.frombuffer(b"".join(own), self.kind), np.cumsum(size) - size
        place = pair[coded.indices.to_numpy()].ravel()
        n = size[place]
        end = np.append(0, np.cumsum(n))
        out = ids[np.repeat(first[place] - end[:-1], n) + np.arange(end[-1])].tobytes()
        at = (end[2 * (split.offsets.to_numpy() - split.offsets[0].as_py())] * width).tolist()
        return [out[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian ids of each text, in ``kind``."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not self.folds:
            return self._one_by_one(texts.to_pylist())
        other = pc.match_substring_regex(texts, self._NOT_PLAIN)
        alike = iter(self._together(texts.filter(pc.invert(other))))
        alone = iter(self._one_by_one(texts.filter(other).to_pylist()))
        return [next(alone if x else alike) for x in other.to_pylist()]


_encoders: dict[tuple[str, int], WordEncoder] = {}


def _encoder(path: str, remembered: int) -> WordEncoder:
    """One encoder for a worker's life: what it remembers serves its next tasks."""
    if (path, remembered) not in _encoders:
        _encoders[path, remembered] = WordEncoder(path, remembered)
    return _encoders[path, remembered]


_PIECES = (
    # class: of short pieces the length, negative; of others the length in units, rounded up
    "piece long, part int, start long, length long, doc_tokens long, class int, ids_crc32 long, ids binary"
)


def cut(docs: DataFrame, p: Params) -> DataFrame:
    """The pieces: piece (unique), part, doc_id, start, length, doc_tokens, class, ids_crc32, ids (little-endian uint32)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        encoder = _encoder(tokenizer_path(p.tokenizer), p.remembered)
        end = np.array([p.end_id], encoder.kind).tobytes()
        width = encoder.kind.itemsize
        for batch in batches:
            texts = batch.column(1)
            lo, size = 0, 0
            for i in range(len(texts)):  # some texts at a time, so that a batch of long ones is not held as ids at once
                size += len(texts[i].as_buffer()) if texts[i].is_valid else 0
                if size < p.together and i + 1 < len(texts):
                    continue
                doc, start, length, total, crc, ids = [], [], [], [], [], []
                for k, own in enumerate(encoder.ids(texts[lo : i + 1].cast(pa.string()).fill_null("")), lo):
                    own += end
                    tokens = len(own) // width
                    for a in range(0, tokens, p.size):
                        piece = np.frombuffer(own[a * width : (a + p.size) * width], encoder.kind).astype("<u4").tobytes()
                        doc.append(k)
                        start.append(a)
                        length.append(len(piece) // 4)
                        total.append(tokens)
                        crc.append(zlib.crc32(piece))
                        ids.append(piece if p.ids else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((part << 36) + n + np.arange(len(doc)), pa.int64()), pa.array([part] * len(doc), pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()),
                        pa.array([-x if x <= p.short else -(-x // p.unit) for x in length], pa.int32()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary()),
                        batch.column(0).take(pa.array(doc, pa.int64())),
                    ],
                    ["piece", "part", "start", "length", "doc_tokens", "class", "ids_crc32", "ids", "doc_id"],
                )
                n += len(doc)
                lo, size = i + 1, 0

    return map_batches(prefixed(docs, "doc_id", "text"), run, f"{_PIECES}, doc_id {kind}")


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes 1..capacity whose sizes add up to at most capacity."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = best[c - 1 :: -1][: len(values)] + values[:c]
        i = int(gain.argmax())
        if gain[i] > best[c - 1] + 1e-12:
            best[c], choice[c] = gain[i], i + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(values), np.int64), capacity
    while c > 0:
        if choice[c]:
            counts[choice[c] - 1] += 1
            c -= choice[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def patterns(demand: np.ndarray, pivots: int = 20_000) -> list[tuple[np.ndarray, int]]:
    """(pieces by class, how often) that meet ``demand`` (pieces by class 1..capacity) in few sequences."""
    demand, capacity = demand.astype(np.int64), len(demand)
    kinds = np.flatnonzero(demand)
    if not len(kinds):
        return []
    m = len(kinds)
    d = demand[kinds] * (1 + 1e-9 * np.arange(1, m + 1))  # breaks ties among the rows
    columns = np.diag((capacity // (kinds + 1)).astype(float))
    cost, inverse = np.ones(m), np.diag(1 / np.diag(columns))
    x = inverse @ d
    for _ in range(pivots):
        y = cost @ inverse
        worst = int(y.argmin())
        if y[worst] < -1e-9:  # giving up a surplus piece pays
            column, price = np.zeros(m), 0.0
            column[worst] = -1
        else:
            values = np.zeros(capacity)
            values[kinds] = y
            gain, counts = knapsack(values, capacity)
            if gain <= 1 + 1e-7:
                break
            column, price = counts[kinds].astype(float), 1.0
        u = inverse @ column
        ratio = np.full(m, np.inf)
        ratio[u > 1e-9] = x[u > 1e-9] / u[u > 1e-9]
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        x = np.maximum(x - step * u, 0)
        x[out] = step
        inverse[out] /= u[out]
        rest = np.arange(m) != out
        inverse[rest] -= np.outer(u[rest], inverse[out])
        columns[:, out], cost[out] = column, price
    found, left = [], demand.copy()
    for j in np.flatnonzero((cost > 0) & (x >= 1)):
        counts = np.zeros(capacity, np.int64)
        counts[kinds] = columns[:, j].astype(np.int64)
        found.append((counts, int(x[j])))
        left -= counts * int(x[j])
    return found + _first_fit(np.maximum(left, 0))


def _first_fit(left: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Places the pieces that rounding left (a few for each pattern of the basis), by decreasing class."""
    open_, found = [], []
    for c in np.flatnonzero(left)[::-1]:
        n = int(left[c])
        for counts in open_:
            if not n:
                break
            k = min(n, (len(left) - int(counts @ np.arange(1, len(left) + 1))) // (c + 1))
            counts[c] += k
            n -= k
        while n:
            counts = np.zeros(len(left), np.int64)
            counts[c] = min(n, len(left) // (c + 1))
            n -= int(counts[c])
            open_.append(counts)
    found.extend((counts, 1) for counts in open_)
    return found


def pack(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, piece.

    The ids themselves lie in the written pieces (unless ``p.ids`` is off); ``with_ids`` brings them to the rows."""
    return layout(stored(cut(docs, p), "pieces"), p)


def layout(pieces: DataFrame, p: Params) -> DataFrame:
    spark = pieces.sparkSession
    capacity = p.size // p.unit
    demand = np.zeros(capacity, np.int64)
    by_part = stored(pieces.groupBy("class", "part").agg(F.count("*").alias("n")), "counts")
    short: dict[int, int] = {}
    for r in by_part.groupBy("class").agg(F.sum("n").alias("n")).collect():  # at most size / unit + short rows
        if r["class"] < 0:
            short[-r["class"]] = r["n"]
        else:
            demand[r["class"] - 1] = r["n"]
    # bundles rank behind the pieces of their class: (length, ranks [lo, hi) of its pieces, pieces of a bundle, class, first rank)
    bundles = []
    for length, n in sorted(short.items()):
        most = max(1, min(p.bundle, p.size) // length)
        full = min(range(1, most + 1), key=lambda k: (-(-k * length // p.unit) * p.unit / (k * length), k))
        for lo, hi, each in ((0, n - n % full, full), (n - n % full, n, n % full)):
            if hi > lo:
                kind = -(-each * length // p.unit)
                bundles.append((-length, lo, hi, each, kind, int(demand[kind - 1])))
                demand[kind - 1] += (hi - lo) // each
    places, first, taken = [], 0, np.zeros(capacity, np.int64)
    for counts, times in patterns(demand, p.pivots):
        for c in np.flatnonzero(counts):
            lo = int(taken[c])
            taken[c] += int(counts[c]) * times
            places.append((int(c) + 1, lo, int(taken[c]), first, int(counts[c])))
        first += times
    plan = spark.createDataFrame(places, "class int, lo long, hi long, first long, each long")
    before = by_part.select(
        "class", "part",
        (F.sum("n").over(Window.partitionBy("class").orderBy("part")) - F.col("n")).alias("before"),
    )
    light = pieces.select(*[c for c in pieces.columns if c != "ids"])
    ranked = light.withColumn(
        "place", F.row_number().over(Window.partitionBy("class", "part").orderBy("piece")) - 1
    ).join(before, ["class", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    # two rows a short length: its pieces take their bundle's class and rank
    bundled = spark.createDataFrame(bundles, "class int, b_lo long, b_hi long, b_each long, b_class int, b_first long")
    small = ranked.filter("class < 0").join(F.broadcast(bundled), "class").filter("rank >= b_lo AND rank < b_hi")
    small = small.withColumn("rank", F.col("b_first") + F.floor((F.col("rank") - F.col("b_lo")) / F.col("b_each")))
    ranked = ranked.filter("class > 0").unionByName(
        small.withColumn("class", F.col("b_class")).drop("b_lo", "b_hi", "b_each", "b_class", "b_first")
    )
    # the plan has a few rows for each class, whatever the input: at most size / unit patterns and the rest's sequences
    dealt = ranked.join(F.broadcast(plan), "class").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    in_sequence = Window.partitionBy("sequence_id")
    running = in_sequence.orderBy(F.desc("length"), "piece").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn(
        "sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each")).cast("long")
    ).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(running), F.lit(0)).cast("long").alias("offset"),
        F.sum("length").over(in_sequence).alias("sequence_tokens"),
        "piece",
    )


def with_ids(packed: DataFrame, pieces: DataFrame) -> DataFrame:
    """``packed`` with each piece's ids (little-endian uint32), from the written pieces."""
    return packed.join(pieces.select("piece", "ids"), "piece")
