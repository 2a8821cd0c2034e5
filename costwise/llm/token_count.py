"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text up to ``whole`` characters is encoded at once. A longer one is encoded in chunks that overlap,
with the offsets of the tokens; two neighbours are spliced where both have a token boundary at the same
place, ``agree`` tokens in a row are the same on either side of it, and the boundary lies at least
``margin`` characters inside both chunks. A boundary is proven stable if the vocabulary has no piece that
could reach across it: the one before a white-space mark whose left neighbour is none. When two chunks have
no such boundary in common, their overlap is doubled and both are encoded anew, up to the whole rest.

Defined cases: a null text counts as empty and has no token; repeated rows are counted each; a null id is
kept; extra columns are ignored.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from costwise.llm.storage import map_batches, prefixed

#: The tokenizer's file is found on each executor by this name unless a path is given.
TOKENIZER = "piece_bpe_32k.model"
_MARK = "▁"


@dataclass(frozen=True)
class Params:
    tokenizer: str = TOKENIZER
    whole: int = 1 << 16
    chunk: int = 1 << 15
    overlap: int = 512
    margin: int = 64
    agree: int = 4
    #: Texts of a call to the library, by characters.
    together: int = 1 << 18


class PieceCounter:
    def __init__(self, p: Params):
        import sentencepiece

        path = p.tokenizer
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.p, self.model = p, sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: No piece goes from a character that is not the mark to a mark.
        self.words_apart = not any(a != _MARK and b == _MARK for x in pieces for a, b in zip(x, x[1:], strict=False))

    def _offsets(self, text: str, a: int, b: int) -> list[tuple[int, int]]:
        """(start, id) of the tokens of text[a:b], starts in characters of the whole text."""
        own = text[a:b]
        proto = self.model.encode(own, return_type="proto")
        data = np.frombuffer(own.encode("utf-8", "surrogatepass"), np.uint8)
        place = np.append(0, np.cumsum((data & 0xC0) != 0x80)).tolist()  # the library counts bytes
        return [(a + place[x.begin], x.id) for x in proto.pieces]

    def count(self, texts: list[str]) -> list[int]:
        out: list[int | None] = [None] * len(texts)
        held: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if len(text) > self.p.whole and self.words_apart:
                out[i] = self.count_long(text)
                continue
            held.append(i)
            size += len(text)
            if size > self.p.together:
                self._together(texts, held, out)
                held, size = [], 0
        self._together(texts, held, out)
        return out

    def _together(self, texts, held, out) -> None:
        for i, ids in zip(held, self.model.encode([texts[i] for i in held], num_threads=1), strict=True):
            out[i] = len(ids)

    def count_long(self, text: str) -> int:
        """Tokens of one huge text. ``done`` tokens end at ``at``, a stable boundary."""
        p, done, at = self.p, 0, 0
        left = self._chunk(text, 0, min(len(text), p.chunk))
        left_end = min(len(text), p.chunk)
        while left_end < len(text):
            overlap = p.overlap
            while True:
                lo = max(at, left_end - overlap)
                hi = min(len(text), lo + p.chunk)
                if overlap >= p.chunk // 2:  # both chunks grow with the overlap
                    hi = min(len(text), lo + 2 * overlap)
                right = self._chunk(text, lo, hi)
                cut = self._splice(text, left, right, lo, left_end)
                if cut is not None:
                    break
                if lo <= at:  # nothing in common down to the last boundary: encode on from there as one chunk
                    hi = min(len(text), at + 2 * max(p.chunk, left_end - at))
                    left, left_end = self._chunk(text, at, hi), hi
                    right = None
                    break
                overlap *= 2
            if right is None:
                continue
            done += sum(1 for s, _ in left if s < cut)
            at = cut
            left, left_end = [x for x in right if x[0] >= cut], hi
        return done + len(left)

    def _chunk(self, text: str, a: int, b: int) -> list[tuple[int, int]]:
        """Tokens of a chunk. The library puts a mark before its text, so a chunk that starts at a blank gives that
        blank to the mark; any other start is out of step until the first stable boundary."""
        if a and text[a] == " ":
            return self._offsets(text, a + 1, b) if b > a + 1 else []
        return self._offsets(text, a, b)

    def _splice(self, text: str, left, right, lo: int, hi: int) -> int | None:
        """A place inside [lo + margin, hi - margin] where both chunks have the same tokens around a stable boundary."""
        p = self.p
        mine = {s: k for k, (s, _) in enumerate(left) if s >= lo}
        for k, (s, _) in enumerate(right):
            if s < lo + p.margin or s not in mine:
                continue
            if s > hi - p.margin:
                break
            if not (text[s] == " " and text[s - 1] != " "):
                continue
            j = mine[s]
            before, after = left[j - p.agree : j], left[j : j + p.agree]
            if j >= p.agree and k >= p.agree and before == right[k - p.agree : k] and after == right[k : k + p.agree]:
                return s
        return None


_counters: dict[Params, PieceCounter] = {}


def counter(p: Params) -> PieceCounter:
    """One counter for a worker's life."""
    if p not in _counters:
        _counters[p] = PieceCounter(p)
    return _counters[p]


def count_tokens(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = counter(p)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(own.count(texts), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return map_batches(prefixed(docs, "doc_id", "text"), run, f"doc_id {kind}, n_bytes long, n_tokens long")
