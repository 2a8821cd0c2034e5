"""Words and word shingles as 64-bit hashes, in vectorised passes over UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered. The
passes run over windows of about a megabyte, so that working memory does not
follow the batch; one document's hashes are the only per-document state.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WINDOW = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = _TABLE[_LOWER]

_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, at least n of each."""
    if not _pow or len(_pow["up"]) < n:
        m = max(n, WINDOW + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(m, base, dtype=np.uint64)
            steps[0] = 1
            _pow[key] = np.cumprod(steps, dtype=np.uint64)
    return _pow["up"], _pow["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser over uint64 values (bijective)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null has no bytes."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, n + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _windows(data: np.ndarray, offsets: np.ndarray):
    """(start, end) byte ranges that end at a document's end or beside white space."""
    a, total = 0, int(offsets[-1])
    while a < total:
        b = min(a + WINDOW, total)
        if b < total:
            doc_end = int(offsets[np.searchsorted(offsets, b, "left")])
            doc_start = int(offsets[np.searchsorted(offsets, b, "right") - 1])
            if doc_end != b:
                if doc_start > a:
                    b = doc_start
                else:
                    spaces = np.flatnonzero(_SPACE[data[a:b]])
                    if len(spaces):
                        b = a + int(spaces[-1]) + 1
                    else:  # one word longer than a window
                        tail = data[b:doc_end]
                        more = np.flatnonzero(_SPACE[tail])
                        b = b + (int(more[0]) if len(more) else len(tail))
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and for each document the index of its first word (n + 1 entries)."""
    hashes, places = [], []
    for a, b in _windows(data, offsets):
        part = data[a:b]
        up, down = _powers(b - a + 1)
        word = ~_SPACE[part]
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        # a document's end also ends a word
        lo, hi = np.searchsorted(offsets, [a, b], "left")
        cuts = offsets[lo:hi] - a
        cuts = cuts[(cuts > 0) & (cuts < b - a)]
        first[cuts] = word[cuts]
        last[cuts - 1] = word[cuts - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_TABLE[part] * up[: b - a], out=sums[1:])
        h = (sums[end] - sums[start]) * down[start]
        hashes.append(mix(h + (end - start).astype(np.uint64)))
        places.append(start + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    h, at = np.concatenate(hashes), np.concatenate(places)
    return h, np.searchsorted(at, offsets, "left")


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct k-word shingles of one document, sorted; with fewer words the whole sequence is one."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : n - width + 1 + i])
    return np.unique(h)
