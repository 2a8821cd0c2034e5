"""Benchmark decontamination: near copies of benchmark items inside documents, by edit distance.

Candidates come from CGK random walks. A walk over a string reads a character at every step and goes on to the
next one or stays, by a random bit that depends on the step and the character; what it reads is the embedding.
Two strings that differ by few edits have walks that fall into step again after each edit, so that edit distance
becomes Hamming distance between embeddings. Windows are as long as an item allows: an item of n characters
has windows of the largest size (16, 32, 64 or 128) up to six tenths of n, from all its word starts on, and a document has
windows of those sizes at all its word starts. Of words over 16 characters every place is a start (but inside a run of one
character), so that passages in text without blanks are found too. Embeddings meet
by repeated bit sampling: each repetition hashes a few sampled places of the embedding, and windows that agree in one
of them are candidates, unless the embeddings of the whole windows, or by further walks those of the item's rest, agree
in too few places (``agree``, ``agree_rest``). Every candidate is verified by the exact edit distance of the whole item
to the best part of the text there, on code points. Recall is measured in the tests: above 0.9 up to edits of a fifth of
an item's characters, near 1 up to a tenth.

Documents stay where they are: the benchmark is what travels, in blocks of ``block`` items (each block
is one more pass), so nothing is shuffled and a frequent passage or source loads no task.

Characters are compared with A-Z lowered and each run of ASCII white space as one blank. Defined cases: null or
empty texts and items match nothing; items under ``short`` characters match verbatim, every time they stand between
characters that are neither letters nor digits; repeated items or documents are reported each; extra columns are
ignored; ids are of any type, a null id is reported as null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from costwise.llm.storage import map_batches, prefixed, ship


@dataclass(frozen=True)
class Params:
    #: Edits allowed, as a share of the item's characters.
    distance: float = 0.2
    #: Walks, repetitions of bit sampling for each walk, and places sampled by one repetition.
    walks: int = 1
    repeats: int = 10
    places: int = 11
    #: Steps among which those places lie.
    stretch: int = 20
    #: Share of places in which the embeddings of a candidate pair agree at least: of the window, and of all that follows
    #: in the item, by ``confirm`` further walks.
    agree: float = 0.3
    agree_rest: float = 0.25
    confirm: int = 2
    short: int = 32
    block: int = 5000
    #: Characters of documents that are looked at together.
    together: int = 1 << 20


_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32

#: A byte that no folded text has (A): what lies beyond an item's end agrees with nothing.
_NOTHING = 65


def collapsed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points with A-Z lowered, of each run of blanks the first only; and where each stands in the text."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    c = code.copy()
    low = code < 128
    c[low] = _FOLD[code[low]]
    blank = c == 32
    blank[1:] &= blank[:-1]
    blank[:1] = False
    at = np.flatnonzero(~blank)
    return c[at], at


def _plain(c: np.ndarray) -> str:
    return c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _bytes(c: np.ndarray) -> np.ndarray:
    """One byte a character for the walks: folded ASCII, the others dealt over 128-255."""
    return np.where(c < 128, c, 128 + ((c.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(25))).astype(np.uint8)


def edit_search(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end) of the part of ``text`` closest to ``pattern``; the leftmost such end.

    The column of the dynamic programme is kept as two bit vectors of its differences."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        places[ch] = places.get(ch, 0) | 1 << i
    up, down, score = full, 0, m
    best = (m, 0)
    for j, ch in enumerate(text, 1):
        equal = places.get(ch, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        rise = down | (full & ~(diagonal | up))
        fall = up & diagonal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            if score < best[0]:
                best = (score, j)
        rise, fall = (rise << 1) & full, (fall << 1) & full
        held = equal | down
        up = fall | (full & ~(held | rise))
        down = rise & held
    return best


#: The largest window. Longer items have more windows, not longer ones, so that a word start costs the same for any benchmark.
_LARGEST = 128

#: Steps of what follows in an item that are compared at most.
_FOLLOWING = 1024

#: In words longer than this there are starts at every place, so that text without blanks has them as well.
_WORD = 16


def window_size(n: int) -> int:
    """The largest of 16, 32, 64 and 128 up to six tenths of an item's characters."""
    return min(_LARGEST, 1 << ((n * 6 // 10).bit_length() - 1))


class Walk:
    """One random walk. Windows of all sizes share its first steps."""

    #: Steps whose moves stand in one number, above a character's code.
    SPAN = 48

    def __init__(self, steps: int, seed: int):
        rng = np.random.Generator(np.random.PCG64([steps, seed]))
        self.steps = steps  # a step goes on every other time: about three quarters of the window are read
        self.go = rng.integers(0, 2, (steps, 256), dtype=np.uint8)
        self.spans = []
        for a in range(0, steps, self.SPAN):
            go = self.go[a : a + self.SPAN].astype(np.uint64)
            # the next move is the highest bit; below the span's the bits of a fixed draw tell characters apart in sums
            moves = (go << (np.uint64(63) - np.arange(len(go), dtype=np.uint64))[:, None]).sum(axis=0, dtype=np.uint64)
            self.spans.append(moves + rng.integers(0, 1 << 8, 256, dtype=np.uint64) * np.uint64(256) + np.arange(256, dtype=np.uint64))

    def read(self, codes: np.ndarray, at: np.ndarray, steps: int, places: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """What the first steps of the walks from ``at``, in order, read, a row a window; and for each of ``places`` a 32-bit
        hash of what they read there, repetitions x windows. ``codes`` goes on for as many steps behind the last of ``at``.

        Walks that have come to the same place stay together: from each span on one of them goes on for all."""
        out = np.empty((len(at), steps), np.uint8)
        hashes = [np.empty((len(own), len(at)), np.uint32) for own in places]
        if not len(at):
            return out, hashes
        used: list[list[tuple[int, int]]] = [[] for _ in range(steps)]
        for k, own in enumerate(places):
            for r, where in enumerate(own):
                for j in where.tolist():
                    used[j].append((k, r))
        # of each repetition begun: the sum so far by walk, the walk of each window then, and of each walk then the one now
        sums: dict[tuple[int, int], np.ndarray] = {}
        owner: dict[tuple[int, int], np.ndarray | None] = {}
        now: dict[tuple[int, int], np.ndarray] = {}
        i, walk = at.astype(np.int64), None
        for a in range(0, steps, self.SPAN):
            if a:
                new = np.append(True, i[1:] != i[:-1])
                if not new.all():
                    to = np.cumsum(new) - 1
                    i, walk = i[new], to if walk is None else to[walk]
                    for key in {key for later in used[a:] for key in later} & sums.keys():
                        now[key] = to[now[key]] if key in now else to
            n, size = len(i), min(self.SPAN, steps - a)
            read = np.zeros((-(-size // 8), n + 9, 8), np.uint8)  # rows of no power of two, eight steps together: quick to turn
            v, turned, move = np.empty(n, np.uint64), np.empty(n, np.uint64), np.empty(n, np.uint64)
            code, gone, low = v.view(np.uint8)[::8], move.view(np.int64), int(i[0])
            here = self.spans[a // self.SPAN].take(codes[low : int(i[-1]) + size + 1])
            i -= low
            for j in range(size):
                here.take(i, out=v, mode="clip")
                read[j >> 3, :n, j & 7] = code
                np.left_shift(v, j, out=turned)
                for key in used[a + j]:
                    if key not in sums:
                        sums[key], owner[key] = turned.copy(), walk
                    else:
                        sums[key] += turned.take(now[key]) if key in now else turned
                np.right_shift(turned, 63, out=move)
                i += gone
            i += low
            rows = _rows(read, n)[:, :size]
            out[:, a : a + size] = rows if walk is None else rows.take(walk, axis=0)
        for (k, r), h in sums.items():
            h = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) ^ np.uint32(r * 0x85EBCA6B & 0xFFFFFFFF)
            hashes[k][r] = h if owner[k, r] is None else h.take(owner[k, r])
        return out, hashes

    def follow(self, codes: np.ndarray, at: np.ndarray, need: np.ndarray, behind: int) -> tuple[np.ndarray, np.ndarray]:
        """What the walks from ``at`` read in ``need`` steps each, filled with ``behind``; and the row of each."""
        order = np.argsort(-need, kind="stable")
        i, down, codes, go = at[order].astype(np.int64), -need[order], codes.astype(np.int64), self.go.astype(np.int64)
        row = np.empty(len(at), np.int64)
        row[order] = np.arange(len(at))
        longest = -int(down[0])
        out = np.full((-(-longest // 8), len(at) + 9, 8), behind, np.uint8)
        for j, k in enumerate(np.searchsorted(down, -np.arange(longest), "left").tolist()):
            x = codes.take(i[:k], mode="clip")
            out[j >> 3, :k, j & 7] = x.view(np.uint8)[::8]
            i[:k] += go[j].take(x)
        return _rows(out, len(at))[:, :longest], row


def _rows(out: np.ndarray, n: int) -> np.ndarray:
    """What ``n`` walks read, a row a walk, of steps laid out by eights x walks x 8."""
    return np.ascontiguousarray(out.view(np.uint64)[:, :n, 0].T).view(np.uint8)


def _places(size: int, seed: int, p: Params) -> list[np.ndarray]:
    """The steps that each repetition samples, for windows of one size."""
    rng = np.random.Generator(np.random.PCG64([size, seed]))
    steps = 3 * size // 2
    # the places of a repetition lie near each other, so that one stretch without an edit serves them all
    stretch = min(p.stretch, steps)
    return [np.sort(r * (steps - stretch) // max(1, p.repeats - 1) + rng.choice(stretch, min(p.places, stretch), replace=False)) for r in range(p.repeats)]


def _agreeing(read: np.ndarray, i: np.ndarray, other: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many places rows ``i`` of ``read`` agree with rows ``j`` of ``other``; some at a time, so that they stay small."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), 2048):
        same = np.packbits(read.take(i[a : a + 2048], axis=0) == other.take(j[a : a + 2048], axis=0), axis=1)
        out[a : a + 2048] = np.bitwise_count(same).sum(axis=1, dtype=np.int64)
    return out


def _starts(codes: np.ndarray) -> np.ndarray:
    """All word starts, and of a word longer than ``_WORD`` every place whose character is not the one before."""
    word = codes != 32
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    at, end = np.flatnonzero(first), np.flatnonzero(last)
    long = end - at >= _WORD
    if long.any():
        inside = np.zeros(len(codes) + 1, np.int8)
        inside[at[long]], inside[end[long] + 1] = 1, -1
        first[1:] |= (np.cumsum(inside[:-1], dtype=np.int8)[1:] == 1) & (codes[1:] != codes[:-1])
        at = np.flatnonzero(first)
    return at


#: The bits of a sketch that are looked up first: 64 places a key, so many at most.
_MAP = 22

#: Windows that a block's index holds at most, but for a longer item: about half a kilobyte each.
_WINDOWS = 1 << 18

#: Windows that walk together.
_TOGETHER = 16384

#: Pairs of windows that are made together, and those compared by what follows.
_PAIRS, _FOLLOWED = 1 << 21, 1 << 16


class Table:
    """Sketches of the items' windows of one size."""

    def __init__(self, size: int, items: list[tuple[int, np.ndarray]], walks: list[Walk], rest: list[Walk], p: Params):
        self.size, self.steps, self.rest, self.p = size, 3 * size // 2, rest, p
        self.sampled = [_places(size, s, p) for s in range(len(walks))]
        # the items one after the other, with room behind each for a walk from its last character
        laid, own, place, at, length, end = [], [], [], [], [], 0
        for k, codes in items:
            x = _starts(codes)
            x = x[x <= max(0, len(codes) - size // 2)]
            own.append(np.full(len(x), k))
            place.append(x)
            at.append(end + x)
            length.append(np.minimum(3 * (len(codes) - x) // 2, _FOLLOWING))
            room = max(self.steps, int(length[-1][0])) + 1
            laid += [codes, np.zeros(room, np.uint8)]
            end += len(codes) + room
        self.laid = np.concatenate(laid)
        self.own, self.place, self.at, self.length = (np.concatenate(x) for x in (own, place, at, length))
        keys, which, windows = [], [], []
        for a in range(0, len(self.at), _TOGETHER):
            reads = [walk.read(self.laid, self.at[a : a + _TOGETHER], self.steps, [sampled]) for walk, sampled in zip(walks, self.sampled, strict=True)]
            for w, (_, (h,)) in enumerate(reads):
                keys.append((h.astype(np.uint64) | np.uint64(w) << np.uint64(32)).ravel())
                which.append(np.tile(np.arange(a, a + h.shape[1]), len(h)))
            for rows, _ in reads:
                rows[np.arange(self.steps) >= self.length[a : a + _TOGETHER, None]] = _NOTHING
            windows.append(np.concatenate([rows for rows, _ in reads], axis=1))
        self.windows = np.concatenate(windows)
        key, which = np.concatenate(keys), np.concatenate(which)
        order = np.argsort(key, kind="stable")
        self.keys, self.first = np.unique(key[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(key)))
        self.which = which[order].astype(np.int32)
        self.bits = min(_MAP, max(16, (64 * len(self.keys)).bit_length()))
        self.maybe = np.zeros((len(walks), 1 << self.bits), bool)
        low = (self.keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.maybe[(self.keys >> np.uint64(32)).astype(np.int64), low >> np.uint32(32 - self.bits)] = True

    def met(self, reads: list[np.ndarray], hashes: list[np.ndarray]):
        """(row, window) of the walks that agree with a window in one of the repetitions and in enough places of all, rows
        in order, some at a time."""
        columns, keys = [], []
        for w, h in enumerate(hashes):
            hit = np.flatnonzero(self.maybe[w].take((h >> np.uint32(32 - self.bits)).ravel(), mode="wrap"))
            key = h.ravel()[hit].astype(np.uint64) | np.uint64(w) << np.uint64(32)
            j = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            same = self.keys[j] == key
            keys.append(j[same])
            columns.append(hit[same] % h.shape[1])
        column, j = np.concatenate(columns), np.concatenate(keys)
        n = self.count[j]
        if n.sum() <= _PAIRS:
            yield self._alike(reads, column, j, n)
            return
        part = (np.cumsum(np.bincount(column, n)) // _PAIRS).astype(np.int64)[column]
        order = np.argsort(part, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            yield self._alike(reads, column[own], j[own], n[own])

    def _alike(self, reads: list[np.ndarray], column: np.ndarray, j: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of walks ``column`` that met the ``n`` windows of keys ``j`` the pairs whose embeddings agree in enough places."""
        total = np.cumsum(n)
        run = np.repeat(self.first[j] - (total - n), n) + np.arange(total[-1] if len(total) else 0)
        pair = np.sort(np.repeat(column, n) * np.int64(len(self.own)) + self.which[run])
        pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
        row, window = np.divmod(pair, len(self.own))
        if len(pair):
            read = [x[:, : self.steps] for x in reads]
            same = _agreeing(read[0] if len(read) == 1 else np.concatenate(read, axis=1), row, self.windows, window)
            like = same >= self.p.agree * len(reads) * np.minimum(self.length[window], self.steps)
            row, window = row[like], window[like]
        return row, window

    def followed(self, codes: np.ndarray, start: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Which of the pairs, by their starts in order, agree in enough places of what follows in the item."""
        if not len(start) or not self.rest:
            return np.ones(len(start), bool)
        new = np.append(True, start[1:] != start[:-1])
        first, back = np.flatnonzero(new), np.cumsum(new) - 1
        need = self.length[window]
        windows, other = np.unique(window, return_inverse=True)
        counted = np.zeros(len(start), np.int64)
        for walk in self.rest:
            read, row = walk.follow(codes, start[first], np.maximum.reduceat(need, first), 0)
            item, own = walk.follow(self.laid, self.at[windows], self.length[windows], _NOTHING)
            counted += _agreeing(read, row[back], item, own[other])
        return counted >= self.p.agree_rest * need * len(self.rest)


class Index:
    """One block of items and the sketches of their windows, by size: built once and broadcast, bounded by the block."""

    def __init__(self, items: list[tuple[object, str]], p: Params):
        self.p, self.ids = p, [i for i, _ in items]
        codes = [collapsed(t)[0] for _, t in items]
        self.text = [_plain(c) for c in codes]
        self.edits = [int(p.distance * len(c)) for c in codes]
        self.length = np.array([len(c) for c in codes], np.int64)
        self.runs = [_run_slots(c) for c in codes]
        self.most = np.array(self.edits, np.int64)
        # each item's runs by their hashes, with their places
        self.sorted_runs = np.concatenate([*[np.sort(r.astype(np.int64) << 40 | np.arange(len(r))) for r in self.runs], np.zeros(0, np.int64)])
        self.runs_at = np.cumsum([0, *[len(r) for r in self.runs]])
        self.exact = [
            (k, re.compile(rf"(?<![^\W_]){re.escape(t.strip())}(?![^\W_])")) for k, t in enumerate(self.text) if t.strip() and len(t) < p.short
        ]
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, c in enumerate(codes):
            if len(c) >= p.short and self.text[k].strip():
                by.setdefault(window_size(len(c)), []).append((k, _bytes(c)))
        self.walks = [Walk(3 * _LARGEST // 2, s) for s in range(p.walks)]
        rest = [Walk(_FOLLOWING, 1000 + s) for s in range(p.confirm)]
        self.tables = [Table(size, own, self.walks, rest, p) for size, own in sorted(by.items())]

    def candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place of its first character in ``codes``) of windows that agree with one of an item's windows."""
        if not self.tables:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        every, steps = _starts(codes), self.tables[-1].steps
        padded = np.append(codes, np.zeros(steps + 1, np.uint8))
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in self.tables]
        found = [np.zeros((2, 0), np.int64)]

        def follow(table, pairs):
            start, window = (np.concatenate(x) for x in zip(*pairs, strict=True))
            for b in range(0, len(start), _FOLLOWED):
                part, which = start[b : b + _FOLLOWED], window[b : b + _FOLLOWED]
                kept = table.followed(padded, part, which)
                found.append(np.unique(np.stack([table.own[which[kept]], part[kept] - table.place[which[kept]]]), axis=1))
            pairs.clear()

        for a in range(0, len(every), _TOGETHER):
            at = every[a : a + _TOGETHER]
            reads = [walk.read(padded, at, steps, [t.sampled[w] for t in self.tables]) for w, walk in enumerate(self.walks)]
            for k, table in enumerate(self.tables):
                for row, window in table.met([rows for rows, _ in reads], [hashes[k] for _, hashes in reads]):
                    held[k].append((at[row], window))
                    if sum(len(x) for x, _ in held[k]) >= _FOLLOWED:
                        follow(table, held[k])
        for table, pairs in zip(self.tables, held, strict=True):
            if pairs:
                follow(table, pairs)
        item, place = np.concatenate(found, axis=1)
        return item, place


def find(texts: list[str | None], index: Index) -> list[list[tuple[int, int, int, int]]]:
    """For each whole text the (item's place, start, end, distance) of its passages, in code points."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0
    for k, text in enumerate(texts):
        if text:
            held.append((k, *collapsed(text)))
            size += len(text)
        if held and (size >= index.p.together or k + 1 == len(texts)):
            _look(held, index, out)
            held, size = [], 0
    if held:
        _look(held, index, out)
    return out


def _look(held: list[tuple[int, np.ndarray, np.ndarray]], index: Index, out: list[list[tuple[int, int, int, int]]]) -> None:
    """Some texts, one after the other with a blank between them."""
    ends = np.cumsum([len(c) + 1 for _, c, _ in held])
    codes = np.full(int(ends[-1]), 32, np.uint8)
    for (_, c, _), end in zip(held, ends.tolist(), strict=True):
        codes[end - 1 - len(c) : end - 1] = _bytes(c)
    plain: dict[int, str] = {}
    met = np.zeros(1 << 16, bool)
    for t, item, lows, highs, groups in _by_text(*index.candidates(codes), index, ends, np.array([len(c) for _, c, _ in held])):
        k, c, at = held[t]
        slots = _run_slots(c)
        near: dict[int, list[int]] = {}
        for g in np.flatnonzero(_may_meet(index, item, slots, lows, highs)).tolist():
            i = int(item[g])
            own = groups(g)
            if _may_run(index.runs[i], slots, met, own, index.edits[i]):
                near.setdefault(i, []).extend(own)
        for i, places in near.items():
            if t not in plain:
                plain[t] = _plain(c)
            out[k] += [(i, int(at[a]), int(at[b - 1]) + 1, d) for a, b, d in _verified(plain[t], places, index.text[i], index.edits[i])]
    if index.exact:
        for t, (k, c, at) in enumerate(held):
            flat = plain.get(t) or _plain(c)
            for i, pattern in index.exact:
                out[k] += [(i, int(at[m.start()]), int(at[m.end() - 1]) + 1, 0) for m in pattern.finditer(flat)]


def _run_slots(c: np.ndarray) -> np.ndarray:
    """A 16-bit hash of each run of three code points."""
    c = c.astype(np.uint32)
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA6B) ^ c[2:] * np.uint32(0xC2B2AE35)
    return (h * np.uint32(0x27D4EB2F) >> np.uint32(16)).astype(np.uint16)


def _by_text(item: np.ndarray, place: np.ndarray, index: Index, ends: np.ndarray, lengths: np.ndarray):
    """For each text with candidates: its number, and of its groups (see ``_groups``) the items, first and last places,
    and all places of one."""
    if not len(item):
        return
    length = index.length[item]
    text = np.searchsorted(ends, np.clip(place + length // 2, 0, int(ends[-1]) - 1), "right")
    place = place - (ends - lengths - 1)[text]
    order = np.lexsort((place, item, text))
    text, item, place, length = text[order], item[order], place[order], length[order]
    new = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (place[1:] > place[:-1] + length[1:] // 4)
    first = np.flatnonzero(np.append(True, new))
    behind = np.append(first[1:], len(item))
    owner = text[first]
    cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])).tolist()
    for a, b in zip(cut, [*cut[1:], len(first)], strict=True):
        yield int(owner[a]), item[first[a:b]], place[first[a:b]], place[behind[a:b] - 1], lambda g, a=a: place[first[a + g] : behind[a + g]].tolist()


def _may_meet(index: Index, item: np.ndarray, slots: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``_may_run`` for all groups of a text together, each run where it may be: what fails here would fail there."""
    where = np.sort(slots.astype(np.int64) << 40 | np.arange(len(slots)))
    n = index.runs_at[item + 1] - index.runs_at[item]
    behind = np.cumsum(n)
    run = index.sorted_runs.take(np.arange(behind[-1]) + np.repeat(index.runs_at[item] - (behind - n), n))
    most = index.most[item]
    begin = run + np.repeat(low - most, n)  # of a run at the text's first characters it may be the slot before
    begin = np.maximum(begin, run >> 40 << 40)
    end = run + np.repeat(high + most, n)
    first = where.take(np.searchsorted(where, begin), mode="clip")
    return np.add.reduceat((first >= begin) & (first <= end), behind - n, dtype=np.int64) >= n - 3 * most


def _may_run(runs: np.ndarray, slots: np.ndarray, met: np.ndarray, places: list[int], most: int) -> bool:
    """``_enough_runs`` by the hashes of runs, first in any order and then each where it may be: what fails here would fail
    there. ``met`` is empty before and after."""
    least, low, width = len(runs) - 3 * most, places[0] - most, places[-1] - places[0] + 2 * most + 1
    begin, end = max(0, low), max(0, low + width + len(runs) - 1)
    here = slots[begin:end]
    at = here.astype(np.intp)
    met[at] = True
    n = np.count_nonzero(met.take(runs, mode="wrap"))
    met[at] = False
    if n < least or width > 4 * len(runs):
        return n >= least
    laid = np.zeros(len(runs) + width - 1, np.uint16)
    laid[begin - low : begin - low + len(here)] = here
    found = np.ndarray((len(runs), width), np.uint16, laid, 0, (2, 2)) == runs[:, None]
    return np.count_nonzero(found.any(axis=1)) >= least


def _groups(places: list[int], length: int) -> list[list[int]]:
    """``places`` in order, those that lie within a quarter of an item's ``length`` of the one before together."""
    out: list[list[int]] = []
    for place in sorted(places):
        if out and place <= out[-1][-1] + length // 4:
            out[-1].append(place)
        else:
            out.append([place])
    return out


def _enough_runs(pattern: str, flat: str, low: int, high: int, most: int) -> bool:
    """Whether as many of the pattern's runs of three stand where they may be as ``most`` edits must leave: an edit
    spoils three, and the others are shifted by ``most`` characters at the farthest from where the item begins."""
    find, lost, a, b = flat.find, 3 * most, low - most, high + most + 3
    for i in range(len(pattern) - 2):
        if find(pattern[i : i + 3], a + i if a + i > 0 else 0, b + i if b + i > 0 else 0) < 0:
            lost -= 1
            if lost < 0:
                return False
    return True


def _verified(flat: str, places: list[int], pattern: str, most: int) -> list[tuple[int, int, int]]:
    """(start, end, distance) of the passages of an item that begin near one of ``places``."""
    found = set()
    for group in _groups(places, len(pattern)):
        lo, hi = max(0, group[0] - most), min(len(flat), group[-1] + len(pattern) + most)
        d, end = edit_search(pattern, flat[lo:hi]) if _enough_runs(pattern, flat, group[0], group[-1], most) else (most + 1, 0)
        if d <= most:
            _, length = edit_search(pattern[::-1], flat[lo : lo + end][::-1])
            found.add((d, lo + end - length, lo + end))
    taken: list[tuple[int, int, int]] = []
    for d, a, b in sorted(found):  # of overlapping spans of one item the closest
        if a < b and all(b <= x or a >= y for x, y, _ in taken):
            taken.append((a, b, d))
    return taken


def _blocks(benchmark: DataFrame, p: Params):
    """The benchmark's non-empty items in blocks, streamed; the driver holds one block at a time."""
    block, windows = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if r["text"]:
            more = len(_starts(_bytes(collapsed(r["text"])[0])))
            if block and windows + more > _WINDOWS:
                yield block
                block, windows = [], 0
            block.append((r["item_id"], r["text"]))
            windows += more
        if len(block) == p.block:
            yield block
            block, windows = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, item_id, start, end (code points of the text), distance for each passage found."""
    spark = docs.sparkSession
    ship(spark)
    docs = prefixed(docs, "doc_id", "text")
    fields = [docs.schema["doc_id"], benchmark.schema["item_id"]]
    schema = f"doc_id {fields[0].dataType.simpleString()}, item_id {fields[1].dataType.simpleString()}, start long, end long, distance int"
    types = [*[to_arrow_type(f.dataType) for f in fields], pa.int64(), pa.int64(), pa.int32()]
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, p):
        sent = spark.sparkContext.broadcast(Index(block, p))

        def run(batches, sent=sent):
            index = sent.value
            for batch in batches:
                found = find(batch.column(1).to_pylist(), index)
                rows = [(d, index.ids[i], a, b, e) for d, own in zip(batch.column(0).to_pylist(), found, strict=True) for i, a, b, e in own]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "start", "end", "distance"]
                )

        out = out.unionByName(map_batches(docs, run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents that hold no benchmark passage, with all their columns."""
    spark = docs.sparkSession
    ship(spark)
    place = docs.columns.index("text")
    for block in _blocks(benchmark, p):
        sent = spark.sparkContext.broadcast(Index(block, p))

        def run(batches, sent=sent):
            index = sent.value
            for batch in batches:
                yield batch.filter(pa.array([not own for own in find(batch.column(place).to_pylist(), index)], pa.bool_()))

        docs = map_batches(docs, run, docs.schema)
    return docs
