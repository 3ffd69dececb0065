"""The weighted ratio of similarity.py for many pairs of texts at once: an array step for each character, of all pairs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np

from panelcast.functions.similarity import FAR_LONGER, FAR_PART_SCALE, LONG, PART_SCALE, WORDS_SCALE

#: Bits of a machine word; longer texts are rows of Python's whole numbers.
WIDE = 63
#: Numbers that the marks of the texts scored at once take at most, and pairs scored at once.
MARKS, PAIRS = 1 << 22, 1 << 15
#: Parts of the weighted ratio, and itself.
PARTS = ("plain", "in_order", "word_set", "part", "part_words", "score")


def split(text: str) -> list[str]:
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]


class Texts:
    """Texts as rows of their characters' numbers from 1 on, filled up with 0."""

    def __init__(self, texts: list[str], letters: np.ndarray):
        self.texts, self.letters = texts, letters
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.codes = np.zeros((len(texts), int(self.sizes.max(initial=0)) + 1), np.int32)
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.codes[np.arange(self.codes.shape[1]) < self.sizes[:, None]] = np.searchsorted(letters, flat) + 1

    def marks(self, rows: np.ndarray, wide: bool) -> np.ndarray:
        """For each of rows and each letter the bits of the letter's places."""
        out = np.zeros((len(rows), len(self.letters) + 1), object if wide else np.uint64)
        for t in range(int(self.sizes[rows].max(initial=0))):
            out[np.arange(len(rows)), self.codes[rows, t]] |= 1 << t if wide else np.uint64(1 << t)
        out[:, 0] = 0
        return out

    @cached_property
    def turned(self) -> Texts:
        return Texts([t[::-1] for t in self.texts], self.letters)


def letters(*texts: list[str]) -> np.ndarray:
    return np.unique(np.frombuffer("".join("".join(t) for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32))


class Growing:
    """Longest common subsequences of texts x[i] and what follows of others: rows of bits, zero where one grows."""

    def __init__(self, x: Texts, i: np.ndarray):
        self.sizes = x.sizes[i]
        self.wide = int(self.sizes.max(initial=0)) > WIDE
        rows, self.at = np.unique(i, return_inverse=True)
        self.table = x.marks(rows, self.wide)
        self.full = np.array([(1 << int(n)) - 1 for n in self.sizes], object) if self.wide else (np.uint64(1) << self.sizes.astype(np.uint64)) - np.uint64(1)

    def step(self, v: np.ndarray, own: slice | np.ndarray, codes: np.ndarray) -> np.ndarray:
        m = self.table[self.at[own], codes]
        return ((v + (v & m)) | (v - (v & m))) & self.full[own]

    def length(self, v: np.ndarray, own: slice | np.ndarray = slice(None)) -> np.ndarray:
        ones = np.array([x.bit_count() for x in v], np.int64) if self.wide else np.bitwise_count(v)
        return self.sizes[own] - ones


def common(x: Texts, i: np.ndarray, y: Texts, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of x[i] and y[j]."""
    grown = Growing(x, i)
    v = grown.full
    for t in range(int(y.sizes[j].max(initial=0))):
        v = grown.step(v, slice(None), y.codes[j, t])
    return grown.length(v)


def best_window(x: Texts, i: np.ndarray, y: Texts, j: np.ndarray) -> np.ndarray:
    """The best ratio of x[i] to a stretch of y[j], no shorter than it, that is as long, or shorter at an end."""
    order = np.argsort(-x.sizes[i], kind="stable")
    i, j = i[order], j[order]
    m, n, best = x.sizes[i], y.sizes[j], np.zeros(len(i))
    for a, b in ((x, y), (x.turned, y.turned)):
        grown = Growing(a, i)
        for first in range(int((n - m).max(initial=-1)) + 1 if a is x else 1):
            own = np.flatnonzero(n - m >= first)
            v, size = grown.full[own], m[own]
            for t in range(int(size.max(initial=0))):
                left = int(np.searchsorted(-size, -t))  # those of more than t characters
                v[:left] = grown.step(v[:left], own[:left], b.codes[j[own[:left]], first + t])
                if first == 0:
                    best[own[:left]] = np.maximum(best[own[:left]], 200.0 * grown.length(v[:left], own[:left]) / (size[:left] + t + 1))
            best[own] = np.maximum(best[own], 200.0 * grown.length(v, own) / np.maximum(2 * size, 1))
    out = np.empty(len(i))
    out[order] = best
    return out


def part_ratio(x: Texts, i: np.ndarray, y: Texts, j: np.ndarray) -> np.ndarray:
    m, n = x.sizes[i], y.sizes[j]
    out = np.where((m == 0) & (n == 0), 100.0, 0.0)
    some = (m > 0) & (n > 0)
    for way, a, p, b, q in ((some & (m <= n), x, i, y, j), (some & (m >= n), y, j, x, i)):
        out[way] = np.maximum(out[way], best_window(a, p[way], b, q[way]))
    return out


class Names:
    """Names with their words in order, and each word once in order."""

    def __init__(self, names: list[str], known: np.ndarray):
        self.texts, parts = names, [split(n) for n in names]
        self.sets = [frozenset(w) for w in parts]
        self.plain, self.ordered, self.once = (Texts(t, known) for t in (names, [" ".join(sorted(w)) for w in parts], [" ".join(sorted(s)) for s in self.sets]))
        self.is_ordered = np.array([a == b for a, b in zip(names, self.ordered.texts, strict=True)], bool)
        self.is_once = np.array([a == b for a, b in zip(self.ordered.texts, self.once.texts, strict=True)], bool)


def word_set_ratio(a: Names, i: np.ndarray, b: Names, j: np.ndarray, sharing: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i))
    own = np.flatnonzero(~sharing)
    m, n = a.once.sizes[i[own]], b.once.sizes[j[own]]
    out[own] = np.where((m == 0) | (n == 0), 0.0, 100.0 - 100.0 * (m + n - 2 * common(a.once, i[own], b.once, j[own])) / np.maximum(m + n, 1))
    own = np.flatnonzero(sharing)
    pairs = [(a.sets[p], b.sets[q]) for p, q in zip(i[own], j[own], strict=True)]
    s = np.array([len(" ".join(p & q)) for p, q in pairs], np.int64)
    left, right = (Texts([" ".join(sorted(x)) for x in t], a.plain.letters) for t in ([p - q for p, q in pairs], [q - p for p, q in pairs]))
    at = np.arange(len(own))
    l1, l2 = s + 1 + left.sizes, s + 1 + right.sizes
    rest = 100.0 - 100.0 * (left.sizes + right.sizes - 2 * common(left, at, right, at)) / (l1 + l2)
    near = np.maximum(rest, np.maximum(100.0 - 100.0 * (l1 - s) / (s + l1), 100.0 - 100.0 * (l2 - s) / (s + l2)))
    out[own] = np.where((left.sizes == 0) | (right.sizes == 0), 100.0, near)
    return out


def steps(a: Names, i: np.ndarray, b: Names, j: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the pairs a[i], b[j] in bounded steps; those of long texts apart, as their steps take longer."""
    step = max(1, min(PAIRS, MARKS // (len(a.plain.letters) + 1)))
    wide = np.maximum(a.plain.sizes[i], b.plain.sizes[j]) > WIDE
    for rows in (np.flatnonzero(~wide), np.flatnonzero(wide)):
        for k in range(0, len(rows), step):
            yield rows[k : k + step]


def weighted_ratio(a: Names, i: np.ndarray, b: Names, j: np.ndarray) -> np.ndarray:
    """The weighted ratio of each pair a[i], b[j]."""
    out = np.zeros(len(i))
    for own in steps(a, i, b, j):
        out[own] = _weighted(a, i[own], b, j[own])
    return out


def ratio(x: Texts, i: np.ndarray, y: Texts, j: np.ndarray) -> np.ndarray:
    size = x.sizes[i] + y.sizes[j]
    return np.where(size > 0, 200.0 * common(x, i, y, j) / np.maximum(size, 1), 100.0)


def ratios(a: Names, i: np.ndarray, b: Names, j: np.ndarray) -> dict[str, np.ndarray]:
    """All of PARTS of each pair a[i], b[j], whatever their lengths."""
    out = {k: np.zeros(len(i)) for k in PARTS}
    for own in steps(a, i, b, j):
        for k, v in _ratios(a, i[own], b, j[own]).items():
            out[k][own] = v
    return out


def _ratios(a: Names, i: np.ndarray, b: Names, j: np.ndarray) -> dict[str, np.ndarray]:
    p, q = a.plain.sizes[i], b.plain.sizes[j]
    sharing = np.fromiter((not a.sets[x].isdisjoint(b.sets[y]) for x, y in zip(i, j, strict=True)), bool, len(i))
    blank = (a.ordered.sizes[i] == 0) | (b.ordered.sizes[j] == 0)
    plain, part, words = ratio(a.plain, i, b.plain, j), part_ratio(a.plain, i, b.plain, j), np.where(sharing, 100.0, 0.0)
    in_order, own = plain.copy(), np.flatnonzero(~(a.is_ordered[i] & b.is_ordered[j]))
    in_order[own] = ratio(a.ordered, i[own], b.ordered, j[own])
    own = np.flatnonzero(~sharing & ~blank & a.is_ordered[i] & b.is_ordered[j])
    words[own] = part[own]
    own = np.flatnonzero(~sharing & ~blank & ~(a.is_ordered[i] & b.is_ordered[j]))
    words[own] = part_ratio(a.ordered, i[own], b.ordered, j[own])
    own = np.flatnonzero(~sharing & ~blank & ~(a.is_once[i] & b.is_once[j]))
    words[own] = np.maximum(words[own], part_ratio(a.once, i[own], b.once, j[own]))
    word_set = word_set_ratio(a, i, b, j, sharing)
    longer = np.maximum(p, q) / np.maximum(np.minimum(p, q), 1)
    scale = np.where(longer <= FAR_LONGER, PART_SCALE, FAR_PART_SCALE)
    near, far = np.maximum(WORDS_SCALE * in_order, WORDS_SCALE * word_set), np.maximum(scale * part, WORDS_SCALE * scale * words)
    score = np.where((p == 0) | (q == 0), 0.0, np.maximum(plain, np.where(longer < LONG, near, far)))
    return dict(zip(PARTS, (plain, in_order, word_set, part, words, score), strict=True))


def _weighted(a: Names, i: np.ndarray, b: Names, j: np.ndarray) -> np.ndarray:
    p, q = a.plain.sizes[i], b.plain.sizes[j]
    some = (p > 0) & (q > 0)
    out = np.where(some, 200.0 * common(a.plain, i, b.plain, j) / np.maximum(p + q, 1), 0.0)
    longer = np.maximum(p, q) / np.maximum(np.minimum(p, q), 1)
    sharing = np.fromiter((not a.sets[x].isdisjoint(b.sets[y]) for x, y in zip(i, j, strict=True)), bool, len(i))

    own = np.flatnonzero(some & (longer < LONG))
    x, y = i[own], j[own]
    out[own] = np.maximum(out[own], WORDS_SCALE * word_set_ratio(a, x, b, y, sharing[own]))
    own = own[~(a.is_ordered[x] & b.is_ordered[y])]
    x, y = i[own], j[own]
    size = a.ordered.sizes[x] + b.ordered.sizes[y]
    out[own] = np.maximum(out[own], np.where(size > 0, WORDS_SCALE * (200.0 * common(a.ordered, x, b.ordered, y) / np.maximum(size, 1)), WORDS_SCALE * 100.0))

    own = np.flatnonzero(some & (longer >= LONG))
    x, y = i[own], j[own]
    scale = np.where(longer[own] <= FAR_LONGER, PART_SCALE, FAR_PART_SCALE)
    words = np.where(sharing[own], 100.0, 0.0)
    blank = (a.ordered.sizes[x] == 0) | (b.ordered.sizes[y] == 0)
    rest = np.flatnonzero(~sharing[own] & ~blank)
    words[rest] = part_ratio(a.ordered, x[rest], b.ordered, y[rest])
    rest = rest[~(a.is_once[x[rest]] & b.is_once[y[rest]])]
    words[rest] = np.maximum(words[rest], part_ratio(a.once, x[rest], b.once, y[rest]))
    out[own] = np.maximum(out[own], np.maximum(scale * part_ratio(a.plain, x, b.plain, y), WORDS_SCALE * scale * words))
    return out
