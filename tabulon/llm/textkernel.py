"""Whole-batch text kernels on code points: words, lines, and 64-bit hashes of any stretch.

Hashes are polynomial in the code points modulo 2**64, from prefix sums, so the hash of a stretch costs two
look-ups; a final mix spreads the bits.  They depend on the stretch alone, not on where it lies.  Different
stretches can have equal hashes (some texts are known for it), so whoever needs equality compares: ``same``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
#: Code points handled at a time: arrays of that length stay in a core's cache.
GROUP = 200_000


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for b in (_BASE, inverse):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n at least."""
    return _powers(max(1 << 18, 1 << (n - 1).bit_length() if n > 1 else 1))


def grouped(texts: list, limit: int = GROUP) -> Iterator[tuple[int, list[str]]]:
    """Consecutive runs of the texts (null: empty) of about ``limit`` code points, with their first index."""
    at, run, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > limit:
            yield at, run
            at, run, size = i, [], 0
        run.append(t)
        size += len(t)
    if run:
        yield at, run


class Texts:
    """A run of texts, end to end, as an array of code points; ``offsets`` has their bounds."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        self.data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.offsets = np.zeros(self.n + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.offsets[1:])
        self._sums = None

    def sums(self) -> np.ndarray:
        if self._sums is None:
            up, _ = powers(len(self.data))
            x = (self.data.astype(np.uint64) + np.uint64(1)) * _M3
            x ^= x >> np.uint64(29)
            x *= up[: len(x)]
            self._sums = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(x, out=self._sums[1:])
        return self._sums

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each stretch [start, end)."""
        s = self.sums()
        _, down = powers(len(self.data))
        return mix((s[ends] - s[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-32-le", "surrogatepass")

    def same(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
        """Whether the stretches [a, a_end) and [b, b_end) hold equal code points, for each pair."""
        n = a_end - a
        out = n == b_end - b
        todo = np.flatnonzero(out & (n > 0))
        reach = np.cumsum(n[todo])
        cuts = np.searchsorted(reach, np.arange(GROUP * 4, (reach[-1] if len(reach) else 0) + GROUP * 4, GROUP * 4), side="left") + 1
        for part in np.split(todo, np.unique(cuts[cuts < len(todo)])):
            if len(part):
                m = n[part]
                first = np.cumsum(m) - m
                step = np.arange(m.sum()) - np.repeat(first, m)
                equal = self.data[np.repeat(a[part], m) + step] == self.data[np.repeat(b[part], m) + step]
                out[part] = np.logical_and.reduceat(equal, first)
        return out

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flags (one for each code point) are set in each text."""
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.offsets[1:]] - c[self.offsets[:-1]]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, text index) of the maximal runs of set flags within each text."""
        bound = np.zeros(len(inside) + 1, bool)
        bound[self.offsets] = True
        before = np.empty(len(inside), bool)
        after = np.empty(len(inside), bool)
        if len(inside):
            before[0], after[-1] = False, False
            before[1:], after[:-1] = inside[:-1], inside[1:]
        starts = np.flatnonzero(inside & ~(before & ~bound[:-1]))
        ends = np.flatnonzero(inside & ~(after & ~bound[1:])) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1

    def blank(self) -> np.ndarray:
        """Code points that separate words: the space and 9 to 13."""
        return (self.data == 32) | ((self.data >= 9) & (self.data <= 13))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(~self.blank())


def windows(hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first index) of every k consecutive items of one owner."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(n, np.uint64)
    for i in range(k):
        acc *= _BASE
        acc += hashes[i : i + n]
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return mix(acc[at]), at


def twice(keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur more than once."""
    order = np.argsort(keys)
    s = keys[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.empty(len(s), bool)
    out[order] = same
    return out


def first_equal(keys: np.ndarray) -> np.ndarray:
    """For each key, the index of the first key equal to it."""
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return first[inverse]


def owned(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Keys equal for equal hashes of the same owner only."""
    return mix(hashes + (owner.astype(np.uint64) + np.uint64(1)) * _M3)
