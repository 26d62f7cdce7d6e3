"""Elias-Fano sequences over numpy arrays, queried in blocks."""

from __future__ import annotations

import numpy as np

ONE, FULL = np.uint64(1), ~np.uint64(0)


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """A non-decreasing sequence of unsigned 64-bit numbers as low bits, high bits in unary, and a rank directory.

    ``low`` has the low bits of every value side by side; ``high`` has a one for each value at (high part + index);
    ``ones`` counts the ones before each word of ``high``.
    """
    values = values.astype(np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    width = max(0, (top // max(n, 1)).bit_length() - 1)
    high = (values >> np.uint64(width)).astype(np.int64)
    bits = high + np.arange(n)
    size = (int(bits[-1]) if n else 0) // 64 + 2
    words = np.zeros(size * 8, np.uint8)
    np.bitwise_or.at(words, bits >> 3, (1 << (bits & 7)).astype(np.uint8))
    words = words.view(np.uint64)
    if size >= 1 << 25:
        raise ValueError("a sequence of this size is split into several files")
    ones = np.zeros(size + 1, np.uint32)
    np.cumsum(np.bitwise_count(words), out=ones[1:], dtype=np.uint32)
    low = np.zeros(n * width // 64 + 2, np.uint64)
    if width:
        part = values & np.uint64((1 << width) - 1)
        at = np.arange(n, dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        # Bits of different values never overlap, so sums are unions; values of one word are neighbours.
        first = np.flatnonzero(np.diff(word, prepend=-1))
        if n:
            low[word[first]] += np.add.reduceat(part << shift, first)
        spill = (shift + np.uint64(width)) > 64
        low[word[spill] + 1] += part[spill] >> (np.uint64(64) - shift[spill])
    return {"low": low, "high": words, "ones": ones, "shape": np.array([n, width], np.uint64)}


class EliasFano:
    """Access by index and successor search on the arrays of ``encode``, which may be memory-mapped."""

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.low, self.high, self.ones = parts["low"], parts["high"], parts["ones"]
        self.n, self.width = (int(x) for x in parts["shape"])

    def __len__(self) -> int:
        return self.n

    @staticmethod
    def _in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one (from 0) of each word."""
        word, k, place = word.copy(), k.astype(np.int64), np.zeros(len(word), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
            beyond = k >= count
            k -= np.where(beyond, count, 0)
            place += np.where(beyond, width, 0)
            word >>= np.where(beyond, np.uint64(width), np.uint64(0))
        return place

    def _select(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one of ``high``."""
        word = np.searchsorted(self.ones, k.astype(np.uint32), side="right") - 1
        return word * 64 + self._in_word(self.high[word], k - self.ones[word].astype(np.int64))

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of ``high``; beyond the last one, the end."""
        low, top = np.zeros(len(k), np.int64), np.full(len(k), len(self.high), np.int64)
        while len(low) and int((top - low).max()) > 1:
            middle = (low + top) >> 1
            before = middle * 64 - self.ones[middle].astype(np.int64)
            right = before <= k
            low, top = np.where(right, middle, low), np.where(right, top, middle)
        return low * 64 + self._in_word(~self.high[low], k - (low * 64 - self.ones[low].astype(np.int64)))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        upper = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | upper) & np.uint64((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the indices ``i``."""
        i = np.asarray(i, np.int64)
        return ((self._select(i) - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Index of the first value of at least ``x``, within [first, last] where given."""
        x = np.asarray(x, np.uint64)
        high = (x >> np.uint64(self.width)).astype(np.int64)
        most = len(self.high) * 64 - self.n - 1
        inside = np.minimum(high, most)
        begin = np.where(inside > 0, self._select_zero(np.maximum(inside - 1, 0)) - (inside - 1), 0)
        begin = np.where(high > most, self.n, begin)
        end = np.where(high > most, self.n, self._select_zero(inside) - inside)
        if first is not None:
            begin, end = np.maximum(begin, first), np.maximum(end, first)
        if last is not None:
            begin, end = np.minimum(begin, last), np.minimum(end, last)
        goal = x & np.uint64((1 << self.width) - 1)
        while len(begin) and bool((begin < end).any()):
            middle = (begin + end) >> 1
            less = (begin < end) & (self._low(np.minimum(middle, max(self.n - 1, 0))) < goal)
            begin, end = np.where(less, middle + 1, begin), np.where(less, end, np.maximum(middle, begin))
        return begin
