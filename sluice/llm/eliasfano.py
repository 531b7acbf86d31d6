"""Elias-Fano sequences over numpy arrays that can be memory-mapped.

``n`` values that never fall, below ``universe``, take ``n`` packed low parts of
``log2(universe / n)`` bits and a bit vector of ``2 n`` bits or so whose runs code the high parts.
Access and search work on whole arrays of positions or values at once.
"""

from __future__ import annotations

import numpy as np

_SELECT = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    for _rank, _bit in enumerate([k for k in range(8) if _byte >> k & 1]):
        _SELECT[_byte, _rank] = _bit


def _words(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")


class EliasFano:
    """``arrays()`` is all that a stored sequence needs; ``EliasFano(**arrays)`` reads it back."""

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.head, self.low, self.high, self.ones = head, low, high, ones
        self.n, self.bits = int(head[0]), int(head[1])
        self.zeros = None

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        lows = values & np.uint64((1 << bits) - 1)
        packed = _words(((lows[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel())
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        vector = np.zeros(int(place[-1]) + 2 if n else 1, np.uint8)
        vector[place] = 1
        high = _words(vector)
        return cls(np.array([n, bits], np.int64), packed, high, np.cumsum(np.bitwise_count(high), dtype=np.uint32))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"head": self.head, "low": self.low, "high": self.high, "ones": self.ones}

    def _in_word(self, word: np.ndarray, rank: np.ndarray, flip: bool) -> np.ndarray:
        octets = np.ascontiguousarray(self.high[word]).view(np.uint8).reshape(-1, 8)
        octets = ~octets if flip else octets
        counts = np.bitwise_count(octets)
        upto = np.cumsum(counts, axis=1, dtype=np.uint8)
        rank = rank.astype(np.uint8)
        at = (upto <= rank[:, None]).sum(1, dtype=np.int64)
        flat = np.arange(0, 8 * len(at), 8) + at
        before = upto.ravel()[flat] - counts.ravel()[flat]
        return word * 64 + at * 8 + _SELECT[octets.ravel()[flat], rank - before]

    def _run(self, start: np.ndarray) -> np.ndarray:
        """How many ones follow from each bit position, up to 64."""
        word, off = start >> 6, (start & 63).astype(np.uint64)
        more = np.minimum(word + 1, len(self.high) - 1)
        window = (self.high[word] >> off) | np.where(off > 0, self.high[more] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        stop = ~window
        return np.bitwise_count((stop & (np.uint64(0) - stop)) - np.uint64(1)).astype(np.int64)

    def _select_one(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, side="right")
        before = np.where(word > 0, self.ones[np.maximum(word - 1, 0)], 0).astype(np.int64)
        return self._in_word(word, i - before, False)

    def _select_zero(self, i: np.ndarray) -> np.ndarray:
        if self.zeros is None:
            self.zeros = 64 * np.arange(1, len(self.ones) + 1, dtype=np.int64) - self.ones
        word = np.searchsorted(self.zeros, i, side="right")
        before = np.where(word > 0, self.zeros[np.maximum(word - 1, 0)], 0)
        return self._in_word(word, i - before, True)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word, off = at >> 6, (at & 63).astype(np.uint64)
        first = self.low[word] >> off
        rest = np.where(off > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(off, np.uint64(1))), np.uint64(0))
        return (first | rest) & np.uint64((1 << self.bits) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at positions ``i``."""
        i = np.asarray(i, np.int64)
        return ((self._select_one(i) - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value the first position that isn't below it (``n``: none), and whether it is equal there."""
        x = np.asarray(x, np.uint64)
        h = (x >> np.uint64(self.bits)).astype(np.int64)
        # Zeros past the stored runs lie in the padding; no high part is beyond the last one's run.
        top = int(self._select_one(np.array([self.n - 1]))[0]) - self.n + 1 if self.n else -1
        inside = h <= top
        g = np.where(inside, h, 0)
        bit = np.where(g > 0, self._select_zero(np.maximum(g - 1, 0)) + 1, 0)
        start = bit - g
        run = self._run(bit)
        long = np.flatnonzero(run == 64)
        if len(long):
            run[long] = self._select_zero(g[long]) - g[long] - start[long]
        stop = np.minimum(start + run, self.n)
        low = x & np.uint64((1 << self.bits) - 1)
        at = np.where(inside, start, self.n)
        stop = np.where(inside, stop, self.n)
        end = stop.copy()
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            middle = (at[open_] + end[open_]) >> 1
            less = self._low(middle) < low[open_]
            at[open_] = np.where(less, middle + 1, at[open_])
            end[open_] = np.where(less, end[open_], middle)
            open_ = open_[at[open_] < end[open_]]
        equal = at < stop
        here = np.flatnonzero(equal)
        equal[here] = self._low(at[here]) == low[here]
        return at, equal
