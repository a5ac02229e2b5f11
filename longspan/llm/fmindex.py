"""A compressed full-text index over word ids: Burrows-Wheeler transform in a wavelet matrix with rank bitmaps.

Suffixes are sorted to a bounded depth, by prefix doubling; backward search is exact for patterns up to it.  Of the sorted
suffixes only what answers need is kept: the wavelet matrix, where each block of rows that agree begins, and the least level
in it; the suffix array itself goes when the index is made.
Matching statistics of many sequences are computed together, one word to the left at a time: an interval of
``depth`` words is extended to ``depth`` + 1 and widened again to the rows that agree in ``depth`` words.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bitmap with constant-time rank: 64-bit words and a running count before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[int, Bits, int]] = []
        rest = symbols
        for shift in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bit = (rest >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            rest = np.concatenate([rest[~bit], rest[bit]])
        # where each symbol's run begins at the bottom
        self.first = np.zeros(size + 1, np.int64)
        self.first[:size] = self._descend(np.arange(size), np.zeros(size, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self._descend(symbol, at) - self.first[symbol]


class FMIndex:
    """Index of ``text`` (ids from 1; 0 separates sequences), for patterns up to ``depth`` + 1 ids without 0.

    ``level`` is a number of each place; ``least`` tells the least of a block's places.
    """

    def __init__(self, text: np.ndarray, depth: int, level: np.ndarray | None = None):
        n = len(text)
        self.depth = depth
        rank, reach = text.astype(np.int64), 1
        ranks = {1: rank}
        while reach <= depth:  # ranks of prefixes of 1, 2, 4, ... words
            ahead = np.zeros(n, np.int64)
            ahead[: n - reach] = rank[reach:] + 1 if n > reach else 0
            key = rank * (n + 2) + ahead
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0) - 1
            reach *= 2
            ranks[reach] = rank
        self.rows = n
        self.size = int(text.max(initial=0)) + 1
        self.wavelet = WaveletMatrix(text[order - 1], self.size)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.size))])
        # rows that agree in ``depth`` words: two overlapping prefixes of a power of two
        part = 1 << (depth.bit_length() - 1)
        early = ranks[part][order]
        late = np.full(n, -1, np.int64)
        inside = order + depth - part < n
        late[inside] = ranks[part][order[inside] + depth - part]
        fresh = np.ones(n, bool)
        fresh[1:] = (early[1:] != early[:-1]) | (late[1:] != late[:-1])
        self.starts = np.append(np.flatnonzero(fresh), n)
        self.least = np.minimum.reduceat((np.arange(n) if level is None else level)[order], self.starts[:-1]) if n else np.zeros(0, np.int64)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: rows that begin with the symbol and go on as the interval's."""
        base = self.less[symbol]
        return base + self.wavelet.rank(symbol, low), base + self.wavelet.rank(symbol, high)

    def matching_blocks(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, blocks): for every window of ``depth`` words inside the sequences ``text[begin:end]`` (each at
        least that long), the block of rows that agree with it, or -1 if the index holds no such words."""
        low, high = np.zeros(len(begin), np.int64), np.full(len(begin), self.rows)
        at, matched = end.copy(), np.zeros(len(begin), np.int64)
        live = np.arange(len(begin))
        places, blocks = [], []
        while len(live):
            at[live] -= 1
            c = text[at[live]]
            known = (c > 0) & (c < self.size)
            a, b = self.extend(np.where(known, c, 0), low[live], high[live])
            hit = known & (a < b)
            # a mismatch starts anew to the left of it: no window reaches over it
            low[live] = np.where(hit, a, 0)
            high[live] = np.where(hit, b, self.rows)
            matched[live] = np.where(hit, matched[live] + 1, 0)
            full = live[matched[live] >= self.depth]
            found = np.searchsorted(self.starts, low[full], "right") - 1
            low[full], high[full] = self.starts[found], self.starts[found + 1]
            matched[full] = self.depth
            places.append(at[full])
            blocks.append(found)
            live = live[at[live] > begin[live]]
        return np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *blocks])
