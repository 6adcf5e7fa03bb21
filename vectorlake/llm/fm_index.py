"""A compressed FM-index over word sequences, with vectorised backward search.

The Burrows-Wheeler transform of the words is held in a wavelet tree (its levels laid out as a matrix): one bit for each word and level,
packed 64 to a machine word, with a running count of ones for each.  ``rank`` walks the levels for many positions at once.

Suffixes are sorted by their first ``DEPTH`` words only.  A pattern of fewer words still owns one run of rows, and one
step of backward search maps its run to that of the longer pattern, so results are exact up to that length.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64


class WaveletTree:
    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        n = len(sequence)
        for level in range(self.levels - 1, -1, -1):
            bit = ((sequence >> level) & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            packed[: (n + 7) // 8] = np.packbits(bit, bitorder="little")
            words = packed.view("<u8")
            self.bits.append(words)
            self.ones.append(np.r_[0, np.cumsum(np.bitwise_count(words))[:-1]].astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[level][word] + np.bitwise_count(self.bits[level][word] & below)

    def rank(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before ``low`` and before ``high``."""
        count = len(symbols)
        at = np.concatenate([low, high])
        start = np.zeros(count, np.int64)
        both = np.concatenate([at, start])  # the symbol's own range start goes along
        for k in range(self.levels):
            one = ((symbols >> (self.levels - 1 - k)) & 1).astype(bool)
            ones = self._ones(k, both)
            one3 = np.concatenate([one, one, one])
            both = np.where(one3, self.zeros[k] + ones, both - ones)
        start = both[2 * count :]
        return both[:count] - start, both[count : 2 * count] - start


class FmIndex:
    """Index over ``text`` (int symbols >= 1; 0 separates sequences)."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        self.n = n
        self.ranks = [np.asarray(text, np.int64)]  # of the first 1, 2, 4, ... words at each place
        k = 1
        while k < DEPTH:
            now = self.ranks[-1]
            ahead = np.zeros(n, np.int64)
            ahead[: n - k] = now[k:] + 1
            key = now * (int(now.max(initial=0)) + 2) + ahead
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.empty(n, np.int64)
            fresh[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]]) if n else 0
            self.ranks.append(fresh)
            k *= 2
        self.suffixes = np.argsort(self.ranks[-1], kind="stable")
        before = np.where(self.suffixes > 0, self.suffixes - 1, n - 1)
        self.tree = WaveletTree(np.asarray(text, np.int64)[before], symbols)
        self.starts = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols))].astype(np.int64)
        self._common: np.ndarray | None = None
        self._edges: dict[int, np.ndarray] = {}

    def common(self) -> np.ndarray:
        """Words that neighbouring suffixes share, DEPTH at most; -1 at both ends."""
        if self._common is None:
            a, b = self.suffixes[:-1], self.suffixes[1:]
            shared = np.zeros(len(a), np.int64)
            for k in range(len(self.ranks) - 2, -1, -1):
                x, y = a + shared, b + shared
                inside = (x < self.n) & (y < self.n)
                same = np.zeros(len(a), bool)
                same[inside] = self.ranks[k][x[inside]] == self.ranks[k][y[inside]]
                shared += same * (1 << k)
            self._common = np.r_[-1, shared, -1]
            self.ranks = []
        return self._common

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the patterns with one more word in front."""
        a, b = self.tree.rank(symbols, low, high)
        first = self.starts[symbols]
        return first + a, first + b

    def widen(self, depth: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the patterns cut to their first ``depth`` words."""
        low, high = low.copy(), high.copy()
        for d in np.unique(depth):
            if d not in self._edges:
                self._edges[d] = np.flatnonzero(self.common() < d)
            edges, at = self._edges[d], depth == d
            low[at] = edges[np.searchsorted(edges, low[at], "right") - 1]
            high[at] = edges[np.searchsorted(edges, high[at], "left")]
        return low, high

    def repeated(self, ends: np.ndarray, lengths: np.ndarray, text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Streams sequences of the text, from their last word back, and returns (sequence, start) of each window with two or more places.

        For each place the longest match, ``window`` words at most, that occurs at least twice is carried along: one word
        in front, and while that occurs only here, fewer words at the back.
        """
        common = self.common()
        count = len(ends)
        low, high, size = np.zeros(count, np.int64), np.full(count, self.n, np.int64), np.zeros(count, np.int64)
        who, where = [], []
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero(lengths >= back)
            symbol = text[ends[live] - back]
            full = size[live] == window
            if full.any():
                f = live[full]
                low[f], high[f] = self.widen(np.full(len(f), window - 1), low[f], high[f])
                size[f] = window - 1
            pending, wanted = live, symbol
            while len(pending):
                a, b = self.extend(wanted, low[pending], high[pending])
                good = b - a >= 2
                g = pending[good]
                low[g], high[g] = a[good], b[good]
                size[g] += 1
                pending, wanted = pending[~good], wanted[~good]
                some = size[pending] > 0
                pending, wanted = pending[some], wanted[some]
                if len(pending):
                    depth = np.maximum(np.maximum(common[low[pending]], common[high[pending]]), 0)
                    low[pending], high[pending] = self.widen(depth, low[pending], high[pending])
                    size[pending] = depth
            found = live[size[live] == window]
            if len(found):
                who.append(found)
                where.append(lengths[found] - back)
        none = np.empty(0, np.int64)
        return (np.concatenate(who), np.concatenate(where)) if who else (none, none)
