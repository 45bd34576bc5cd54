"""FM-index over a sequence of word ids: suffix array, wavelet matrix ranks, sampled positions.

Symbol 0 separates texts. Every separator sorts as a symbol of its own, so a comparison of two
suffixes ends at the next separator and sorting takes as many doublings as the longest run needs,
not the longest repeat. Patterns hold no 0.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; each 0 in ``s`` counts as a different symbol, in order of place."""
    n = len(s)
    zero = s == 0
    rank = s.astype(np.int64) + int(zero.sum())
    rank[zero] = np.arange(int(zero.sum()))
    h = 1
    while True:
        key = rank * (n + 1 + len(s))
        key[: n - h] += rank[h:] + 1 if h < n else 0
        sa = np.argsort(key, kind="stable")
        k = key[sa]
        new = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])]) if n else np.empty(0, np.int64)
        rank = np.empty(n, np.int64)
        rank[sa] = new
        if not n or new[-1] == n - 1 or h >= n:
            return sa
        h *= 2


class WaveletMatrix:
    """Ranks of symbols: one packed bit vector and its running counts for each bit of a symbol."""

    def __init__(self, s: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        s = s.astype(np.uint32)
        n = len(s)
        for k in reversed(range(self.bits)):
            b = (s >> np.uint32(k)) & np.uint32(1) == 1
            packed = np.packbits(b, bitorder="little")
            w = np.zeros(n // 64 + 1, np.uint64)
            w.view(np.uint8)[: len(packed)] = packed
            self.words.append(w)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(w).astype(np.int64))]))
            self.zeros.append(int(n - b.sum()))
            s = np.concatenate([s[~b], s[b]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        q, r = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[level][q] & ((np.uint64(1) << r) - np.uint64(1))
        return self.counts[level][q] + np.bitwise_count(low)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level in range(self.bits):
            one = (symbols >> (self.bits - 1 - level)) & 1 == 1
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo = np.where(one, self.zeros[level] + a, lo - a)
            hi = np.where(one, self.zeros[level] + b, hi - b)
        return hi - lo


class FMIndex:
    """Counts and places of patterns in one shard."""

    SAMPLE = 8

    def __init__(self, s: np.ndarray, top: int):
        """s: symbols with a 0 first and last and between texts; top: largest symbol."""
        sa = suffix_array(s)
        self.bwt = s[sa - 1]
        self.wavelet = WaveletMatrix(self.bwt, top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=top + 1))])
        keep = (sa % self.SAMPLE == 0) | (self.bwt == 0)  # texts' first symbols too: no step crosses a separator
        self.sampled = keep
        self.place = np.where(keep, sa, -1)[keep]
        self.slot = np.cumsum(keep) - 1

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns (right-aligned in the matrix), by backward search of all at once."""
        n, width = patterns.shape
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.bwt), np.int64)
        for step in range(width):
            on = np.flatnonzero((lengths > step) & (lo < hi))
            if not len(on):
                break
            c = patterns[on, width - 1 - step].astype(np.int64)
            lo[on] = self.first[c] + self.wavelet.rank(c, lo[on])
            hi[on] = self.first[c] + self.wavelet.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffix-array rows: step back until a sampled row."""
        row, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        while len(on := np.flatnonzero(~self.sampled[row])):
            c = self.bwt[row[on]].astype(np.int64)
            row[on] = self.first[c] + self.wavelet.rank(c, row[on])
            steps[on] += 1
        return self.place[self.slot[row]] + steps
