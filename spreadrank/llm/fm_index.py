"""FM-index over integer sequences: suffix array, wavelet matrix, sampled positions.

The text is a sequence of runs of symbols 1..sigma-1; symbol 0 stands before
each run and at the end and is never part of a pattern. Every suffix array
position that starts a run, and every ``SAMPLE``-th one besides, keeps its text
position, so that locating never walks over a 0.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorts all suffixes by prefix doubling; each 0 differs from every other 0."""
    n = len(text)
    zeros = text == 0
    key = text.astype(np.int64) + int(zeros.sum())
    key[zeros] = np.arange(int(zeros.sum()))
    # two symbols at once; what follows the last one, a 0, decides nothing
    both = (key << 32) | np.append(key[1:], 0)
    sa = np.argsort(both)
    first = np.ones(n, bool)
    first[1:] = both[sa][1:] != both[sa][:-1]
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, place, 0))
    h = 2
    while True:
        alone = first & np.append(first[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return sa
        s = sa[open_]
        both = (rank[s] << 32) | rank[s + h]  # s + h stays inside: equal suffixes end before a 0
        order = np.argsort(both)
        s, both = s[order], both[order]
        new = np.ones(len(s), bool)
        new[1:] = both[1:] != both[:-1]
        sa[open_] = s
        first[open_] = new
        rank[s] = np.maximum.accumulate(np.where(new, open_, 0))
        h *= 2


class Bits:
    """A bit vector with constant-time rank over 64-bit words."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position i."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int):
        self.n, self.sigma = len(text), sigma
        sa = suffix_array(text)
        bwt = text[sa - 1]  # the text begins with a 0, so that row's symbol is not asked for
        self.count = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.count[1:])
        self.levels: list[tuple[int, Bits, int]] = []
        layer = bwt
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (layer >> shift) & 1
            self.levels.append((shift, Bits(bit), len(bit) - int(bit.sum())))
            layer = np.concatenate([layer[bit == 0], layer[bit == 1]])
        self.origin = self._down(np.arange(sigma), np.zeros(sigma, np.int64))
        marked = (bwt == 0) | (sa % SAMPLE == 0)
        self.marked = Bits(marked)
        self.kept = sa[marked].astype(np.int32)

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((c >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Times that symbol c occurs in the transform before row i."""
        return self._down(c, i) - self.origin[c]

    def symbol(self, row: np.ndarray) -> np.ndarray:
        c, i = np.zeros(len(row), np.int64), row
        for shift, bits, zeros in self.levels:
            one = bits.get(i).astype(bool)
            ones = bits.rank(i)
            i = np.where(one, zeros + ones, i - ones)
            c |= one.astype(np.int64) << shift
        return c

    def search(self, symbols: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns symbols[s:s + n], by backward search."""
        lo = np.zeros(len(starts), np.int64)
        hi = np.full(len(starts), self.n, np.int64)
        live = np.arange(len(starts))
        for k in range(n - 1, -1, -1):
            c = symbols[starts[live] + k]
            lo[live] = self.count[c] + self.rank(c, lo[live])
            hi[live] = self.count[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the rows, by walking back to a sampled one."""
        out, at, row = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy()
        steps = 0
        while len(at):
            done = self.marked.get(row).astype(bool)
            out[at[done]] = self.kept[self.marked.rank(row[done])] + steps
            at, row = at[~done], row[~done]
            c = self.symbol(row)
            row = self.count[c] + self.rank(c, row)
            steps += 1
        return out
