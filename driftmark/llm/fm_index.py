"""An FM-index over integer symbols: suffix array, wavelet matrix ranks, sampled positions."""

from __future__ import annotations

import numpy as np

# Every so many positions of a run keep their place; the rest walk to the next one that does.
SAMPLE = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling until ranks are unique. A zero ends its run: zeros sort
    before all else, by position, so no comparison goes past one."""
    n = len(symbols)
    gaps = symbols == 0
    rank = np.where(gaps, np.cumsum(gaps) - 1, gaps.sum() - 1 + symbols.astype(np.int64))
    step = 1
    while True:
        following = np.zeros(n, np.int64)
        following[: n - step] = rank[step:] + 1
        following[gaps] = 0
        pair = rank * (int(rank.max(initial=0)) + n + 2) + following
        order = np.argsort(pair)
        ordered = pair[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = fresh
        if n == 0 or rank.max() == n - 1:
            return order
        step *= 2
        if step >= n:
            return np.argsort(rank)


class FmIndex:
    """Index of an array of symbols of ``[0, sigma]``; zeros part the runs, the last symbol is zero."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        n = len(symbols)
        order = suffix_array(symbols)
        last = symbols[order - 1].astype(np.int32)
        self.n, self.first = n, np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=sigma + 1))))
        # Wavelet matrix: level by level from the highest bit, zeros before ones, order kept.
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            ones = (last >> bit & 1).astype(bool)
            zeros_before = np.concatenate(([0], np.cumsum(~ones))).astype(np.int32)
            self.levels.append((bit, zeros_before, int(zeros_before[-1])))
            last = np.concatenate((last[~ones], last[ones]))
        # Sampled positions: the first of each run and every SAMPLE-th after it.
        begins = np.concatenate(([0], np.flatnonzero(symbols == 0)[:-1] + 1)) if n else np.zeros(0, np.int64)
        offset = np.arange(n) - np.repeat(begins, np.diff(np.concatenate((begins, [n]))))
        marked = (offset % SAMPLE == 0)[order]
        self.marked = marked
        self.marks_before = np.concatenate(([0], np.cumsum(marked))).astype(np.int32)
        self.places = order[marked]

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``upto`` of the transform."""
        begin = np.zeros_like(upto)
        for bit, zeros_before, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            upto = np.where(one, zeros + upto - zeros_before[upto], zeros_before[upto])
            begin = np.where(one, zeros + begin - zeros_before[begin], zeros_before[begin])
        return upto - begin

    def _symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for bit, zeros_before, zeros in self.levels:
            one = zeros_before[at + 1] == zeros_before[at]
            out |= one.astype(out.dtype) << bit
            at = np.where(one, zeros + at - zeros_before[at], zeros_before[at])
        return out

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases at once: rows of ``phrases`` filled up at the right. Gives
        the half-open range of suffixes that begin with each."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            symbol = phrases[live, lengths[live] - back]
            low[live] = self.first[symbol] + self.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: each walks back through the text to a sampled one."""
        rows = rows.astype(np.int64)
        out = np.zeros(len(rows), np.int64)
        walking, steps = np.arange(len(rows)), 0
        while len(walking):
            at = rows[walking]
            there = self.marked[at]
            out[walking[there]] = self.places[self.marks_before[at[there]]] + steps
            walking, at = walking[~there], at[~there]
            symbol = self._symbol(at)
            rows[walking] = self.first[symbol] + self.rank(symbol, at)
            steps += 1
        return out
