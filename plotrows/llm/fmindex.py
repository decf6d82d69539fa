"""A compressed full-text index over word sequences: wavelet matrix, backward search.

The indexed text is a list of symbol runs.  Suffixes are sorted by prefix doubling up
to the longest run; each run's end is a separator of its own, so the order is total.
The transform (the symbol before every suffix) is kept as a wavelet matrix: one packed
bit vector per bit of a symbol with a running count for every 64 bits, which answers
``rank`` in a few array operations.  All queries are vectors, so a step of the search
costs the same array operations for one pattern or for a million.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


class Bits:
    """A bit vector with constant-time counts of the ones before a position."""

    def __init__(self, bits: np.ndarray):
        raw = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        raw[: len(packed)] = packed
        self.words = raw.view(_U)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words)[:-1], dtype=np.int32)]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        return self.before[block] + np.bitwise_count(self.words[block] & ((_U(1) << (i & 63).astype(_U)) - _U(1)))


class Wavelet:
    """Symbols below 2 ** levels, as one bit vector per bit from the highest on."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        now = symbols
        for level in range(self.levels):
            bit = (now >> (self.levels - 1 - level)) & 1
            self.bits.append(Bits(bit.astype(bool)))
            one = bit.astype(bool)
            self.zeros.append(len(now) - int(one.sum()))
            now = np.concatenate([now[~one], now[one]])

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i of the text lies among the sorted symbols, seen from ``symbol``."""
        for level in range(self.levels):
            ones = self.bits[level].rank(i)
            i = np.where((symbol >> (self.levels - 1 - level)) & 1, self.zeros[level] + ones, i - ones)
        return i


def suffix_array(symbols: np.ndarray, separators: int, longest: int) -> np.ndarray:
    """Sorted suffixes; symbols below ``separators`` are all different, runs have up to ``longest`` symbols."""
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    n, depth = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while depth <= longest:
        after = np.zeros(n, np.int64)
        after[: max(0, n - depth)] = rank[depth:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = new
        depth *= 2
        if n and int(rank[order[-1]]) == n - 1:
            break
    return order


class FMIndex:
    """Index of symbol runs (1-based symbols); counts occurrences by backward search."""

    def __init__(self, runs: np.ndarray, offset: np.ndarray, size: int):
        """``runs``: symbols 1..size of all runs, one after the other; ``offset``: their limits."""
        n = len(offset) - 1
        self.size = size
        at = np.arange(n) + offset[1:]                       # places of the separators
        text = np.zeros(len(runs) + n, np.int64)
        inside = np.ones(len(text), bool)
        inside[at] = False
        text[inside] = runs + (n - 1)
        text[at] = np.arange(n)
        order = suffix_array(text, n, int(np.diff(offset).max(initial=0)) + 1)
        before = np.where(text[order - 1] >= n, text[order - 1] - (n - 1), 0)
        self.wavelet = Wavelet(before, size + 1)
        count = np.bincount(before, minlength=size + 1)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])  # suffixes that begin with a smaller symbol
        every = np.arange(size + 1)
        self.shift = first - self.wavelet.descend(every, np.zeros(size + 1, np.int64))
        self.length = len(text)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the patterns with ``symbol`` put in front."""
        both = self.wavelet.descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.shift[symbol]
        return both[: len(symbol)] + shift, both[len(symbol):] + shift

    def repeats(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray, least: int, times: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal stretches of the runs [start, end) of at least ``least`` symbols that occur ``times`` times.

        Backward search from a run's last symbol goes on while the range is large
        enough: the length reached is the matching statistic of that end.  A stretch
        [p + 1, e] that cannot be extended to p is reported if it is long enough; no
        longer one holds p and e, so the next end is e - 1, or p + least - 1 if that is
        smaller.  Returns (index of the run, first, limit) of the stretches.
        """
        run = np.flatnonzero(end - start >= least)
        stop, last = start[run], end[run] - 1
        place = last.copy()
        low, high = np.zeros(len(run), np.int64), np.full(len(run), self.length)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(run):
            new_low, new_high = self.extend(symbols[place], low, high)
            more = new_high - new_low >= times
            low, high = np.where(more, new_low, 0), np.where(more, new_high, self.length)
            place = np.where(more, place - 1, place)
            over = ~more | (place < stop)                    # this end's stretch is maximal: [place + 1, last]
            report = over & (last - place >= least)
            if report.any():
                found.append((run[report], place[report] + 1, last[report] + 1))
            low, high = np.where(over, 0, low), np.where(over, self.length, high)
            done = over & (place < stop)
            last = np.where(over, np.minimum(last - 1, place + least - 1), last)
            done |= over & (last - stop + 1 < least)
            place = np.where(over, last, place)
            if done.any():
                keep = ~done
                run, stop, last, place, low, high = (a[keep] for a in (run, stop, last, place, low, high))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))
