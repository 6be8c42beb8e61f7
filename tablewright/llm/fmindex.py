"""FM-index over word ids in numpy: limited suffix sort, wavelet matrix ranks, sampled locate."""

from __future__ import annotations

import numpy as np

#: Every so many text positions a suffix position is kept.
SAMPLE_RATE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling; a shorter suffix comes before its extensions."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_text = text[order]
    rank[order] = np.cumsum(np.append(0, sorted_text[1:] != sorted_text[:-1]))
    width = 1
    open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1) if n else np.empty(0, np.int64)
    # ranks are made sparse, so that only suffixes that are still tied are sorted again
    first = np.searchsorted(sorted_text, text) if n else rank
    rank = first.astype(np.int64)
    while len(open_):
        after = np.where(open_ + width < n, rank[np.minimum(open_ + width, n - 1)] + 1, 0)
        by = np.lexsort((after, rank[open_]))
        tied, key, then = open_[by], rank[open_][by], after[by]
        head = np.append(True, key[1:] != key[:-1])
        fresh = head | np.append(True, then[1:] != then[:-1])
        begin = np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0))
        new = key + (at - begin)
        rank[tied] = new
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(by)))
        open_ = tied[np.repeat(sizes > 1, sizes)]
        width *= 2
    found = np.empty(n, np.int64)
    found[rank] = np.arange(n)
    return found


class WaveletMatrix:
    """Ranks and symbols of a sequence of numbers below 2**bits."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        row = sequence
        for level in range(bits - 1, -1, -1):
            bit = ((row >> level) & 1).astype(bool)
            count = np.zeros(len(row) + 1, np.int32)
            np.cumsum(bit, out=count[1:], dtype=np.int32)
            self.ones.append(count)
            self.zeros.append(len(row) - int(count[-1]))
            row = np.concatenate([row[~bit], row[bit]])

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before ``low`` and before ``high``, as an offset of its own run."""
        start = np.zeros(len(symbol), np.int64)
        for count, zeros, level in zip(self.ones, self.zeros, range(self.bits - 1, -1, -1)):
            bit = ((symbol >> level) & 1).astype(bool)
            down = lambda x: np.where(bit, zeros + count[x], x - count[x])  # noqa: B023, E731
            start, low, high = down(start), down(low), down(high)
        return low - start, high - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at these places, and how often each stands before its place."""
        symbol = np.zeros(len(at), np.int64)
        start = np.zeros(len(at), np.int64)
        for count, zeros in zip(self.ones, self.zeros):
            bit = count[at + 1] != count[at]
            symbol = symbol * 2 + bit
            at = np.where(bit, zeros + count[at], at - count[at])
            start = np.where(bit, zeros + count[start], start - count[start])
        return symbol, at - start


class FMIndex:
    """Index of a text of numbers 1 .. 2**bits - 1; 0 ends it."""

    def __init__(self, text: np.ndarray, bits: int, sample_rate: int = SAMPLE_RATE) -> None:
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text)
        self.wavelet = WaveletMatrix(text[order - 1], bits)  # the symbol before each suffix
        self.before = np.zeros((1 << bits) + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=1 << bits), out=self.before[1:])
        kept = order % sample_rate == 0
        self.kept = np.zeros(len(text) + 1, np.int32)
        np.cumsum(kept, out=self.kept[1:], dtype=np.int32)
        self.places = order[kept]
        self.size = len(text)

    def ranges(self, words: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns (stretches of ``words``), by backward search; empty ones have low >= high."""
        low = np.zeros(len(begin), np.int64)
        high = np.full(len(begin), self.size, np.int64)
        last = begin.astype(np.int64) + lengths - 1
        alive = np.arange(len(begin))
        for step in range(int(lengths.max()) if len(lengths) else 0):
            alive = alive[(low[alive] < high[alive]) & (lengths[alive] > step)]
            if not len(alive):
                break
            symbol = words[last[alive] - step].astype(np.int64)
            a, b = self.wavelet.rank(symbol, low[alive], high[alive])
            low[alive], high[alive] = self.before[symbol] + a, self.before[symbol] + b
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes by their places in the order: steps back to the nearest kept one."""
        found = np.empty(len(at), np.int64)
        left, steps, where = np.arange(len(at)), 0, at
        while len(left):
            kept = self.kept[where + 1] != self.kept[where]
            found[left[kept]] = self.places[self.kept[where[kept]]] + steps
            left, where = left[~kept], where[~kept]
            symbol, rank = self.wavelet.access(where)
            where = self.before[symbol] + rank
            steps += 1
        return found
