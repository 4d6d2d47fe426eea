"""A compressed index of word sequences: depth-limited BWT in a wavelet matrix.

``search`` streams sequences from right to left through it by backward search and keeps, at
every place, the interval of the rows that start with the next ``window`` words there.
All sequences advance together, so each step is a handful of array operations.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Bit vector with constant-time rank: 64-bit words and a count before each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros((n // 64 + 1) * 8, np.uint8)
        words[:len(packed)] = packed
        self.words = words.view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32 if n < 2 ** 31 else np.int64)
        self.zeros = n - int(ones.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        below = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(below)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = []
        for shift in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            bit = ((symbols >> shift) & 1).astype(bool)
            self.levels.append((shift, Bits(bit)))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.first = self._walk(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits in self.levels:
            ones = bits.rank1(i)
            i = np.where((c >> shift) & 1 == 1, bits.zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands before place i."""
        return self._walk(c, i) - self.first[c]


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, dense rank by value, number of values)."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate([[False], k[1:] != k[:-1]])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank, int(new.sum()) + 1


class FMIndex:
    """Over the concatenation of ``sequences`` (arrays of symbols from 1 on), each closed by 0.

    Rows are suffixes in the order of their first ``depth`` > ``window`` symbols, which is all
    that backward search of up to window + 1 symbols asks for.
    """

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray, window: int):
        self.window = window
        ends = np.cumsum([len(s) + 1 for s in sequences])
        text = np.zeros(int(ends[-1]), np.int64)
        owner = np.repeat(owners, np.diff(np.concatenate([[0], ends])))
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False
        text[inside] = np.concatenate(sequences)
        n, self.n_symbols = len(text), int(text.max()) + 1
        order, rank, kinds = _ranks(text)
        half, half_rank, h = 1, rank, 1
        while h <= window:
            if h <= window:
                half, half_rank = h, rank             # the largest power of two up to the window
            ahead = np.zeros(n, np.int64)
            ahead[:-h] = rank[h:] + 1 if h < n else 0
            order, rank, kinds = _ranks(rank * (n + 1) + ahead)
            h *= 2
        self.wavelet = WaveletMatrix(text[order - 1], self.n_symbols)
        counts = np.bincount(text, minlength=self.n_symbols)
        self.start = np.cumsum(counts) - counts       # rows that start with smaller symbols
        self.n = n
        # rows that share their first ``window`` symbols: two halves that overlap are equal
        shift = window - half
        tail = np.full(n, -1, np.int64)
        tail[:n - shift] = half_rank[shift:]
        a, b = half_rank[order], tail[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        self.run = np.cumsum(new) - 1
        self.run_lo = np.flatnonzero(new)
        self.run_hi = np.concatenate([self.run_lo[1:], [n]])
        self.lowest = np.minimum.reduceat(owner[order], self.run_lo)

    def search(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Per sequence (each one of the indexed) and window in it: the smallest owner of a
        sequence that has the window.

        The matching statistic is capped: a match of window + 1 symbols is cut back to the
        rows that share its first ``window``, so the interval is always the window's own."""
        lengths = np.array([len(s) for s in sequences])
        order = np.argsort(-lengths, kind="stable")
        ls = lengths[order]
        flat = np.concatenate([sequences[k] for k in order])
        base = np.cumsum(ls) - ls
        out = np.full(len(flat), -1, np.int64)
        sp, ep = np.zeros(len(ls), np.int64), np.full(len(ls), self.n, np.int64)
        matched = np.zeros(len(ls), np.int64)
        for t in range(int(ls[0]) if len(ls) else 0):
            m = int(np.searchsorted(-ls, -t, side="left"))            # sequences longer than t
            at = base[:m] + ls[:m] - 1 - t
            c = flat[at]
            lo = self.start[c] + self.wavelet.rank(c, sp[:m])
            hi = self.start[c] + self.wavelet.rank(c, ep[:m])
            if (hi <= lo).any():
                raise ValueError("a streamed sequence is not in the index")
            grown = matched[:m] + 1
            full = grown >= self.window
            run = self.run[lo[full]]
            lo[full], hi[full] = self.run_lo[run], self.run_hi[run]
            grown[full] = self.window
            out[at[full]] = self.lowest[run]
            sp[:m], ep[:m], matched[:m] = lo, hi, grown
        found = [None] * len(sequences)
        for k, o in enumerate(order):
            found[o] = out[base[k]:base[k] + max(0, ls[k] - self.window + 1)]
        return found
