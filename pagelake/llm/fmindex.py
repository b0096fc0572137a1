"""FM-index over integer sequences: wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np

#: Masks of the bits below each bit of a word.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A bit vector with rank: 64-bit words and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.pad(bits, (0, -n % 64 + 64)), bitorder="little")
        self.words = packed.view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32)
        self.zeros = n - int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        w = at >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & _BELOW[at & 63])


class FMIndex:
    """Counts and finds patterns of at most ``depth`` symbols in ``text`` (non-negative ints).

    Suffixes are sorted by their first ``depth`` symbols or more, which is all
    that intervals of such patterns depend on.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.n = n = len(text)
        self.suffixes = self.sorted_suffixes(text, depth)
        last = text[self.suffixes - 1]  # the symbol before each suffix
        top = int(text.max()) + 1 if n else 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top))])
        self.levels: list[Bits] = []
        seq = last
        for bit in range(max(1, (top - 1).bit_length()) - 1, -1, -1):
            ones = (seq >> bit & 1).astype(np.uint8)
            self.levels.append(Bits(ones))
            seq = np.concatenate([seq[ones == 0], seq[ones == 1]])
        symbols = np.arange(top)
        self.start = self.path(symbols, np.zeros(top, np.int64))

    @staticmethod
    def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
        """Prefix doubling: ranks by 1, 2, 4, ... symbols; equal ones may come in any order."""
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
        order, span = np.argsort(rank), 1
        while span < depth:
            then = np.zeros(n, np.int64)
            then[:max(0, n - span)] = rank[span:]
            key = rank * (n + 2) + then
            order = np.argsort(key)
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[1], sorted_key[1:] != sorted_key[:-1]]))
            span *= 2
        return order

    def path(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a prefix of ``at`` symbols ends, sorted down to ``symbol``."""
        for i, bits in enumerate(self.levels):
            one = (symbol >> (len(self.levels) - 1 - i) & 1).astype(bool)
            r = bits.rank(at)
            at = np.where(one, bits.zeros + r, at - r)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of ``symbol`` followed by what [lo, hi) stands for."""
        base = self.first[symbol] - self.start[symbol]
        return base + self.path(symbol, lo), base + self.path(symbol, hi)

    def earlier(self, text: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
        """For each pattern of ``length`` symbols of the own text, that ends at ``ends``:
        whether it also starts somewhere before.

        Backward search from each end; patterns that no longer occur twice drop out.
        """
        found = np.zeros(len(ends), bool)
        live = np.arange(len(ends))
        lo, hi = self.first[text[ends]], self.first[text[ends] + 1]
        for step in range(length):
            if step:
                lo, hi = self.extend(text[ends[live] - step], lo, hi)
            twice = hi - lo > 1
            live, lo, hi = live[twice], lo[twice], hi[twice]
            if not len(live):
                return found
        spans, of = np.unique(lo, return_inverse=True)
        tops = np.zeros(len(spans), np.int64)
        tops[of] = hi
        edges = np.stack([spans, tops], axis=1).reshape(-1)
        least = np.minimum.reduceat(np.append(self.suffixes, self.n), edges)[::2]
        found[live] = least[of] < ends[live] - length + 1
        return found
