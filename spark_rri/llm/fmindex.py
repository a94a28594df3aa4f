"""A compressed full-text index: the transformed text in a wavelet tree in the shape of a Huffman code.

The tree's bits are as many as the Huffman code of the text has, so frequent symbols cost few
of them and few steps. Nodes of a level lie side by side in the order of their code prefixes;
codes are canonical (shorter ones first), so the inner nodes of a level are consecutive numbers.
"""

from __future__ import annotations

import numpy as np

from .arrays import owners
from .huffman import canonical
from .repeats import suffix_ranks


class Bits:
    """A bit vector with ranks: 64-bit words and a count before each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class Wavelet:
    """Ranks of symbols in a sequence over 0 .. size - 1, every symbol of which occurs."""

    def __init__(self, sequence: np.ndarray, count: np.ndarray):
        self.code, self.size = canonical(count)
        leaf = np.argsort(self.size, kind="stable")  # in the order of codes
        total = np.concatenate([[0], np.cumsum(count[leaf])])
        self.levels: list[tuple[int, np.ndarray, np.ndarray, Bits]] = []
        for depth in range(int(self.size.max(initial=0))):
            low = int(np.searchsorted(self.size[leaf], depth, "right"))  # leaves above have ended
            prefix = self.code[leaf[low:]] >> (self.size[leaf[low:]] - depth)
            first = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
            start = np.append(total[low + first] - total[low], total[-1] - total[low])
            bit = (self.code[sequence] >> (self.size[sequence] - 1 - depth)) & 1
            bits = Bits(bit)
            ones = bits.ones(start)
            self.levels.append((int(prefix[0]), start[:-1].astype(np.int32), ones[:-1].astype(np.int32), bits))
            # within each node zeros come first, and either in their order
            node = owners(start)
            up = np.cumsum(bit) - bit - ones[node]
            place = np.arange(len(bit)) - start[node]
            zeros = (np.diff(start) - np.diff(ones))[node]
            new = np.empty_like(sequence)
            new[start[node] + np.where(bit == 1, zeros + up, place - up)] = sequence
            sequence = new[self.size[new] > depth + 1]

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place."""
        order = np.argsort(-self.size[symbol], kind="stable")
        size, code, r = self.size[symbol][order], self.code[symbol][order], place[order]
        for depth, (lead, start, ones, bits) in enumerate(self.levels):
            n = int(np.searchsorted(-size, -depth, "left"))
            if not n:
                break
            left = size[:n] - depth
            node = (code[:n] >> left) - lead
            up = bits.ones(start[node] + r[:n]) - ones[node]
            r[:n] = np.where((code[:n] >> (left - 1)) & 1, up, r[:n] - up)
        out = np.empty_like(r)
        out[order] = r
        return out


class FMIndex:
    """Weighs patterns in a text of numbers by backward search, for many patterns at once.

    weight says how much an occurrence that starts at a place of the text counts.
    """

    def __init__(self, symbols: np.ndarray, weight: np.ndarray):
        n = len(symbols)
        order, _ = suffix_ranks(symbols, np.array([0, n]))
        count = np.bincount(symbols)
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.heft = np.concatenate([[0], np.cumsum(weight[order])])
        self.bwt = Wavelet(symbols[order - 1], count)  # order 0 wraps to the text's last symbol

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after putting a symbol before each pattern."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return both[: len(low)] + self.first[symbol], both[len(low) :] + self.first[symbol]

    def matching(self, text: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
        """For each end: how far the text before it, up to ``most`` symbols, has a weight of 2 at least in the index."""
        got = np.zeros(len(end), np.int64)
        alive = np.arange(len(end))
        low, high = np.zeros(len(end), np.int64), np.full(len(end), int(self.first[-1]), np.int64)
        for t in range(1, most + 1):
            low, high = self.step(text[end[alive] - t], low, high)
            ok = self.heft[high] - self.heft[low] >= 2
            alive, low, high = alive[ok], low[ok], high[ok]
            if not len(alive):
                break
            got[alive] = t
        return got


def repeated_windows(index: FMIndex, text: np.ndarray, begin: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, window): windows of ``width`` that weigh at least 2 in the index, of runs given by first place and number.

    A window's statistic says where it stops matching; no window over that place can match, so the run goes on behind it.
    """
    at = np.zeros(len(begin), np.int64)
    live = np.flatnonzero(count > 0)
    runs, found = [], []
    while len(live):
        s = at[live]
        got = index.matching(text, begin[live] + s + width, width)
        hit = got == width
        at[live[~hit]] = (s + width - got)[~hit]
        own, s = live[hit], s[hit]
        # where a window repeats, the whole stretch behind it often does
        many = np.minimum(count[own] - s, width)
        more = np.flatnonzero(many > 1)
        reach = index.matching(text, begin[own[more]] + s[more] + many[more] - 1 + width, 2 * width - 1)
        many[more] = np.where(reach >= many[more] - 1 + width, many[more], 1)
        runs.append(np.repeat(own, many))
        found.append(np.repeat(s, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        at[own] = s + many
        live = live[at[live] < count[live]]
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(runs), np.concatenate(found)
