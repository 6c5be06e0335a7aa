"""A compressed full-text index over words: wavelet matrix, backward search, matching lengths."""

from __future__ import annotations

import numpy as np


class Bits:
    """Bit vector in 64-bit words with one running count per word; rank is a count plus a population count."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def rank1(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int32)


class WaveletMatrix:
    """Rank of any symbol in a sequence, ``log2(symbols)`` bit vectors; no copy of the sequence is kept."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        current = values
        for level in range(self.levels - 1, -1, -1):
            bit = ((current >> level) & 1).astype(np.uint8)
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before ``low`` and before ``high``."""
        start = np.zeros(len(symbol), np.int64)
        for depth, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = ((symbol >> (self.levels - 1 - depth)) & 1).astype(bool)
            s, a, b = bits.rank1(start), bits.rank1(low), bits.rank1(high)
            start = np.where(one, zeros + s, start - s)
            low = np.where(one, zeros + a, low - a)
            high = np.where(one, zeros + b, high - b)
        return low - start, high - start


class FMIndex:
    """Index of a word sequence for patterns of up to ``longest`` words.

    Suffixes are sorted by prefix doubling until they differ or ``longest`` words are compared; that is the order
    backward search needs for patterns of that length. ``text`` holds numbers from 1; 0 ends the sequence.
    """

    def __init__(self, text: np.ndarray, longest: int):
        text = np.append(text, 0)
        self.symbols = int(text.max()) + 1
        rank, compared = text.astype(np.int64), 1
        while compared < longest:
            follow = np.zeros_like(rank)
            follow[: len(rank) - compared] = rank[compared:] + 1
            joined = rank * (int(rank.max()) + 2) + follow
            order = np.argsort(joined, kind="stable")
            ordered = joined[order]
            place = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty_like(rank)
            rank[order] = place
            compared *= 2
            if place[-1] == len(rank) - 1:
                break
        suffixes = np.argsort(rank, kind="stable")
        self.transform = WaveletMatrix(text[suffixes - 1], self.symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        self.size = len(text)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: rows of suffixes that start with ``symbol`` and then the pattern so far."""
        a, b = self.transform.ranks(symbol, low, high)
        start = self.first[symbol]
        return start + a, start + b

    def matches(self, text: np.ndarray, ends: np.ndarray, longest: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics: for each end (exclusive) in ``text``, how many words before it, ``longest`` at most,
        occur together at least ``least`` times in the index, and the rows of that match. All ends step together;
        an end whose match breaks takes no part in later steps."""
        length = np.zeros(len(ends), np.int64)
        lows, highs = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        alive = np.arange(len(ends))
        for step in range(1, longest + 1):
            at = ends[alive] - step
            alive = alive[at >= 0]
            symbol = text[ends[alive] - step]
            alive, symbol = alive[(symbol > 0) & (symbol < self.symbols)], symbol[(symbol > 0) & (symbol < self.symbols)]
            if not len(alive):
                break
            low, high = self.extend(symbol, lows[alive], highs[alive])
            good = high - low >= least
            alive = alive[good]
            lows[alive], highs[alive], length[alive] = low[good], high[good], step
        return length, lows, highs
