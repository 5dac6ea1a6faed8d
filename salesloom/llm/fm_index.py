"""A compressed full-text index over numbered words, searched backwards for many texts at a time.

The Burrows-Wheeler transform of the indexed texts is kept in a wavelet matrix: one bit vector per bit of a
word's number, with counts per 64 bits.  A search takes a text from its last word to its first and keeps the range
of suffixes that begin with what it has read; all texts of a batch take their steps together in numpy.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits with counts of ones before any place."""

    def __init__(self, bits: np.ndarray):
        room = -(-(len(bits) + 1) // 64) * 64
        self.words = np.packbits(np.concatenate([bits, np.zeros(room - len(bits), bool)]), bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype("int64")
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]])
        self.zeros = len(bits) - int(ones.sum())

    def ones(self, places: np.ndarray) -> np.ndarray:
        at = places >> 6
        part = self.words[at] & ((np.uint64(1) << (places & 63).astype("uint64")) - np.uint64(1))
        return self.before[at] + np.bitwise_count(part)


class WaveletMatrix:
    """Sequence of numbers; how often a number occurs before a place."""

    def __init__(self, values: np.ndarray, kinds: int):
        self.levels: list[BitVector] = []
        self.bits = max(1, (kinds - 1).bit_length())
        self.kinds = kinds
        for shift in range(self.bits - 1, -1, -1):
            bit = (values >> shift) & 1 == 1
            self.levels.append(BitVector(bit))
            values = np.concatenate([values[~bit], values[bit]])
        every = np.arange(kinds)
        self.starts = self._down(every, np.zeros(kinds, "int64"))

    def _down(self, values: np.ndarray, places: np.ndarray) -> np.ndarray:
        for shift, level in zip(range(self.bits - 1, -1, -1), self.levels):
            ones = level.ones(places)
            places = np.where((values >> shift) & 1 == 1, level.zeros + ones, places - ones)
        return places

    def rank(self, values: np.ndarray, places: np.ndarray) -> np.ndarray:
        return self._down(values, places) - self.starts[values]


def suffix_order(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the suffixes in order, by doubling, and ranks of all places by their first ``window`` and
    ``window - 1`` values.  Equal values at the ends of texts must not occur, so that all suffixes differ."""
    count = len(values)
    rank, length, by_window, by_less = values.astype("int64"), 1, None, None

    def ranked(first: np.ndarray, second: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
        further = np.zeros(count, "int64")
        further[:max(0, count - apart)] = second[apart:] + 1
        key = first * (int(second.max(initial=0)) + 2) + further
        order = np.argsort(key)
        new = np.cumsum(np.concatenate([[False], key[order][1:] != key[order][:-1]]))
        out = np.empty(count, "int64")
        out[order] = new
        return out, order

    order = np.argsort(rank, kind="stable")
    while True:
        if length <= window <= 2 * length and by_window is None:
            by_window, _ = ranked(rank, rank, window - length)
        if length <= window - 1 <= 2 * length and by_less is None:
            by_less, _ = ranked(rank, rank, window - 1 - length)
        if by_window is not None and by_less is not None and (not count or int(rank.max()) == count - 1):
            return order, by_window, by_less
        rank, order = ranked(rank, rank, length)
        length *= 2


class FmIndex:
    """Index of texts of numbered words (0 to ``kinds - 1``), for finding runs of ``window`` words."""

    def __init__(self, texts: np.ndarray, sizes: np.ndarray, kinds: int, window: int):
        """``texts``: all words of all texts, one text after the other; ``sizes``: words of each."""
        self.window, self.kinds = window, kinds
        ends = np.cumsum(sizes + 1) - 1
        body = np.ones(int(sizes.sum()) + len(sizes), bool)
        body[ends] = False
        # every text ends with a value of its own, below all words
        values = np.empty(len(body), "int64")
        values[body] = texts + len(sizes)
        values[~body] = np.arange(len(sizes))
        self.order, by_window, by_less = suffix_order(values, window)
        #: place of every word among all words and ends
        self.places = np.flatnonzero(body)
        symbols = np.where(body, values - len(sizes) + 1, 0)
        self.size = len(symbols)
        self.matrix = WaveletMatrix(symbols[self.order - 1], kinds + 1)
        counts = np.bincount(symbols, minlength=kinds + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])[:kinds + 1]
        self.group = self._groups(by_window[self.order])
        self.group_starts = np.flatnonzero(np.concatenate([[True], self.group[1:] != self.group[:-1]])) if self.size else np.zeros(0, "int64")
        less = self._groups(by_less[self.order])
        starts = np.flatnonzero(np.concatenate([[True], less[1:] != less[:-1]])) if self.size else np.zeros(0, "int64")
        self.less_start = starts[less] if self.size else starts
        self.less_end = np.append(starts[1:], self.size)[less] if self.size else starts

    @staticmethod
    def _groups(ranks: np.ndarray) -> np.ndarray:
        """Numbers of runs of equal ranks."""
        return np.cumsum(np.concatenate([[False], ranks[1:] != ranks[:-1]])) if len(ranks) else ranks

    def least(self, weights: np.ndarray) -> np.ndarray:
        """For every group of suffixes with equal windows the least of the weights (one per word or end) at their places."""
        return np.minimum.reduceat(weights[self.order], self.group_starts) if self.size else weights

    def step(self, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with a word before what the given ranges begin with."""
        both = self.matrix.rank(np.concatenate([words, words]) + 1, np.concatenate([low, high]))
        base = self.before[words + 1]
        return base + both[:len(words)], base + both[len(words):]

    def search(self, texts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For every word of the texts the group of the window that begins there, or -1 where the index has none.

        Words that the index does not know are -1.  Matching statistics cut at the window: a range that has reached
        ``window`` words gives up its last one before the next step; after a mismatch the search goes on one word
        further to the left, since whatever holds the failed run is out.
        """
        found = np.full(len(texts), -1, "int64")
        begins = np.cumsum(sizes) - sizes
        live = np.flatnonzero(sizes >= self.window) if self.size else np.zeros(0, "int64")
        begin = begins[live]
        right = begin + sizes[live] - 1
        at, low, high = right.copy(), np.zeros(len(live), "int64"), np.full(len(live), self.size, "int64")
        while len(at):
            words = texts[at]
            known = words >= 0
            low, high = self.step(np.where(known, words, 0), low, high)
            hit = known & (low < high)
            full = hit & (right - at + 1 == self.window)
            found[at[full]] = self.group[low[full]]
            missed = ~hit
            # a full range goes on as the range of its first window - 1 words
            shorter = low[full]
            low[full], high[full] = self.less_start[shorter], self.less_end[shorter]
            right = right - (full | missed)
            at = np.where(missed, right, at - 1)
            low[missed], high[missed] = 0, self.size
            going = right - begin + 1 >= self.window
            if not going.all():
                begin, right, at, low, high = begin[going], right[going], at[going], low[going], high[going]
        return found
