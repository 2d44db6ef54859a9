"""An FM-index over a sequence of small integers, searched for many phrases at once."""

from __future__ import annotations

import numpy as np

from .suffixes import firsts, refined
from .textarrays import expand

#: Every so many positions of the text, the suffix array is kept.
SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence whose last value, 0, occurs nowhere else: prefix doubling in which only ties are sorted again."""
    n = len(text)
    at = np.argsort(text, kind="stable")
    name = firsts(text[at[1:]] != text[at[:-1]])
    rank = np.empty(n, np.int64)
    rank[at] = name
    step = 1
    while True:
        same = name[1:] == name[:-1]
        tied = np.append(False, same) | np.append(same, False)
        if not tied.any():
            break
        at, name = at[tied], name[tied]
        at, name = refined(at, name, rank[at + step])
        rank[at] = name
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class WaveletTree:
    """Ranks of any symbol in a sequence: one bit vector for each bit, highest first, zeros moved before ones at each level."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = sequence
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.append(0, np.cumsum(bit)).astype(np.int32))
            self.zeros.append(len(level) - int(bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        begin, end = np.zeros_like(at), at
        for i in range(self.bits):
            ones, zeros = self.ones[i], self.zeros[i]
            one = (symbol >> (self.bits - 1 - i)) & 1 == 1
            b, e = ones[begin], ones[end]
            begin, end = np.where(one, zeros + b, begin - b), np.where(one, zeros + e, end - e)
        return end - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol, place = np.zeros_like(at), at
        for i in range(self.bits):
            ones, zeros = self.ones[i], self.zeros[i]
            bit = ones[place + 1] - ones[place]
            symbol = symbol << 1 | bit
            place = np.where(bit == 1, zeros + ones[place], place - ones[place])
        return symbol


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        """text: values from 1 to symbols - 1; phrases hold such values, too."""
        whole = np.append(text, 0).astype(np.int64)
        order = suffix_array(whole)
        self.n = len(whole)
        self.tree = WaveletTree(whole[order - 1], symbols)
        self.before = np.append(0, np.cumsum(np.bincount(whole, minlength=symbols)))
        kept = order % SAMPLE == 0
        self.kept_before = np.append(0, np.cumsum(kept))
        self.kept = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array interval of each phrase (a row of `phrases`, filled from the left)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = live[(lengths[live] >= back) & (low[live] < high[live])]
            if not len(live):
                break
            c = phrases[live, lengths[live] - back]
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
            done = low[live] >= high[live]
            high[live[done]] = low[live[done]]
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array places, by walking back to a sampled one."""
        out = np.zeros(len(at), np.int64)
        steps = np.zeros(len(at), np.int64)
        live, place = np.arange(len(at)), at.copy()
        while len(live):
            known = self.kept_before[place + 1] > self.kept_before[place]
            hit = live[known]
            out[hit] = self.kept[self.kept_before[place[known]]] + steps[hit]
            live, place = live[~known], place[~known]
            if len(live):
                c = self.tree.access(place)
                place = self.before[c] + self.tree.rank(c, place)
                steps[live] += 1
        return out

    def occurrences(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of every occurrence."""
        low, high = self.search(phrases, lengths)
        count = high - low
        return np.repeat(np.arange(len(phrases)), count), self.locate(expand(low, count))
