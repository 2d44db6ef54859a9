"""Suffix sorting by a difference cover, one suffix bucket at a time.

The cover {0, 1, 3, 9} modulo 13 has, for any two positions, an offset below 13 at
which both fall on it. The suffixes at cover positions are ranked first (prefix
doubling in steps of 13, so that a cover position meets cover positions only).
Then the wanted suffixes are sorted bucket by bucket of their leading bytes: by
their first 13 bytes, and where those tie, however long the tie, by the ranks at
the offset that the two have in common. Besides the ranks, only one bucket's keys
are in memory (after Burkhardt and Karkkainen 2003, and Karkkainen 2007).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .textarrays import U64, equal_spans, lanes

PERIOD = 13
COVER = (0, 1, 3, 9)
#: Suffixes sorted together; a bucket of equal leading bytes may exceed it.
BUCKET = 1 << 18

#: OFFSET[i, j]: the smallest d with i + d and j + d both on the cover.
OFFSET = np.array([[next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER) for j in range(PERIOD)] for i in range(PERIOD)])


def _word(text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each position as one big-endian number; `text` reaches beyond all of them."""
    return lanes(text)[at].byteswap() >> U64(8 * (8 - n))


def cover_ranks(text: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the suffixes at cover positions below n, each of its own. text: n bytes and 16 zeros at least.

    Beyond the end, suffixes are empty: they rank below all others, later ones first.
    """
    at = np.flatnonzero(np.isin(np.arange(PERIOD), COVER)[np.arange(n) % PERIOD])
    ranks = np.zeros(n + 2 * PERIOD, np.int64)
    ranks[n:] = -np.arange(2 * PERIOD)
    # Ranks are the number of suffixes known to be smaller, so a suffix without ties has its own for good.
    high = _word(text, at, 8)
    order = np.argsort(high, kind="stable")
    at, high = at[order], high[order]
    name = firsts(high[1:] != high[:-1])
    ranks[at] = name + 1
    step = 8
    while True:
        tied = np.append(name[1:] == name[:-1], False) | np.append(False, name[1:] == name[:-1])
        if not tied.any():
            return ranks
        at, name = at[tied], name[tied]
        if step == 8:
            key, step = _word(text, at + 8, PERIOD - 8).view(np.int64), PERIOD
        else:
            key, step = np.where(at + step < n, ranks[np.minimum(at + step, n)], n - at - step), 2 * step
        at, name = refined(at, name, key)
        ranks[at] = name + 1


def firsts(new: np.ndarray) -> np.ndarray:
    """For each of a sorted list, the place of the first that equals it."""
    i = np.arange(len(new) + 1)
    return np.maximum.accumulate(np.where(np.append(True, new), i, 0)) if len(i) else i


def refined(at: np.ndarray, name: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements in the order of (name, key), and their new names: the old one and how many of that name have smaller keys."""
    order = np.argsort((name << 32) + key) if key.max(initial=0) < 1 << 31 else np.lexsort((key, name))
    at, name, key = at[order], name[order], key[order]
    new_name = name[1:] != name[:-1]
    group = firsts(new_name)
    return at, name + firsts(new_name | (key[1:] != key[:-1])) - group


def sorted_buckets(text: np.ndarray, n: int, wanted: np.ndarray) -> Iterator[np.ndarray]:
    """The positions `wanted` in the order of their suffixes, in pieces that together are sorted and that no equal first two bytes cross."""
    if not len(wanted):
        return
    ranks = cover_ranks(text, n)
    lead = text[wanted].astype(np.int32) << 8 | text[wanted + 1]
    by_lead = np.argsort(lead, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(lead[by_lead])) + 1, len(wanted))
    a = 0
    while a < len(wanted):
        b = int(ends[max(np.searchsorted(ends, a, "right"), np.searchsorted(ends, a + BUCKET, "right") - 1)])
        yield _sorted_bucket(text, ranks, wanted[by_lead[a:b]])
        a = b


#: Suffixes that tie on the first PERIOD bytes are compared in pairs up to so many, and by residue beyond.
FEW = 8


def _sorted_bucket(text: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    high = _word(text, at, 8)
    order = np.argsort(high)
    at, high = at[order], high[order]
    same = high[1:] == high[:-1]
    tied = np.append(False, same) | np.append(same, False)
    where = np.flatnonzero(tied)
    if not len(where):
        return at
    # Ties on eight bytes by the next five, then by the ranks.
    group = np.cumsum(np.append(True, ~same)[where]).astype(U64)
    low = _word(text, at[where] + 8, PERIOD - 8)
    order = np.argsort(group << U64(40) | low) if group[-1] < 1 << 24 else np.lexsort((low, group))
    t, group, low = at[where][order], group[order], low[order]
    same = (group[1:] == group[:-1]) & (low[1:] == low[:-1])
    first = np.flatnonzero(np.append(True, ~same))
    count = np.diff(np.append(first, len(t)))
    place = np.repeat(first, count)
    few = np.repeat(count <= FEW, count)
    end = np.repeat(first + count, count)
    for step in range(1, min(FEW, int(count.max()))):
        i = np.flatnonzero(few[: len(t) - step] & (end[: len(t) - step] > np.arange(step, len(t))))
        x, y = t[i], t[i + step]
        d = OFFSET[x % PERIOD, y % PERIOD]
        less = ranks[x + d] < ranks[y + d]
        place[i + step] += less
        place[i] += ~less
    many = np.flatnonzero(~few)
    if len(many):
        place[many] += _within(ranks, t[many], np.cumsum(np.append(True, ~same))[many])
    done = np.empty_like(t)
    done[place] = t
    at[where] = done
    return at


def _within(ranks: np.ndarray, t: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How many suffixes of its group come before each: lists of one residue are in order by one rank, and any two lists meet at one offset."""
    residue = t % PERIOD
    lists = []
    for r in range(PERIOD):
        mine = np.flatnonzero(residue == r)
        lists.append(mine[np.argsort((group[mine] << 32) + ranks[t[mine] + OFFSET[r, r]], kind="stable")])
    place = np.zeros(len(t), np.int64)
    for i, a in enumerate(lists):
        for j, b in enumerate(lists):
            if len(a) and len(b):
                d = OFFSET[i, j]
                base = np.searchsorted(group[b], group[a])
                place[a] += np.searchsorted((group[b] << 32) + ranks[t[b] + d], (group[a] << 32) + ranks[t[a] + d]) - base
    return place


def equal_to_previous(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Whether each position's first `length` bytes equal those of the position before it in `at`."""
    out = np.zeros(len(at), bool)
    out[1:] = equal_spans(text, at[1:], at[:-1], np.full(len(at) - 1, length)) if len(at) else False
    return out
