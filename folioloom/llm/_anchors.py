"""Anchor runs: how equal windows of different documents meet without sending each window.

Each window of `length` consecutive tokens has a minimiser, the k-gram in it with
the smallest hash (leftmost on ties). Windows in a row with the same minimiser
occurrence form a run; equal windows have equal minimisers, so they meet wherever
runs are brought together by the minimiser's hash.
"""

from __future__ import annotations

import numpy as np

from .textarrays import U64, sliding_min


def runs(gram: np.ndarray, first: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a piece of text.

    gram: hash of the k-gram from each token on (len(tokens) - k + 1 of them);
    first: first token of each document, and the number of tokens at the end.
    Gives, for each run, its first window, its number of windows, its minimiser's
    hash and its document.
    """
    none = np.zeros(0, np.int64)
    counts = np.diff(first)
    n = int(first[-1]) if len(first) else 0
    if n < length:
        return none, none, np.zeros(0, U64), none
    bits = max(1, int(n).bit_length())
    tagged = (gram >> U64(bits)) << U64(bits) | np.arange(len(gram), dtype=U64)
    low = sliding_min(tagged, length - k + 1)
    at = (low & U64((1 << bits) - 1)).astype(np.int64)
    fresh = np.ones(len(at), bool)
    fresh[1:] = at[1:] != at[:-1]
    valid = np.zeros(len(at) + 1, np.int32)
    has = counts >= length
    np.add.at(valid, first[:-1][has], 1)
    np.add.at(valid, first[1:][has] - length + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    fresh[first[:-1][has]] = True
    opens = np.flatnonzero(fresh & valid)
    edge = np.flatnonzero(fresh | ~valid)
    ends = np.append(edge, len(at))[np.searchsorted(edge, opens, "right")]
    return opens, ends - opens, gram[at[opens]], np.searchsorted(first, opens, "right") - 1
