"""Literal versions of the contracts."""

from __future__ import annotations

import collections
import hashlib
import re

from .conftest import LOWER

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def components(rows):
    sets = {}
    for i, t in rows:
        w = SPACED.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def byte_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def word_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = SPACED.findall(t or "")
        gone = [0] * len(w)
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            if k in seen:
                gone[p : p + length] = [1] * length
            seen.add(k)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def leaks(rows, items, window):
    phrases = collections.defaultdict(set)
    for key, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            phrases[tuple(w[j : j + n])].add(key)
    out = {}
    for i, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = [0] * len(w), set()
        for n in {len(p) for p in phrases}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in phrases:
                    hit[j : j + n] = [1] * n
                    found |= phrases[tuple(w[j : j + n])]
        names = sorted(str(k) for k in found if k is not None)
        out[i] = (len(w), sum(hit), len(names), sha(",".join(names)), sum(hit) > 0)
    return out
