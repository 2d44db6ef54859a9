"""Vectorised text primitives shared by the corpus operators.

An Arrow string column is one byte buffer with offsets. Everything here works on
that buffer with numpy, a few megabytes at a time, so no Python object is made
for a word, a shingle or a byte window.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that the kernels look at together. A longer document is taken alone.
CHUNK_BYTES = 1 << 20

#: White space of the contracts: space and the bytes 9 to 13.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~_SPACE
#: Bytes of "letters and digits" words: 0-9, a-z and every byte beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def release() -> None:
    """What a kernel does when its partition ends: workers live on, and give up their tables and the memory that is free."""
    Rolling.forget()
    trim()


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, starting at 0) of a string or binary column; null is empty."""
    trim()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if "binary" in str(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offs - offs[0]


def pieces(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most `limit` bytes together (one document at least)."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b
        a = b


class Words:
    """Words of a run of documents: byte ranges [start, end) and, for each document, its first word.

    A word is a maximal run of bytes in `table`; it never crosses documents.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, table: np.ndarray):
        inside = table[data]
        begin, end = inside.copy(), inside.copy()
        if len(data):
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            full = offs[1:] > offs[:-1]
            first, last = offs[:-1][full], offs[1:][full] - 1
            begin[first] |= inside[first]
            end[last] |= inside[last]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offs)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.counts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: MASKS[k] keeps the first k bytes of a little-endian word of eight.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Bytes from which on a span is hashed by itself, with a cryptographic digest.
LONG_SPAN = 2048


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number (zeros beyond the end)."""
    return np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each byte range, eight bytes at a time.

    Every step scrambles all that came before, so that texts do not collide by
    their structure, as they do in sums of powers modulo 2^64.
    """
    size = end - start
    at = lanes(data)
    h = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
    h = mix(h ^ at[start] & MASKS[np.minimum(size, 8)])
    live, step = np.flatnonzero((size > 8) & (size <= LONG_SPAN)), 8
    while len(live):
        left = size[live] - step
        h[live] = mix(h[live] ^ at[start[live] + step] & MASKS[np.minimum(left, 8)])
        live, step = live[left > 8], step + 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little"))
        h[i] = np.frombuffer(digest.digest(), U64)[0]
    return h


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes from a on are those from b on, for each pair."""
    at = lanes(data)
    same = np.ones(len(a), bool)
    live, step = np.flatnonzero(size > 0), 0
    while len(live):
        left = size[live] - step
        mask = MASKS[np.minimum(left, 8)]
        equal = (at[a[live] + step] ^ at[b[live] + step]) & mask == 0
        same[live[~equal]] = False
        live, step = live[equal & (left > 8)], step + 8
    return same


class Rolling:
    """Polynomial hashes modulo 2^64 of any range of a sequence of 64-bit values, by prefix sums.

    Different sequences with equal hashes can be made on purpose: these hashes
    only bring together what is then compared byte by byte. All share one base,
    and so one table of powers for each worker.
    """

    _tables: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, values: np.ndarray):
        n = len(values)
        powers, self.inverses = self.tables(n)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * powers[:n], out=self.sums[1:])

    @classmethod
    def forget(cls) -> None:
        cls._tables = None

    @classmethod
    def tables(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        got = cls._tables
        if got is None or len(got[0]) < n + 1:
            base = 0x2545F4914F6CDD1D
            size = max(n + 1, CHUNK_BYTES + CHUNK_BYTES // 4)

            def table(b: int) -> np.ndarray:
                x = np.full(size, b, U64)
                x[0] = 1
                return np.cumprod(x)

            got = table(base), table(pow(base, -1, 1 << 64))
            if size <= 2 * CHUNK_BYTES:
                cls._tables = got
        return got

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverses[start])

    def every(self, k: int) -> np.ndarray:
        """Hash of the k values from each position on."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[k:] - self.sums[:n]) * self.inverses[:n])


def byte_values(seed: int) -> np.ndarray:
    """A random odd 64-bit value for each byte."""
    return np.random.Generator(np.random.PCG64(1000 + seed)).integers(1 << 63, size=256, dtype=U64) * U64(2) + U64(1)


def byte_rolling(data: np.ndarray, seed: int) -> Rolling:
    return Rolling(byte_values(seed)[data])


def combine(parts: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each k consecutive values of `parts` (order counts)."""
    n = len(parts) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    m = mix(np.arange(1, k + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)
    out = np.zeros(n, U64)
    for i in range(k):
        out += parts[i : i + n] * m[i]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w consecutive values."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    y, size = x, 1
    while size * 2 <= w:
        y = np.minimum(y[:-size], y[size:])
        size *= 2
    return np.minimum(y[:n], y[w - size : w - size + n])


def expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + length), one range after the other."""
    length = length.astype(np.int64)
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start.astype(np.int64) - (ends - length), length)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed blob; `unpack` gives them back."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], np.int64).tobytes()
    raw = head + b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", level).compress(raw, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8), 8 * (1 + 2 * n), []
    for kind, length in head.reshape(-1, 2).tolist():
        dtype = np.dtype(chr(kind))
        out.append(np.frombuffer(raw, dtype, length, at))
        at += dtype.itemsize * length
    return out
