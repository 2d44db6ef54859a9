"""Windows of consecutive tokens that also start earlier: the plan shared by substring and suffix-array dedup.

1. Each document is cut into super-k-mers (see `_anchors`): windows in a row that
   share a minimiser. Each travels as one packed string, with its place, to the
   bucket of its minimiser. Of equal strings of a batch the one at the first place
   travels; the others are repeats already and go straight to the bucket of their
   document, so that a string that a third of all rows contain comes to its
   minimiser once for each batch.
2. In a bucket, equal strings are told by their bytes, and all but the first are
   repeats. The different strings of a minimiser are sorted by `solve`, which
   compares their windows byte by byte. A minimiser with one string has nothing to
   compare. The repeats found go to the bucket of their document.
3. A document's repeats meet and are joined with its text.

A count of strings by minimiser comes first. A minimiser with very many different
strings is hot: its windows travel one by one, by their own hash, so no group is
larger than HOT, or than one string in 2^HOT_SHARE bytes of text.

Places are ordered by doc_id (null first), then two hashes of the text (128
bits), then the token. Rows with the same doc_id and text are one document; rows with the same
doc_id and different texts are different documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _anchors
from .cluster import by_key, exchanged, text_bytes
from .textarrays import U64, binaries, equal_spans, expand, mix, pack, pieces, release, span_hashes, text_buffer, unpack

NULL_ID = -(1 << 63)
#: Bytes of text that one bucket of strings is meant to come from; they take about three times as much.
BUCKET_TEXT = 8 << 20
#: Bytes of packed text that one sort takes; the strings of one minimiser stay together.
SORT_TEXT = 2 << 20
#: Strings of one minimiser beyond which its windows are dealt out one by one.
HOT, HOT_SHARE = 20_000, 24
#: Cells that a task gathers before it counts them.
HELD_CELLS = 1 << 21
IDS = ["doc", "dh", "dg"]
PACKED = "bucket int, blob binary"


class Tokens:
    """What a kind of token has to offer for a piece of text."""

    #: First token of each document, and the number of tokens.
    first: np.ndarray
    #: The text that strings are cut from.
    body: np.ndarray

    def grams(self) -> np.ndarray:
        raise NotImplementedError

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the tokens from start to end, which only brings equal ones together."""
        raise NotImplementedError

    def spans(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the body that the tokens from start to end take; equal token sequences have equal bytes."""
        raise NotImplementedError


def keyed(docs: DataFrame) -> DataFrame:
    """doc, dh and dg tell documents apart and are never null, so that joins keep every row. Where no two rows have one doc_id, it is enough."""
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    hashes = (F.xxhash64("text"), F.xxhash64(F.lit(1), "text")) if repeated else (F.lit(0).cast("long"),) * 2
    return docs.select("*", F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), hashes[0].alias("dh"), hashes[1].alias("dg"))


def _places(doc: np.ndarray, dh: np.ndarray, dg: np.ndarray, start: np.ndarray, *major: np.ndarray) -> np.ndarray:
    return np.lexsort((start, dg, dh, doc, *major[::-1]))


def _leaders(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each of x (sorted by class and place; `first` marks the first of a class), the first of its class."""
    return x[np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))] if len(x) else x


def _elsewhere(x: np.ndarray, y: np.ndarray, doc: np.ndarray, dh: np.ndarray, dg: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether x and y are different places; rows that repeat a document bring the same places again."""
    return (doc[x] != doc[y]) | (dh[x] != dh[y]) | (dg[x] != dg[y]) | (start[x] != start[y])


def _cell(mini: np.ndarray) -> np.ndarray:
    return (mini >> U64(32)).astype(np.uint32)


def _batches(buckets: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), binaries(blobs)], names=["bucket", "blob"])


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs, and where."""
    order = np.argsort(bucket, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if j > i:
            yield int(bucket[order[i]]), order[i:j]


def _cell_kernel(make: Callable, length: int, k: int, n: int) -> Callable:
    """How many different strings of a batch each cell of minimisers has."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        cell, count = np.unique(np.concatenate(held), return_counts=True)
        parts = list(_parts(cell % n))
        return _batches([b for b, _ in parts], [pack(cell[x], count[x].astype(np.uint32)) for _, x in parts])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offs = text_buffer(batch.column("text"))
            found = [np.zeros(0, U64)]
            for a, b in pieces(offs):
                t = make(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                at, windows, mini, _ = _anchors.runs(t.grams(), t.first, length, k)
                if len(at):
                    found.append(_cell(mini).astype(U64) << U64(32) | t.hashes(at, at + windows + length - 1) >> U64(32))
            held.append((np.unique(np.concatenate(found)) >> U64(32)).astype(np.uint32))
            size += len(held[-1])
            if size > HELD_CELLS:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)
        release()

    return kernel


def _hot_kernel(least: int) -> Callable:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in by_key(batches, ["bucket"]):
            cell, count = (np.concatenate(x) for x in zip(*(unpack(b) for b in group.column("blob").to_pylist()), strict=True))
            cell, of = np.unique(cell, return_inverse=True)
            hot = cell[np.bincount(of, count) > least]
            yield pa.RecordBatch.from_arrays([pa.array(hot.astype(np.int64), pa.int64())], names=["cell"])

    return kernel


def hot_cells(docs: DataFrame, make: Callable, length: int, k: int, hot: int, total: int) -> np.ndarray:
    """Cells of minimisers with more strings than `hot` and than one in 2^HOT_SHARE bytes of text, which are at most 2^HOT_SHARE (4 bytes each)."""
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total >> 26) + 1)
    counted = docs.select("text").mapInArrow(_cell_kernel(make, length, k, n), PACKED)
    rows = exchanged(counted, n).mapInArrow(_hot_kernel(max(hot, total >> HOT_SHARE)), "cell bigint").collect()
    return np.sort(np.array([r[0] for r in rows], np.uint32))


def _packed(got: list, body: np.ndarray, ids: list[np.ndarray], n: int) -> pa.RecordBatch:
    """Strings by bucket of minimiser, and from n on repeats by bucket of document."""
    key, h, of, start, windows, at, size = (np.concatenate(x) for x in zip(*got, strict=True))
    doc, dh, dg = (x[of] for x in ids)
    order = np.lexsort((h, key))
    same = (key[order][1:] == key[order][:-1]) & (h[order][1:] == h[order][:-1])
    many = np.append(False, same) | np.append(same, False)
    x = order[many]
    order[many] = x = x[_places(doc[x], dh[x], dg[x], start[x], key[x], h[x])]
    first = np.append(True, ~same)
    lead = _leaders(order, first)
    rest = np.flatnonzero(~first)
    a, b = order[rest], lead[rest]
    equal = size[a] == size[b]
    equal[equal] = equal_spans(body, at[a[equal]], at[b[equal]], size[a[equal]])
    first[rest[~equal]] = True
    later = a[equal]
    later = later[_elsewhere(later, b[equal], doc, dh, dg, start)]
    sent = np.sort(order[first])  # in the order of the documents, which packs well
    buckets, blobs = [], []
    for bucket, i in _parts(((key[sent] >> U64(40)) % U64(n)).astype(np.int64)):
        i = sent[i]
        buckets.append(bucket)
        blobs.append(pack(key[i].astype(np.uint32), doc[i], dh[i], dg[i], start[i].astype(np.uint32), windows[i].astype(np.uint32), size[i].astype(np.uint32), body[expand(at[i], size[i])], level=3))
    for bucket, blob in _found(doc[later], dh[later], dg[later], start[later], windows[later], n):
        buckets.append(n + bucket)
        blobs.append(blob)
    return _batches(buckets, blobs)


def _found(doc: np.ndarray, dh: np.ndarray, dg: np.ndarray, start: np.ndarray, windows: np.ndarray, n: int) -> Iterator[tuple[int, bytes]]:
    """Repeats, packed by bucket of document."""
    for bucket, x in _parts((mix(doc.view(U64) ^ dh.view(U64)) % U64(n)).astype(np.int64)):
        yield bucket, pack(doc[x], dh[x], dg[x], start[x].astype(np.uint32), windows[x].astype(np.uint32))


def _run_kernel(make: Callable, length: int, k: int, n: int, hot) -> Callable:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = hot.value
        for batch in batches:
            data, offs = text_buffer(batch.column("text"))
            got, bodies, base = [], [], 0
            for a, b in pieces(offs):
                t = make(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                at, windows, key, of = _anchors.runs(t.grams(), t.first, length, k)
                if not len(at):
                    continue
                if len(cells):
                    c = _cell(key)
                    warm = cells[np.minimum(np.searchsorted(cells, c), len(cells) - 1)] == c
                    single = expand(at[warm], windows[warm])
                    at, of, key = (np.append(x[~warm], y) for x, y in ((at, single), (of, np.repeat(of[warm], windows[warm])), (key, t.hashes(single, single + length))))
                    windows = np.append(windows[~warm], np.ones(len(single), np.int64))
                s, e = t.spans(at, at + windows + length - 1)
                got.append([key, t.hashes(at, at + windows + length - 1), a + of, at - t.first[of], windows, s + base, e - s])
                bodies.append(t.body)
                base += len(t.body)
            if got:
                ids = [batch.column(c).to_numpy(zero_copy_only=False) for c in IDS]
                yield _packed(got, np.concatenate(bodies), ids, n)
                del got, bodies
        release()

    return kernel


_REPEAT = np.dtype([("start", "<u4"), ("windows", "<u4")])


def _window_kernel(solve: Callable, n: int) -> Callable:
    """solve(text, offs): (string, window) of each window that occurs more than once, and its class; windows of a class are equal and follow each other."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), group in by_key(batches, ["bucket"]):
            blobs = group.column("blob").to_pylist()
            del group
            if bucket >= n:
                yield _batches([bucket - n] * len(blobs), blobs)
                continue
            for found in _bucket(blobs, solve, n):
                yield found
            del blobs
        release()

    return kernel


def _bucket(blobs: list[bytes], solve: Callable, n: int) -> Iterator[pa.RecordBatch]:
    parts = [unpack(b) for b in blobs]
    key = np.concatenate([p[0] for p in parts])  # half of the hash; minimisers that share it are one group
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    many = np.zeros(len(key), bool)
    many[order] = np.append(False, same) | np.append(same, False)
    # A minimiser with one string has nothing to compare; only the others are gathered.
    cut = np.append(0, np.cumsum([len(p[0]) for p in parts]))
    kept, texts = [], []
    for i, p in enumerate(parts):
        mine = many[cut[i] : cut[i + 1]]
        kept.append([x[mine] for x in p[:7]])
        begin = np.cumsum(p[6].astype(np.int64)) - p[6]
        texts.append(p[7][expand(begin[mine], p[6][mine])])
        parts[i] = None
    key, d, h, g, start, windows, size = (np.concatenate(x) for x in zip(*kept, strict=True))
    text = np.concatenate(texts)
    del parts, kept, texts
    if not len(key):
        return
    # Places as numbers: documents by rank, then the token.
    by = np.lexsort((g, h, d))
    new = np.append(True, (d[by][1:] != d[by][:-1]) | (h[by][1:] != h[by][:-1]) | (g[by][1:] != g[by][:-1]))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new) - 1
    lead = by[new]

    def found(place: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
        doc = lead[place >> 32]
        got = list(_found(d[doc], h[doc], g[doc], place & 0xFFFFFFFF, windows, n))
        return _batches([x for x, _ in got], [x for _, x in got])

    place = rank << 32 | start
    size = size.astype(np.int64)
    begin = np.cumsum(size) - size
    whole = span_hashes(text, begin, begin + size, 4)
    order = np.lexsort((place, whole, key))
    same = (key[order][1:] == key[order][:-1]) & (whole[order][1:] == whole[order][:-1])
    first = np.append(True, ~same)
    leader = _leaders(order, first)
    rest = np.flatnonzero(~first)
    x, y = order[rest], leader[rest]
    equal = size[x] == size[y]
    equal[equal] = equal_spans(text, begin[x[equal]], begin[y[equal]], size[x[equal]])
    first[rest[~equal]] = True
    x, y = x[equal], y[equal]
    x = x[place[x] != place[y]]  # rows that repeat a document bring the same places again
    if len(x):
        yield found(place[x], windows[x])
    order = order[first]
    same = key[order][1:] == key[order][:-1]
    order = order[np.append(False, same) | np.append(same, False)]
    total = np.cumsum(size[order])
    ends = np.append(np.flatnonzero(np.diff(key[order].view(np.int32)) != 0) + 1, len(order))
    a, done = 0, 0
    while a < len(order):
        b = int(ends[max(np.searchsorted(ends, a, "right"), np.searchsorted(total[ends - 1], done + SORT_TEXT, "right") - 1)])
        mine = order[a:b]
        string, window, kind = solve(text[expand(begin[mine], size[mine])], np.append(0, np.cumsum(size[mine])))
        at = place[mine[string]] + window
        if len(at):
            i = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
            least = np.repeat(np.minimum.reduceat(at, i), np.diff(np.append(i, len(at))))
            at = np.sort(at[at != least])
        if len(at):
            # windows in a row of one document become one repeat
            i = np.flatnonzero(np.append(True, at[1:] > at[:-1] + 1))
            last = np.append(i[1:], len(at)) - 1
            yield found(at[i], at[last] - at[i] + 1)
        a, done = b, int(total[b - 1])


def _doc_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, with its repeats."""
    for _, group in by_key(batches, ["bucket"]):
        doc, dh, dg, start, windows = (np.concatenate(x) for x in zip(*(unpack(b) for b in group.column("blob").to_pylist()), strict=True))
        order = np.lexsort((start, dg, dh, doc))
        doc, dh, dg = doc[order], dh[order], dg[order]
        repeats = np.empty(len(doc), _REPEAT)
        repeats["start"], repeats["windows"] = start[order], windows[order]
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (dh[1:] != dh[:-1]) | (dg[1:] != dg[:-1])))
        ends = np.append(new[1:], len(doc))
        for a in range(0, len(new), 20_000):
            i, j = new[a : a + 20_000], ends[a : a + 20_000]
            columns = [*(pa.array(x[i], pa.int64()) for x in (doc, dh, dg)), binaries([repeats[x:y].tobytes() for x, y in zip(i.tolist(), j.tolist(), strict=True)])]
            yield pa.RecordBatch.from_arrays(columns, names=[*IDS, "repeats"])
    release()


def _zip_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their texts packed, for an exchange."""
    codec = pa.Codec("zstd", 3)
    for batch in batches:
        bodies = [None if t is None else t.encode() for t in batch.column("text").to_pylist()]
        blobs = [None if t is None else len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in bodies]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(blobs, pa.binary())], names=[*names, "packed"])
    release()


def unzipped(column: pa.Array) -> pa.Array:
    """The texts that `_zip_kernel` packed."""
    codec = pa.Codec("zstd")
    return pa.array([None if b is None else codec.decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True) for b in column.to_pylist()], pa.binary()).cast(pa.string())


def repeated_windows(docs: DataFrame, make: Callable, solve: Callable, length: int, k: int, hot: int = HOT) -> DataFrame:
    """Each row of `docs` (doc_id, row if there is one), its text as `packed`, and `repeats`, its repeated windows as packed (start, windows), or null.

    make(data, offs) gives the Tokens of a piece of text.
    """
    docs = keyed(docs)
    spark = docs.sparkSession
    total = text_bytes(docs)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_TEXT + 1)
    cells = spark.sparkContext.broadcast(hot_cells(docs, make, length, k, hot, total))
    strings = docs.select(*IDS, "text").mapInArrow(_run_kernel(make, length, k, n, cells), PACKED)
    found = exchanged(strings, n).mapInArrow(_window_kernel(solve, n), PACKED)
    repeats = exchanged(found, n).mapInArrow(_doc_kernel, "doc bigint, dh bigint, dg bigint, repeats binary")
    others = [c for c in docs.columns if c != "text"]
    zipped = docs.select(*others, "text").mapInArrow(_zip_kernel, docs.select(*others).schema.add("packed", "binary"))
    return zipped.join(repeats, IDS, "left").drop(*IDS)


def covered(lists: list, first: np.ndarray, length: int) -> np.ndarray:
    """For each token of a piece, whether a repeated window covers it."""
    found = [np.frombuffer(x or b"", _REPEAT) for x in lists]
    n = int(first[-1])
    step = np.zeros(n + 1, np.int32)
    all_ = np.concatenate(found) if found else np.zeros(0, _REPEAT)
    at = np.repeat(first[:-1], [len(x) for x in found]) + all_["start"]
    np.add.at(step, at, 1)
    np.add.at(step, at + all_["windows"] + length - 1, -1)
    return np.cumsum(step[:n]) > 0
