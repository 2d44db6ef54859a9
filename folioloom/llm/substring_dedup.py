"""Operator 10: substring dedup of words, by super-k-mer partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _repeats
from .cluster import record, schema_of, table, with_text
from .textarrays import NOT_SPACE, Rolling, Words, combine, equal_spans, expand, pieces, release, span_hashes, text_buffer

LENGTH = 20
GRAM = 4
NAMES = ["doc_id", "text", "n_words", "n_removed", "kept_sha256", "kept"]
SCHEMA = "doc_id bigint, text string, n_words bigint, n_removed bigint, kept_sha256 string, kept string"


class WordTokens(_repeats.Tokens):
    """Words; the body holds them in order, each followed by one space."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        words = Words(data, offs, NOT_SPACE)
        self.first = words.first
        self.values = span_hashes(data, words.start, words.end, 3)
        size = words.end - words.start + 1
        self.begin = np.append(0, np.cumsum(size))
        self.body = np.append(data, np.uint8(0x20))[expand(words.start, size)]
        self.body[self.begin[1:] - 1] = 0x20

    def grams(self) -> np.ndarray:
        return combine(self.values, GRAM, 5)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return Rolling(self.values).of(start, end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.begin[start], self.begin[end] - 1


def equal_windows(length: int):
    """The `solve` of `_repeats` for words: windows are sorted by a hash, and neighbours compared byte by byte."""

    def solve(text: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = Words(text, offs, NOT_SPACE)
        h = combine(span_hashes(text, words.start, words.end, 6), length, 6)
        at = expand(words.first[:-1], np.maximum(words.counts - length + 1, 0))
        order = np.argsort(h[at], kind="stable")
        at, h = at[order], h[at[order]]
        same = h[1:] == h[:-1]
        many = np.append(False, same) | np.append(same, False)
        at = at[many]
        fresh = np.append(True, ~same)[many]
        begin, size = words.start[at], words.end[at + length - 1] - words.start[at]
        # Words of a string are one space apart, so equal windows have equal bytes.
        i = np.flatnonzero(~fresh)
        equal = size[i] == size[i - 1]
        equal[equal] = equal_spans(text, begin[i[equal]], begin[i[equal] - 1], size[i[equal]])
        kind = np.cumsum(fresh)
        if not equal.all():
            kind = _told_apart(text, kind, np.unique(kind[i[~equal]]), begin, size)
            order = np.argsort(kind, kind="stable")
            at, kind = at[order], kind[order]
        string = words.doc[at]
        return string, at - words.first[string], kind

    return solve


def _told_apart(text: np.ndarray, kind: np.ndarray, mixed: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Classes of their own for the different windows of classes that one hash put together."""
    kind = kind.copy()
    fresh = int(kind.max()) + 1
    for k in mixed.tolist():
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(kind == k).tolist():
            window = text[begin[i] : begin[i] + size[i]].tobytes()
            if window not in seen:
                seen[window], fresh = fresh, fresh + 1
            kind[i] = seen[window]
    return kind


def _result_kernel(length: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = _repeats.unzipped(batch.column("packed"))
            data, offs = text_buffer(text)
            lists = batch.column("repeats").to_pylist()
            counts, removed, kept = [], [], []
            for a, b in pieces(offs):
                words = Words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], NOT_SPACE)
                gone = _repeats.covered(lists[a:b], words.first, length)
                sums = np.append(0, np.cumsum(gone))
                counts.append(words.counts)
                removed.append(sums[words.first[1:]] - sums[words.first[:-1]])
                # kept words, each followed by one space, as one buffer
                s, e = words.start[~gone], words.end[~gone]
                piece = np.append(data[offs[a] : offs[b]], np.uint8(0x20))
                body = piece[expand(s, e - s + 1)]
                ends = np.append(0, np.cumsum(e - s + 1))
                body[ends[1:] - 1] = 0x20
                at = ends[words.first - sums[words.first]].tolist()
                whole = body.tobytes()
                kept += [whole[i : max(i, j - 1)] for i, j in zip(at, at[1:], strict=False)]
            counts_, removed_ = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (counts, removed))
            shas = [hashlib.sha256(x).hexdigest() for x in kept]
            yield record(batch, NAMES, [batch.column("doc_id"), text, pa.array(counts_, pa.int64()), pa.array(removed_, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())])
        release()

    return kernel


def substring_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, hot: int = _repeats.HOT, carry: bool = False) -> DataFrame:
    """Words of each document covered by a window of `length` words that also starts earlier are removed.

    Gives doc_id, text (as it was), n_words, n_removed, kept_sha256 and kept (the
    words left, joined by one space), and `row` with `carry`. Earlier: in a document with a smaller key,
    or before in the same document; windows are judged on the input.

    A null or empty text, or one of white space, has no words and the empty
    string left. Rows with the same key and text are one document and get the
    same result each; with the same key and different texts they are different
    documents, ordered by a hash of the text. Null keys come first. An empty
    table gives an empty table. Other columns are ignored.
    """
    rows = with_text(docs, text, key, carry)
    return _repeats.repeated_windows(rows, WordTokens, equal_windows(length), length, GRAM, hot).mapInArrow(_result_kernel(length), schema_of(SCHEMA, rows))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
