"""Operator 3: suffix-array dedup of bytes, by difference-cover blockwise suffix sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _repeats
from .cluster import table, with_text
from .suffixes import equal_to_previous, sorted_buckets
from .textarrays import U64, Rolling, expand, lanes, mix, pieces, release, text_buffer

LENGTH = 100
GRAM = 16
SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


class Bytes(_repeats.Tokens):
    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.body, self.first = data, offs

    def grams(self) -> np.ndarray:
        at = lanes(self.body)[: max(0, len(self.body) - GRAM + 1)]
        return mix(at * U64(0x9E3779B97F4A7C15) + lanes(self.body)[8 : 8 + len(at)] * U64(0xC2B2AE3D27D4EB4F))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return Rolling(mix(np.arange(256, dtype=U64))[self.body]).of(start, end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return start, end


def equal_windows(length: int):
    """The `solve` of `_repeats` for bytes: suffixes of the packed strings are sorted, and equal beginnings of `length` bytes are neighbours."""

    def solve(text: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(text)
        padded = np.concatenate([text, np.zeros(length + 32, np.uint8)])
        windows = np.maximum(np.diff(offs) - length + 1, 0)
        at = expand(offs[:-1], windows)
        positions, kinds, seen = [], [], 0
        for part in sorted_buckets(padded, n, at):
            same = equal_to_previous(padded, part, length)
            kind = np.cumsum(~same) + seen
            many = same.copy()
            many[:-1] |= same[1:]
            positions.append(part[many])
            kinds.append(kind[many])
            seen += len(part)
        p = np.concatenate(positions) if positions else np.zeros(0, np.int64)
        string = np.searchsorted(offs, p, "right") - 1
        return string, p - offs[string], np.concatenate(kinds) if kinds else p

    return solve


def _result_kernel(length: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = _repeats.unzipped(batch.column("packed"))
            data, offs = text_buffer(text)
            lists = batch.column("repeats").to_pylist()
            removed, spans, shas = [], [], []
            for a, b in pieces(offs):
                piece, first = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                gone = _repeats.covered(lists[a:b], first, length)
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                inner = first[:-1][np.diff(first) > 0]
                opens[inner] = gone[inner]
                sums, starts = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(opens))
                removed.append(sums[first[1:]] - sums[first[:-1]])
                spans.append(starts[first[1:]] - starts[first[:-1]])
                kept = piece[~gone].tobytes()
                at = (first - sums[first]).tolist()
                shas += [hashlib.sha256(kept[i:j]).hexdigest() for i, j in zip(at, at[1:], strict=False)]
            removed_, spans_ = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (removed, spans))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offs), pa.int64()), pa.array(removed_, pa.int64()), pa.array(spans_, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        release()

    return kernel


def suffix_array_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, hot: int = _repeats.HOT) -> DataFrame:
    """Bytes of each document covered by a `length`-byte string that also starts earlier, counted, and what is left hashed.

    Earlier: in a document with a smaller key, or before in the same document.
    A null or empty text has no bytes and nothing removed; the same for texts
    shorter than `length`. Rows with the same key and text are one document and
    get the same result each; with the same key and different texts they are
    different documents, ordered by a hash of the text. Null keys come first.
    An empty table gives an empty table. Other columns are ignored.
    """
    return _repeats.repeated_windows(with_text(docs, text, key), Bytes, equal_windows(length), length, GRAM, hot).mapInArrow(_result_kernel(length), SCHEMA)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(table(spark, sf_dir, "documents"))
