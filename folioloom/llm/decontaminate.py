"""Operator 5: benchmark decontamination with an FM-index for each shard of documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import record, schema_of, settled, table, with_text
from .fm_index import FMIndex
from .textarrays import ALNUM, LOWER, Words, binaries, equal_spans, expand, pieces, release, span_hashes, text_buffer

WINDOW = 10
#: Bytes of benchmark text whose phrases are broadcast together; more is searched in several rounds.
BLOCK_TEXT = 2 << 20
#: Bytes of documents that one index is made of; a longer document has an index of its own.
SHARD_TEXT = 4 << 20
CARRIED = "doc_id bigint, text string, hits binary, items array<string>"
SCHEMA = "doc_id bigint, text string, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, kept string"


@dataclass
class Phrases:
    """Distinct windows of a block of benchmark items, as symbols from 2 on; 1 separates documents."""

    seed: int
    hashes: np.ndarray  # of the words, sorted; the i-th is symbol i + 2
    body: np.ndarray  # bytes of the words
    begin: np.ndarray
    size: np.ndarray
    symbols: np.ndarray  # a row for each phrase
    lengths: np.ndarray
    owner: np.ndarray  # items of phrase p: owner[first[p]:first[p + 1]]
    first: np.ndarray
    items: list  # item ids as strings, or None


def vocabulary(data: np.ndarray, words: Words) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """A seed under which different words have different hashes; these, sorted, the first place of each, and each word's index among them."""
    seed = 8
    while True:
        h = span_hashes(data, words.start, words.end, seed)
        known, at, of = np.unique(h, return_index=True, return_inverse=True)
        size, lead = words.end - words.start, at[of]
        if (size == size[lead]).all() and equal_spans(data, words.start, words.start[lead], size).all():
            return seed, known, at, of
        seed += 1


def phrases(ids: list, texts: list, window: int) -> Phrases:
    data, offs = text_buffer(pa.array(texts, pa.string()))
    data = LOWER[data]
    words = Words(data, offs, ALNUM)
    seed, known, at, symbol = vocabulary(data, words)
    size = np.minimum(words.counts, window)
    count = np.where(words.counts > 0, words.counts - size + 1, 0)
    start = expand(words.first[:-1], count)
    item = np.repeat(np.arange(len(ids)), count)
    length = size[item]
    rows = np.zeros((len(start), window), np.int32)
    for i in range(window):
        has = length > i
        rows[has, i] = symbol[start[has] + i] + 2
    if len(rows):
        rows, of = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([of.ravel(), item], 1), axis=0)
    else:
        pairs = np.zeros((0, 2), np.int64)
    lengths = (rows > 0).sum(1)
    first = np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))
    sizes = words.end[at] - words.start[at]
    body = data[expand(words.start[at], sizes)]
    return Phrases(seed, known, body, np.cumsum(sizes) - sizes, sizes, rows, lengths, pairs[:, 1], first, [None if i is None else str(i) for i in ids])


def symbols(data: np.ndarray, words: Words, p: Phrases) -> tuple[np.ndarray, int]:
    """The symbol of each word, and how many symbols there are. A word of the phrases has theirs if its bytes are the same; others have symbols beyond."""
    size = words.end - words.start
    h = span_hashes(data, words.start, words.end, p.seed)
    at = np.minimum(np.searchsorted(p.hashes, h), len(p.hashes) - 1)
    known = (p.hashes[at] == h) & (p.size[at] == size)
    i = np.flatnonzero(known)
    known[i] = equal_spans(np.append(data, p.body), words.start[i], len(data) + p.begin[at[i]], size[i])
    fresh, other = np.unique(h[~known], return_inverse=True)
    at[~known] = len(p.hashes) + other
    return at + 2, len(p.hashes) + len(fresh) + 2


def shard_hits(data: np.ndarray, offs: np.ndarray, words: Words, p: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each word of the shard is hit, and the distinct (document, item) pairs, from an index of all its words."""
    hit = np.zeros(len(words.start), bool)
    none = np.zeros(0, np.int64)
    if not len(p.symbols) or not len(words.start):
        return hit, none, none
    symbol, n = symbols(data, words, p)
    # document, separator, document, separator ...
    text, where = np.ones(len(symbol) + len(words.counts), np.int64), np.full(len(symbol) + len(words.counts), -1)
    place = np.arange(len(symbol)) + words.doc
    text[place], where[place] = symbol, np.arange(len(symbol))
    found, position = FMIndex(text, n).occurrences(p.symbols, p.lengths)
    word = where[position]
    cover = np.zeros(len(symbol) + 1, np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + p.lengths[found], -1)
    hit = np.cumsum(cover[:-1]) > 0
    count = p.first[found + 1] - p.first[found]
    doc = np.repeat(words.doc[word], count)
    owner = p.owner[expand(p.first[found], count)]
    if len(doc):
        doc, owner = np.unique(np.stack([doc, owner], 1), axis=0).T
    return hit, doc, owner


def cut(data: np.ndarray, offs: np.ndarray, words: Words, hit: np.ndarray) -> list[bytes]:
    """The documents without the spans of hit words that follow each other."""
    gone = np.zeros(len(data) + 1, np.int32)
    both = np.zeros(len(hit), bool)
    both[1:] = hit[1:] & hit[:-1] & (words.doc[1:] == words.doc[:-1])
    begin = np.where(both, np.append(0, words.end[:-1]), words.start)[hit]
    np.add.at(gone, begin, 1)
    np.add.at(gone, words.end[hit], -1)
    keep = np.cumsum(gone[:-1]) == 0
    sums = np.append(0, np.cumsum(keep))
    whole, at = data[keep].tobytes(), sums[offs].tolist()
    return [whole[a:b] for a, b in zip(at, at[1:], strict=False)]


def _kernel(block, last: bool, full: bool):
    def searched(part: pa.RecordBatch, p: Phrases) -> pa.RecordBatch:
        data, offs = text_buffer(part.column("text"))
        lower = LOWER[data]
        words = Words(lower, offs, ALNUM)
        hit, doc, owner = shard_hits(lower, offs, words, p)
        if "hits" in part.schema.names:
            before = b"".join(part.column("hits").to_pylist())
            hit = hit | (np.frombuffer(before, np.uint8) > 0)
            items = part.column("items").to_pylist()
        else:
            items = [[] for _ in range(part.num_rows)]
        for d, o in zip(doc.tolist(), owner.tolist(), strict=True):
            if p.items[o] is not None:
                items[d].append(p.items[o])
        items = [sorted(set(x)) for x in items]
        if not last:
            flags = hit.astype(np.uint8).tobytes()
            at = words.first.tolist()
            return record(part, ["doc_id", "text", "hits", "items"], [part.column("doc_id"), part.column("text"), binaries([flags[a:b] for a, b in zip(at, at[1:], strict=False)]), pa.array(items, pa.list_(pa.string()))])
        sums = np.append(0, np.cumsum(hit))
        n_hit = sums[words.first[1:]] - sums[words.first[:-1]]
        shas = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        kept = pa.array(cut(data, offs, words, hit), pa.binary()).cast(pa.string()) if full else pa.nulls(part.num_rows, pa.string())
        text = part.column("text") if full else pa.nulls(part.num_rows, pa.string())
        columns = [part.column("doc_id"), text, pa.array(words.counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(shas, pa.string()), pa.array(n_hit > 0), kept]
        return record(part, ["doc_id", "text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "kept"], columns)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = text_buffer(batch.column("text"))
            for a, b in pieces(offs, SHARD_TEXT):
                yield searched(batch.slice(a, b - a), block.value)
        release()

    return kernel


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", window: int = WINDOW, full: bool = True, carry: bool = False) -> DataFrame:
    """Words of each document inside an occurrence of a window of `window` consecutive words of a benchmark item.

    Words are runs of letters, digits and bytes beyond ASCII, A-Z lower-cased. An
    item with fewer words, but not none, is one window. Gives doc_id, n_words,
    n_hit, n_items, items_sha256, contaminated and, if `full`, text and kept (the
    text without the merged spans of hit words).

    A null or empty text has no words and stays as it is; items without words
    match nothing; items with a null id hit words but are not counted. Repeated
    items count once by id; repeated documents are judged each by itself. Empty
    tables: no documents give no rows, no items hit nothing. Other columns are
    ignored. Phrases are broadcast for BLOCK_TEXT bytes of benchmark at a time;
    what one round found is written before the next, so a benchmark of any size
    needs the memory of one block, and an index of each shard for each block.
    """
    rows = with_text(docs, text, key, carry)
    items = benchmark.select(F.col(f"`{item}`").cast("string").alias("id"), F.col(f"`{item_text}`").cast("string").alias("body")).distinct()
    total = items.agg(F.sum(F.octet_length("body"))).head()[0] or 0
    blocks = int(total // BLOCK_TEXT) + 1
    if blocks > 1:
        items = settled(items.withColumn("block", F.pmod(F.xxhash64("id", "body"), F.lit(blocks))).repartition("block").sortWithinPartitions("block"))
    context = docs.sparkSession.sparkContext
    for b in range(blocks):
        mine = items.where(F.col("block") == b) if blocks > 1 else items
        got = mine.select("id", "body").orderBy("id", "body").collect()
        block = context.broadcast(phrases([r[0] for r in got], [r[1] for r in got], window))
        last = b == blocks - 1
        rows = rows.mapInArrow(_kernel(block, last, full), schema_of(SCHEMA if last else CARRIED, rows))
        if not last:
            rows = settled(rows)
    return rows


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), full=False).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
