"""Texts that collide in sums of powers modulo 2^64 are different texts."""

from __future__ import annotations

import numpy as np
import pytest

from folioloom.llm import decontaminate, jaccard_join, substring_dedup, suffix_dedup
from folioloom.llm.textarrays import equal_spans, span_hashes

from . import brute


def thue_morse(n):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def result(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096])
def test_words_of_one_structure_hash_apart(n):
    x, y = thue_morse(n)
    data = np.frombuffer((x + y).encode(), np.uint8)
    start = np.array([0, n])
    for seed in range(4):
        a, b = span_hashes(data, start, start + n, seed)
        assert a != b
    assert not equal_spans(data, start[:1], start[1:], np.array([n]))[0]
    assert equal_spans(data, start[:1], start[:1], np.array([n]))[0]


@pytest.mark.parametrize("n", [1024, 2048])
def test_operators_tell_them_apart(spark, n):
    x, y = thue_morse(n)
    head, tail = " ".join(f"w{i}" for i in range(12)), " ".join(f"v{i}" for i in range(12))
    rows = [(1, f"{head} {x} {tail}"), (2, f"{head} {y} {tail}"), (3, x), (4, y), (5, f"{head} {x} {tail}")]
    items = [(1, f"w10 w11 {x} v0 v1"), (2, y)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    told = spark.createDataFrame(items, "item_id long, text string")
    assert result(jaccard_join.jaccard_components(df)) == brute.components(rows)
    words = substring_dedup.substring_dedup(df, length=10).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert result(words) == brute.word_repeats(rows, 10)
    assert result(suffix_dedup.suffix_array_dedup(df)) == brute.byte_repeats(rows, 100)
    hits = decontaminate.decontaminate(df, told, full=False).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert result(hits) == brute.leaks(rows, items, 10)


def test_sequences_of_words_of_one_structure(spark):
    """Thue-Morse over words, so that the hashes of long runs collide before they are compared."""
    x, y = thue_morse(2048)
    rows = [(1, " ".join(x)), (2, " ".join(y)), (3, " ".join(x[:700]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = substring_dedup.substring_dedup(df, length=300).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert result(words) == brute.word_repeats(rows, 300)
