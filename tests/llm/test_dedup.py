from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioloom.llm import jaccard_join, substring_dedup, suffix_dedup
from folioloom.llm.suffixes import equal_to_previous, sorted_buckets

from . import brute


def result(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_jaccard_components(documents, corpus):
    assert result(jaccard_join.jaccard_components(documents)) == brute.components(corpus)


def test_jaccard_blocks_of_a_family(documents, corpus, monkeypatch):
    """Families that are cut into many blocks lose no link."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 300)
    assert result(jaccard_join.jaccard_components(documents)) == brute.components(corpus)


def test_jaccard_same_prefix_other_tail(spark):
    """Sets with the same size and prefix are one group, whose members are told apart and verified."""
    words = [f"w{i}" for i in range(44)]
    rows = [(i, " ".join([*words[:i], f"x{i}", *words[i + 1 :]])) for i in range(44)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard_join.jaccard_components(df)) == brute.components(rows)


def test_jaccard_repeated_rows_null_keys_and_empty_table(spark):
    t = "a b c d e f g"
    df = spark.createDataFrame([(3, t), (3, t), (2, t), (None, t), (3, "q r s t u v"), (9, None)], "doc_id long, text string")
    got = sorted(((r[0], r[1], r[2]) for r in jaccard_join.jaccard_components(df).collect()), key=str)
    assert got == sorted([(3, 3, 2), (3, 3, 2), (2, 3, 2), (None, 3, None), (3, 2, 3), (9, 0, 9)], key=str)
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("length", [100, 37])
def test_suffix_array_dedup(documents, corpus, length):
    assert result(suffix_dedup.suffix_array_dedup(documents, length=length)) == brute.byte_repeats(corpus, length)


@pytest.mark.parametrize("length", [20, 7])
def test_substring_dedup(documents, corpus, length):
    df = substring_dedup.substring_dedup(documents, length=length)
    assert result(df.select("doc_id", "n_words", "n_removed", "kept_sha256")) == brute.word_repeats(corpus, length)
    assert all(brute.sha(r.kept) == r.kept_sha256 for r in df.collect())


def test_repeated_rows_are_one_document(spark, corpus):
    t = corpus[0][1]
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (2, "short"), (None, None)], "doc_id long, text string")
    removed = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.substring_dedup(df).collect())
    n = len(t.split())
    assert removed == [(0, 0), (1, 0), (1, 0), (2, 0), (2, n)]
    bytes_ = sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.suffix_array_dedup(df).collect())
    assert bytes_ == [(0, 0), (1, 0), (1, 0), (2, 0), (2, len(t.encode()))]
    assert substring_dedup.substring_dedup(df.limit(0)).count() == suffix_dedup.suffix_array_dedup(df.limit(0)).count() == 0


def test_texts_with_one_32_bit_hash_are_different_documents(spark):
    base = " ".join(f"word{i}" for i in range(30)) + " "
    for key in (5, None):
        df = spark.createDataFrame([(key, base + "434"), (key, base + "274544")], "doc_id long, text string")
        assert df.select(F.hash("text")).distinct().count() == 1
        assert sorted(r.n_removed for r in substring_dedup.substring_dedup(df).collect()) == [0, 30]
        assert sorted(r.n_removed for r in suffix_dedup.suffix_array_dedup(df).collect()) == [0, len(base)]


@settings(max_examples=60, deadline=None)
@given(st.text("ab\0", min_size=1, max_size=300), st.integers(1, 5))
def test_suffixes_are_sorted(text, repeat):
    body = np.frombuffer((text * repeat).encode(), np.uint8)
    n = len(body)
    padded = np.concatenate([body, np.zeros(200, np.uint8)])
    got = [p for part in sorted_buckets(padded, n, np.arange(n)) for p in part.tolist()]
    whole = body.tobytes() + bytes(40)
    assert sorted(got) == list(range(n))
    keys = [whole[p : p + 30] for p in got]
    assert keys == sorted(keys)
    same = equal_to_previous(padded, np.array(got), 30)
    assert same.tolist() == [False] + [a == b for a, b in zip([padded[p : p + 30].tobytes() for p in got], [padded[p : p + 30].tobytes() for p in got][1:])]
