from __future__ import annotations

import pytest

from folioloom.llm import substring_dedup, suffix_dedup

from . import brute


@pytest.mark.parametrize("hot", [0, 3])
def test_hot_minimisers_are_split_and_lose_nothing(documents, corpus, hot):
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.suffix_array_dedup(documents, length=37, hot=hot).collect()}
    assert got == brute.byte_repeats(corpus, 37)
    words = substring_dedup.substring_dedup(documents, length=7, hot=hot).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert {r[0]: tuple(r[1:]) for r in words.collect()} == brute.word_repeats(corpus, 7)
