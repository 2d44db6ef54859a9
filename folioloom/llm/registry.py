"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import bpe, decontaminate, jaccard_join, license_scan, neighbours, oracles, quality, substring_dedup, suffix_dedup, toxicity, url_filter

QUERIES: dict[str, Callable] = {
    "op1_ngram_jaccard_join": jaccard_join.op1_ngram_jaccard_join,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_suffix_array_dedup": suffix_dedup.op3_suffix_array_dedup,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_bpe": bpe.op6_bpe,
    "op7_quality": quality.op7_quality,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_permutation_neighbours": neighbours.op9_permutation_neighbours,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

#: The others are learnt, follow a vocabulary, or add what their method finds, which SQL cannot express; op3 in SQL takes minutes and gigabytes even at sf0.01.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": oracles.JACCARD.strip(),
    "op5_decontaminate": oracles.LEAKS.strip(),
    "op10_substring_dedup": oracles.SUBSTRINGS.strip(),
}
