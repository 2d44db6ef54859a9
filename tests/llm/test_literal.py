"""Operators that learn, or add what their method finds, against literal versions of what they compute."""

from __future__ import annotations

import itertools
import random
import re
import time

import numpy as np
import pytest

from folioloom.llm import license_scan, quality, substring_dedup, toxicity
from folioloom.llm.textarrays import text_buffer

from . import brute
from .conftest import LOWER

WORDS = re.compile(r"[a-z\x80-￿]+")


def literal_kinds(text):
    """Kinds of matches of a text, by the rules of the grammar read word by word, in order."""
    classes = {w: c for c, ws in toxicity.CLASSES.items() for w in ws}
    out = []
    for clause in re.split(r"[.,;:!?\n|]", text.translate(LOWER)):
        words = WORDS.findall(clause)
        c = ["insult" if w in toxicity.INSULTS else classes.get(w, "other") for w in words]
        for i, k in enumerate(c):
            if k not in ("insult", "threat"):
                continue
            before, after = c[:i], c[i + 1 :]
            if k == "threat":
                near = after[: toxicity.REACH]
                if "target" not in near:
                    continue
                kind = "menace"
            else:
                kind = "epithet" if before and before[-1] in ("determiner", "insult") else "insult"
                if "target" in after:
                    kind = "aimed"
            if "negation" in before[-toxicity.REACH :]:
                kind = "denied"
            if "report" in before:
                kind = "quoted"
            elif kind in ("insult", "epithet") and "target" in before:
                kind = "aimed"
            out.append(kind)
    return out


def test_clauses_against_the_rules():
    rng = random.Random(6)
    pool = ["moron", "idiot", "kill", "destroy", "you", "they", "not", "never", "said", "the", "ein", "blue", "tree", "é", "lo"]
    texts = ["", "kill time", "kill you", "You, moron", "the idiot said you"] + ["".join(rng.choice(pool) + rng.choice([" ", " ", " ", ", ", ".\n"]) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    seeds = toxicity._word_hash(toxicity.INSULTS)
    insults = toxicity.Lookup(seeds, np.full(len(seeds), 1.0))
    names = list(toxicity.CLASSES)
    closed = toxicity.Lookup(np.concatenate([toxicity._word_hash(toxicity.CLASSES[c]) for c in names]), np.concatenate([np.full(len(toxicity.CLASSES[c]), 2 + j, np.int8) for j, c in enumerate(names)]))
    import pyarrow as pa

    data, offs = text_buffer(pa.array(texts))
    got = toxicity.clause_matches(data, offs, insults, closed, toxicity.Cascade())
    for t, row in zip(texts, got, strict=True):
        kinds = literal_kinds(t)
        assert row[: len(toxicity.KINDS)].tolist() == [kinds.count(k) for k in toxicity.KINDS], t
        assert row[-2] == (1 if {"aimed", "epithet", "insult"} & set(kinds) else 0)
        assert np.isclose(row[-1], np.log1p(len(WORDS.findall(t.translate(LOWER)))))


def test_labels_that_conflict_or_lack(spark):
    """The larger of two labels of one id holds; without both classes the words known beforehand decide, in patterns only."""
    long = "lo re mi " * 30_000
    rows = [(1, "you are a moron"), (2, "moron"), (3, "we kill time"), (4, "I will kill you"), (5, None), (None, ""), (6, long)]
    df = spark.createDataFrame([(*r, 0.5, True) for r in rows], "doc_id long, text string, score double, held_out boolean")
    for told in ([], [(6, 1, 0)], [(None, 1, 1), (5, None, None)]):
        labels = spark.createDataFrame(told, "doc_id long, quality int, toxic int")
        got = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
        assert [got[i].predicted for i in (1, 2, 3, 4, 5, None, 6)] == [1, 0, 0, 1, 0, 0, 0]
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    for name in ("toxic", "quality"):
        known, n = toxicity.labelled(df.select("doc_id", "text"), labels, name, toxicity.remainder(labels["doc_id"], 1) == 0)
        assert (n, [r.y for r in known.collect()]) == (1, [1])


def literal_expression(tokens):
    """(length, labels) of the longest expression that the tokens begin with, by trying every length."""

    def parses(ts):
        # or < and < with, by replacing what is recognised
        s = " ".join("i" if t not in ("(", ")", "and", "or", "with") else t for t in ts)
        while True:
            new = re.sub(r"\( i \)", "i", re.sub(r"i (?:and|or) i", "i", re.sub(r"i with i", "i", s)))
            if new == s:
                return s == "i"
            s = new

    for n in range(len(tokens), 0, -1):
        if parses(tokens[:n]):
            return n
    return 0


def literal_scan(text):
    low = (text or "").translate(LOWER)
    words = brute.ALNUM.findall(low)

    def places(phrase):
        p = phrase.split()
        return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]

    base = {p: places(p) for p in license_scan.BASE}
    starts = sorted(i for x in base.values() for i in x)
    base_labels = {license_scan.BASE[p] for p, x in base.items() if x}
    sure = [("base", x) for x in sorted(base_labels)]
    sure += [("notice", x) for x in sorted({label for p, label in license_scan.NOTICES.items() if places(p)})]
    found = set()
    for m in re.finditer(r"(?<![a-z0-9\x80-￿])(?:spdx-license-identifier|licensed under|released under)(?![a-z0-9\x80-￿])", low):
        rest = re.match(r"\s*:?\s*(?:the\b(?![.+-]))?\s*(.*)", low[m.end() :], re.S)[1].split()
        tokens = [t for r in rest for t in re.findall(r"[()]|[^()]+", r)]
        known = list(itertools.takewhile(lambda t: t in ("(", ")", "and", "or", "mit", "apache-2.0", "gpl-2.0", "isc"), tokens))
        n = literal_expression(known)
        found |= {license_scan.label_of(t) for t in known[:n]} - {None}
    sure += [("tag", x) for x in sorted(found)]
    doubt = np.prod([1 - license_scan.SURE[k] for k, _ in sure]) if sure else 1.0
    labels = sorted({x for _, x in sure})
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(labels)), 1 - doubt


def test_license_scan_against_a_literal_scan(spark):
    rng = random.Random(9)
    pool = "mit license MIT License gnu general public license apache cc by sa zero cc0 bsd é lo public domain".split() + ["cc by", "licence"]
    tags = ["SPDX-License-Identifier:", "licensed under", "Released under the"]
    tokens = ["mit", "Apache-2.0", "GPL-2.0", "ISC", "and", "or", "(", ")", "("]

    def piece():
        if rng.random() < 0.15:
            return rng.choice(tags) + " " + " ".join(rng.choice(tokens) for _ in range(rng.randrange(1, 8))) + " zz"
        return rng.choice(pool)

    texts = ["".join(piece() + rng.choice([" ", " ", "\n", ", ", "--"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [None, "", "mit license " * 300 + "licensed under MIT " * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        want, score = literal_scan(t)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want, t
        assert np.isclose(r.score, score)


def test_a_very_long_text_costs_in_proportion(spark):
    n = 100_000
    df = spark.createDataFrame([(1, "mit license " * n + "licensed under MIT. " * n)], "doc_id long, text string")
    began = time.perf_counter()
    r = license_scan.license_scan(df).collect()[0]
    assert time.perf_counter() - began < 30
    assert (r.n_words, r.n_base, r.first_word, r.last_word, len(r.expressions)) == (5 * n, n, 0, 2 * n - 2, n)


def test_alternatives_are_made_one_at_a_time():
    """An expression of exponentially many alternatives costs no more than those asked for, and its labels one pass."""
    text = " and ".join(["(gpl-1 or mit)"] * 3 + [f"(gpl-{i} or mit-{i})" for i in range(400)])
    tokens = license_scan.expression(text)
    postfix = license_scan.to_postfix(tokens)
    first = next(license_scan.alternatives(postfix))
    assert len(first) == 400 and license_scan.labels_of(postfix) == {"gpl", "mit"}
    assert license_scan.granted(postfix, frozenset(["mit"])) and not license_scan.granted(postfix, frozenset(["isc"]))
    nested = "(" * 150 + "mit" + ")" * 150 + " or " + "(" * 100 + "isc" + ")" * 100
    assert license_scan.labels_of(license_scan.to_postfix(license_scan.expression(nested))) == {"mit", "isc"}


@pytest.mark.parametrize("n", [0, 1, 3, 4, 255, 256, 257, 600, 3000])
def test_quality_against_a_literal_forward_pass(n):
    """Every filter at every step, the largest of each chunk, means and maxima over chunks, and the small network, one number at a time."""
    rng = np.random.Generator(np.random.PCG64(n))
    net = quality.Network.fresh(3)
    net.bias[:] = rng.normal(0, 0.1, quality.FILTERS)
    text = bytes(rng.integers(1, 256, n, dtype=np.uint8))
    halves = (n + quality.STEP + quality.HALF - 1) // quality.HALF
    body = np.frombuffer(text + bytes(halves * quality.HALF + quality.STEP - n), np.uint8)
    respond = []
    for at in range(0, halves * quality.HALF, quality.STEP):
        x = np.concatenate([net.embed[b] for b in body[at : at + 2 * quality.STEP]])
        respond.append(x @ np.concatenate([net.near, net.far]))
    half = [np.max(respond[i : i + quality.HALF // quality.STEP], axis=0) + net.bias for i in range(0, len(respond), quality.HALF // quality.STEP)]
    chunks = [np.maximum(np.maximum(a, b), 0) for a, b in zip(half, half[1:], strict=False)] or [np.maximum(half[0], 0)]
    v = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
    z = np.tanh(v @ net.hidden + net.hidden_bias) @ net.out + net.out_bias[0]
    other = np.frombuffer(b"some other text", np.uint8)
    data = np.concatenate([other, np.frombuffer(text, np.uint8), other])
    got = quality.scores(net, data, np.cumsum([0, len(other), n, len(other)]))
    assert np.isclose(got[1], 1 / (1 + np.exp(-z)), atol=1e-5)


def test_quality_without_labels_of_both_classes(spark):
    rows = [(i, "lo re mi " * (1 + 40 * i)) for i in range(4)] + [(None, None), (9, "x " * 200_000)]
    df = spark.createDataFrame([(*r, 0.1) for r in rows], "doc_id long, text string, score double")
    for told in ([], [(1, 1, 0)]):
        got = quality.quality(df, spark.createDataFrame(told, "doc_id long, quality int, toxic int")).collect()
        assert len({r.score for r in got}) == 1 and len(got) == 6
    assert quality.quality(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """With a hash that says nothing, the bytes decide."""
    monkeypatch.setattr(substring_dedup, "combine", lambda parts, k, seed: np.zeros(max(0, len(parts) - k + 1), np.uint64))
    texts = [b"a b c d", b"x a b c", b"b c d", b"q r"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    string, window, kind = substring_dedup.equal_windows(3)(data, np.cumsum([0, *map(len, texts)]))
    groups = {}
    for s, w, k in zip(string.tolist(), window.tolist(), kind.tolist(), strict=True):
        groups.setdefault(k, set()).add((s, w))
    assert sorted(sorted(g) for g in groups.values() if len(g) > 1) == [[(0, 0), (1, 1)], [(0, 1), (2, 0)]]
