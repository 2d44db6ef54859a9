from __future__ import annotations

import random

import numpy as np
import pytest
from tokenizers import Tokenizer as Library

from folioloom.llm import bpe, decontaminate, license_scan, quality, toxicity, transducers
from folioloom.llm.fm_index import FMIndex

from . import brute


def result(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_decontaminate(spark, documents, corpus):
    items = [(1, corpus[30][1]), (2, corpus[40][1][-80:]), (3, "one two"), (4, None), (5, ""), (6, corpus[0][1][:100]), (6, corpus[0][1][:100]), (None, corpus[45][1])]
    bench = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, hits string")
    got = decontaminate.decontaminate(documents, bench)
    assert result(got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == brute.leaks(corpus, items, 10)
    texts = dict(corpus)
    for r in got.collect():
        assert r.contaminated or (r.kept or "") == (texts[r.doc_id] or "")
        if r.contaminated:
            assert len(brute.ALNUM.findall(r.kept)) == r.n_words - r.n_hit
    assert decontaminate.decontaminate(documents, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(documents.limit(0), bench).count() == 0


def test_decontaminate_in_blocks(spark, documents, corpus, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_TEXT", 200)
    items = [(i, t) for i, t in corpus[28:36]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(documents, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert result(got) == brute.leaks(corpus, items, 10)


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 5, 400)
    index = FMIndex(text, 6)
    phrases = rng.integers(1, 6, (80, 4))
    lengths = rng.integers(1, 5, 80)
    phrases[np.arange(4)[None] >= lengths[:, None]] = 0
    p, at = index.occurrences(phrases, lengths)
    want = {(i, j) for i in range(80) for j in range(len(text) - lengths[i] + 1) if (text[j : j + lengths[i]] == phrases[i, : lengths[i]]).all()}
    assert sorted(zip(p.tolist(), at.tolist(), strict=True)) == sorted(want)


@pytest.fixture(scope="module")
def library():
    t = Library.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_like_the_library(library, corpus):
    own = bpe.tokenizer(open(bpe.vocabulary_path(), encoding="utf-8").read())
    rng = random.Random(5)
    letters = [chr(c) for c in [*range(0x20, 0x7F)] * 3 + [*range(0xA0, 0x250), 9, 10, 0x1C, 0x1F, 0x85, 0x2028, 0x3000, 0x300, 0x301, 0x3A3, 0x4E2D, 0x1F600, 0xAC00, 0x661, 0xBD, 0x2160]]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(70))) for _ in range(1500)]
    texts += ["aaaa" * 60, "DON'T they'LL", "x<|endoftext|>y <|startoftext|>", "", "ΑΣ ΟΣΑ", "ab" * 400, "!!!" * 50, *(t or "" for _, t in corpus[:20])]
    for t in texts:
        e = library.encode(t, add_special_tokens=False)
        ids, decoded = own.both(t)
        assert ids == " ".join(map(str, e.ids)), t
        assert decoded == library.decode(e.ids, skip_special_tokens=False), t
        assert own.decode(own.encode(t)) == decoded


def test_bpe_reads_words_together(library, monkeypatch):
    """Words of ordinary length are read together, each once for a run of texts; long ones alone, with the same tokens."""
    definition = open(bpe.vocabulary_path(), encoding="utf-8").read()
    rng = random.Random(9)
    words = ["".join(rng.choices("aeinrstöß'", k=rng.randrange(1, 20))) for _ in range(400)] + [c * n for c in "aé中" for n in (1, 20, 21, 31, 32, 33, 63, 64)]
    texts = [" ".join(rng.choices(words, k=50)) for _ in range(40)]
    texts += ["a \x85\u3000 b\x1cc  d\n\te", "<|ENDOFTEXT|> <|endoftext|><|endoftext|>", "", "  "]
    want = [(" ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False)) for e in library.encode_batch(texts, add_special_tokens=False)]
    own = bpe.Tokenizer(definition)
    with monkeypatch.context() as m:
        m.setattr(bpe.Tokenizer, "ranks", None)
        m.setattr(bpe, "BLOCK_WORDS", 7)
        short = [t for t in texts if max(map(len, t.encode().split()), default=0) <= bpe.LONG_WORD]
        assert list(own.all(short)) == [w for t, w in zip(texts, want, strict=True) if t in short]
    asked = []
    read = own.words
    monkeypatch.setattr(own, "words", lambda w: asked.extend(w) or read(w))
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    own.memo, own.old = {}, {}
    assert list(own.all(texts)) == want and len(asked) == len(set(asked))
    assert [own.both(t) for t in texts] == want and len(own.memo) < 10 and len(own.old) < 10
    long = bpe.Tokenizer(definition)
    monkeypatch.setattr(bpe, "LONG_WORD", 0)
    assert list(long.all(texts)) == want


def test_bpe_rows(documents, corpus, library):
    got = bpe.bpe_encode(documents)
    texts = dict(corpus)
    for r in got.collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))))
    assert bpe.bpe_encode(documents.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mit or apache-2.0", [{"mit"}, {"apache-2.0"}]),
        ("mit and (gpl-2.0-only or bsd-3-clause)", [{"mit", "gpl-2.0-only"}, {"mit", "bsd-3-clause"}]),
        ("gpl-2.0-or-later with classpath-exception-2.0 or mit", [{"gpl-2.0-or-later with classpath-exception-2.0"}, {"mit"}]),
        ("mit or mit and isc", [{"mit"}, {"mit", "isc"}]),
        ("mit license text", [{"mit"}]),
        ("(mit", None),
        ("or mit", None),
    ],
)
def test_license_expressions(text, want):
    got = license_scan.parse(text)
    assert (got and [set(x) for x in got[1]]) == want


def test_license_scan(spark):
    rows = [
        (1, "Under the MIT License. The MIT license, MIT LICENSE"),
        (2, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\ncode"),
        (3, "GNU General Public License; Licensed under CC BY-NC 4.0."),
        (4, None),
        (5, ""),
        (6, "permit license cc bye"),
        (6, "permit license cc bye"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in license_scan.license_scan(df).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (9, 3, 2, 7, "mit")
    assert (got[2].n_base, got[2].labels, got[2].first_word) == (0, "apache,bsd,mit", None)
    assert (got[3].base_labels, got[3].labels) == ("cc-by,gpl", "cc-by,cc-by-nc,gpl")
    assert [(got[i].n_base, got[i].labels, got[i].score) for i in (4, 5, 6)] == [(0, "", 0.0)] * 3
    assert license_scan.license_scan(df).count() == 7
    assert license_scan.license_scan(df.limit(0)).count() == 0


def test_license_scan_reads_after_every_tag(spark):
    rows = [
        (1, "x; SPDX-License-Identifier: MIT y; SPDX-License-Identifier: GPL-2.0", ["mit", "gpl-2.0"]),
        (2, "released under review, é SPDX-License-Identifier: GPL-2.0", ["gpl-2.0"]),
        (3, "License-Expression: MIT", ["mit"]),
        (4, "It is licensed\nunder the MIT", ["mit"]),
        (5, "licensed  under  Apache-2.0\n or\nMIT", ["apache-2.0 or mit"]),
        (6, "# Licensed\n# under the\n# MIT licence", ["mit"]),
        (7, "/* licensed under\n * ISC\n */ or mit", ["isc"]),
        (8, "licensed under thea MIT, released under", []),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert {r.doc_id: r.expressions for r in license_scan.license_scan(df).collect()} == {r[0]: r[2] for r in rows}


def test_license_expressions_of_any_length():
    text = " and ".join(["(mit or isc)", "gpl-2.0 with classpath-exception-2.0"] * 200 + ["apache-2.0"])
    tokens = license_scan.expression(text)
    assert " ".join(tokens).replace("( ", "(").replace(" )", ")") == text
    assert license_scan.labels_of(license_scan.to_postfix(tokens)) == {"mit", "isc", "gpl", "apache"}


def test_grammar():
    machine = toxicity.grammar()
    assert [o for o, _ in machine.run(["target", "insult"])] == ["other", "aimed"]
    assert [o for o, _ in machine.run(["negation", "other", "insult", "insult", "insult", "insult"])][2:] == ["denied", "denied", "insult", "insult"]
    assert [o for o, _ in machine.run(["report", "other", "insult"])][2] == "quoted"
    assert [o for o, _ in machine.run(["threat", "other"])] == ["threat", "other"]


def test_composition_is_one_after_the_other():
    a = transducers.Transducer(0, {(0, "x"): (1, "y", 0.5), (1, "x"): (0, "x", 2.0)})
    b = transducers.Transducer(0, {(0, "y"): (0, "z", 3.0)})
    both = transducers.compose(a, b, ["x", "y"])
    assert both.run(["x", "x", "y"]) == [("z", 1.5), ("x", 2.0), ("z", 3.0)]


def test_toxicity_on_held_out_rows(spark, corpus):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice(["lo", "re", "mi", "fa", "sol", "la"]) for _ in range(60)]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words[rng.randrange(50)] = rng.choice(["grunk", "moron", "blotted"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    df = spark.createDataFrame([*rows, (None, None), (3, "")], "doc_id long, text string")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df, told)
    judged = {r.doc_id: r for r in got.collect() if r.doc_id is not None and r.doc_id != 3}
    held = [i for i in judged if judged[i].held_out]
    assert 400 < len(held) < 600
    assert sum(judged[i].predicted == labels[i][2] for i in held) / len(held) > 0.97
    assert got.count() == 1502
    none = toxicity.toxicity(df, told.limit(0))
    assert all(0 <= r.score <= 1 for r in none.collect())
    assert toxicity.toxicity(df.limit(0), told).count() == 0


def test_network_gradients_and_accuracy():
    rng = random.Random(4)
    texts, y = [], []
    for i in range(500):
        words = " ".join(rng.choice(["stone", "river", "under", "light", "house"]) for _ in range(rng.randrange(5, 120)))
        good = i % 3 > 0
        texts.append(words if good else words.upper().replace(" ", "!! "))
        y.append(int(good))
    net = quality.train(texts[:350], y[:350])
    bodies = [t.encode() for t in texts[350:]]
    s = quality.scores(net, np.frombuffer(b"".join(bodies), np.uint8), np.append(0, np.cumsum([len(b) for b in bodies])))
    assert ((s >= 0.5) == np.array(y[350:])).mean() > 0.97
    fresh = quality.Network.fresh()
    for k, v in vars(fresh).items():
        setattr(fresh, k, v.astype(np.float64))
    data, offs, labels = np.frombuffer(b"".join(bodies[:5]), np.uint8), np.append(0, np.cumsum([len(b) for b in bodies[:5]])), np.array(y[350:355], float)

    def loss():
        p = quality.scores(fresh, data, offs)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    g = quality.gradients(fresh, data, offs, labels)
    for k, at in (("near", (3, 2)), ("far", (1, 5)), ("hidden", (2, 3)), ("out", (1,)), ("bias", (4,))):
        p = getattr(fresh, k)
        p[at] += 1e-6
        up = loss()
        p[at] -= 2e-6
        down = loss()
        p[at] += 1e-6
        assert abs((up - down) / 2e-6 - g[k][at]) < 1e-4


def test_quality_rows(spark):
    df = spark.createDataFrame([(i, ("fine words here " * 30 if i % 2 else "BAD!! " * 60), "x") for i in range(200)] + [(None, None, "x"), (1, "", "x")], "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = quality.quality(df, labels).collect()
    assert len(got) == 202
    held = [r for r in got if r.held_out and r.doc_id != 1]
    assert held and sum(r.predicted == r.doc_id % 2 for r in held) / len(held) > 0.9
    assert quality.quality(df.limit(0), labels).count() == 0
