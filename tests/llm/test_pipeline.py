from __future__ import annotations

import random

import pytest

import corpus_pipeline
from folioloom.llm import registry

from . import brute


@pytest.fixture(scope="module")
def tables(spark, corpus, tmp_path_factory):
    """A small copy of the tables: the corpus, toxic documents with labels, and a benchmark."""
    folder = tmp_path_factory.mktemp("tables")
    rng = random.Random(8)
    toxic = [(1000 + i, " ".join(rng.choice(["lo", "re", "mi"]) + str(rng.randrange(40)) for _ in range(40)) + (" you moron idiot" if i % 3 == 0 else "")) for i in range(240)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in [*corpus, *toxic]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int("moron" in t)) for i, t in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, " ".join(corpus[50][1].split()[:30])), (2, "nothing of this is there")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def test_stages_one_after_the_other(spark, tables, tmp_path):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, folder)
        if name != "bpe":
            assert got.columns == columns
        got.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out = {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":
            kept = {i: t for i, t in kept.items() if "moron" not in (t or "")}
        elif name == "ngram_jaccard_join":
            component = brute.components(list(kept.items()))
            kept = {i: t for i, t in kept.items() if component[i][1] == i}
        elif name == "substring_dedup":
            want = brute.word_repeats(list(kept.items()), 20)
            assert {i: brute.sha(" ".join((r.text or "").split())) for i, r in out.items()} == {i: w[2] for i, w in want.items()}
            assert all(out[i].text == t for i, t in kept.items() if want[i][1] == 0)
            kept = {i: r.text for i, r in out.items()}
        elif name == "benchmark_decontamination":
            want = brute.leaks(list(kept.items()), items, 10)
            assert any(w[4] for w in want.values())
            assert all(len(brute.ALNUM.findall(out[i].text or "")) == w[0] - w[1] for i, w in want.items())
            kept = {i: r.text for i, r in out.items()}
        assert out.keys() == kept.keys()
        if name not in ("bpe",):
            assert all((r.n_chars or 0) == len(r.text or "") for r in out.values() if r.text is not None)


def test_run_is_the_stages(spark, tables):
    folder, _, _ = tables
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert all(r.ids_sha256 == brute.sha(r.ids) for r in got.collect())
    assert corpus_pipeline.ORACLE_SQL is None


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 11))


def test_nulls_repeats_clashing_names_and_empty_tables(spark, tables, tmp_path):
    """Every stage takes null ids and texts, repeated rows and columns with names of its own, and an empty table."""
    folder = tables[0]
    a = " ".join(f"w{i}" for i in range(40))
    rows = [(1, a), (1, a), (1, a + " more of it"), (2, a), (None, a), (None, None), (None, ""), (None, ""), (5, None), (5, " \t"), (6, "x " * 50_000)]
    schema = "doc_id long, text string, row string, n_words int, kept string, repeats string, packed string, n_chars int"
    docs = spark.createDataFrame([(i, t, "r", 7, "k", "q", "p", len(t or "")) for i, t in rows], schema)
    sizes = []
    for some in (docs, docs.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, some, folder)
            if name != "bpe":
                assert got.schema.simpleString() == docs.schema.simpleString()
            got.write.mode("overwrite").parquet(f"{tmp_path}/{k}")
            some = spark.read.parquet(f"{tmp_path}/{k}")
            sizes.append(some.count())
            if name not in ("toxicity", "bpe"):
                assert {tuple(r) for r in some.select("row", "n_words", "kept", "repeats", "packed").distinct().collect()} <= {("r", 7, "k", "q", "p")}
    # one of the five copies of a, one of the very long text, and the six rows without words
    assert sizes == [11, 7, 7, 7, 7, 0, 0, 0, 0, 0]
