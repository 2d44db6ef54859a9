"""What the n-gram join and the stage of the pipeline on it leave on disk and send through an exchange."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioloom.llm import cluster, jaccard_join


def shuffled(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def copied():
    rng = random.Random(2)
    rows = [(i, " ".join(f"{rng.randrange(1 << 48):012x}" for _ in range(300))) for i in range(1500)]
    return rows + [(2000 + i, t) for i, t in rows[:20]] + [(3000 + i, t + " tail") for i, t in rows[20:40]]


@pytest.fixture(scope="module")
def mostly_different(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("different") / "documents.parquet")
    spark.createDataFrame(copied(), "doc_id long, text string").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("stage", ["op1", "pipeline"])
def test_texts_without_a_partner_do_not_travel(spark, mostly_different, stage):
    before, text = shuffled(spark), sum(len(t) for _, t in copied())
    if stage == "op1":
        got = {r.component_id for r in jaccard_join.jaccard_components(mostly_different).collect()}
    else:
        got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, mostly_different, "").collect()}
    assert got == set(range(1500))
    assert shuffled(spark) - before < 0.6 * text


def test_settled_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    kept = cluster.settled(spark.range(1000).repartition(5, "id"))
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left
    assert kept.count() == 1000


def test_packed_prefixes_come_back():
    rng = np.random.default_rng(1)
    token = jaccard_join._short(rng.integers(1 << 63, size=20_000).astype(np.uint64), 3)
    group = np.repeat(rng.choice([1, 7, 700, (1 << 31) - 1], 5000) << 32 | rng.integers(1 << 32, size=5000), 4)
    want = sorted(zip(token.tolist(), group.tolist(), strict=True))
    for by_group in (False, True):
        batch, got = jaccard_join._bucketed(token, group, 3, by_group), []
        for i, bucket in enumerate(batch.column("bucket").to_pylist()):
            t, g, n = jaccard_join._unbucketed(bucket, batch.slice(i, 1))
            assert (n == g >> 32).all()
            got += zip(t.tolist(), g.tolist(), strict=True)
        assert sorted(got) == want


@pytest.mark.parametrize("words", [1 << 18, 1])
def test_suspected_rows(spark, monkeypatch, words):
    """With one word of bits nearly every row is suspected; no key is lost, and a join decides."""
    monkeypatch.setattr(cluster, "BIT_WORDS", words)
    rows = [(i % 90, f"t{i % 7}", i) for i in range(400)] + [(None, "t1", -1), (None, None, -2), (3, None, -3)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, row long")
    keys = spark.createDataFrame([(5, "t1"), (None, "t1"), (None, None), (700, "t0")], "a long, b string")
    likely, others = cluster.suspected(docs, keys, [F.col("doc_id"), F.col("text")])
    assert likely.columns == others.columns == docs.columns
    one, two = [tuple(r) for r in likely.collect()], [tuple(r) for r in others.collect()]
    assert sorted(map(str, one + two)) == sorted(map(str, rows))
    assert {r for r in rows if r[:2] in {(5, "t1"), (None, "t1"), (None, None)}} <= set(one)
    assert words == 1 or len(one) < 20


def test_a_copy_is_dropped_whether_suspected_or_not(spark, monkeypatch):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, a), (1, a + " more of it"), (2, a), (None, a), (None, b), (None, b), (3, "c d e"), (None, ""), (None, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    found = []
    for words in (1 << 18, 1):
        monkeypatch.setattr(cluster, "BIT_WORDS", words)
        found.append(sorted(str(tuple(r)) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()))
    assert found[0] == found[1]
    assert len(found[0]) == 6
