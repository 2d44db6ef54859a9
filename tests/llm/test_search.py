from __future__ import annotations

import re

import numpy as np

from folioloom.llm import neighbours, url_filter

from .conftest import LOWER


def test_url_rules_and_models(spark):
    urls = [f"https://{h}.{d}/{p}/{i}" for i, (h, d, p) in enumerate((h, d, p) for h in ("a", "news", "x.y") for d in ("example.org", "shop.com", "ORG", "other.net") for p in ("es", "en", "fr", "de", "en/1"))]
    urls += [None, "", "no scheme", "http://example.org?x=/es/", "ftp://EXAMPLE.ORG/es/#a", "http://notexample.org/es/", "http://a.com#/fr/", "x://y://z/p?q"]
    df = spark.createDataFrame([(i, u, "k", i) for i, u in enumerate(urls)], "page_id long, url string, host string, kind int")
    got = {r.page_id: r for r in url_filter.url_filter(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
            host, path = m[1].translate(LOWER), m[2]
        rule = verdict = None
        for v, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2])):
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                rule, verdict = h + p, v
                break
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_url_models_learn_the_classes(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'bad'}{i}.{'org/x' if i % 2 else 'com/de/spam'}/{i}") for i in range(400)]
    rows += [(1000 + i, f"http://{'good' if i % 2 else 'bad'}{i}.{'net/x' if i % 2 else 'net/de/spam'}/{i}") for i in range(100)]
    got = {r.page_id: r for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[1000 + i].verdict == ("allow" if i % 2 else "block") and got[1000 + i].rule is None for i in range(100))
    only = spark.createDataFrame(rows[400:], "page_id long, url string")
    assert url_filter.url_filter(only).count() == 100
    assert url_filter.url_filter(only.limit(0)).count() == 0


def test_url_models_tell_digits_and_far_contexts(spark):
    """A class that only a digit tells, and one that only a character 20 places before tells."""
    rows = [f"http://a{i % 9}.example.org/en/{d}{i}" for i in range(200) for d in (1, 2)]
    digits = [f"http://other.net/en/{d}{i}" for i in range(200, 240) for d in (1, 2)]
    mid = "0123abcdefghijklmnop"
    rows += [f"http://h{i % 7}.com/{c}/{a}{mid}{b}?{i}" for i in range(200) for c, pairs in (("fr", ("Ax", "By")), ("de", ("Ay", "Bx"))) for a, b in pairs]
    far = [f"http://h.net/{a}{mid}{b}?{i}" for i in range(200, 220) for a, b in ("Ax", "By", "Ay", "Bx")]
    urls = [*rows, *digits, *far]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.url_filter(df).collect()}
    score = {u: got[i].score for i, u in enumerate(urls)}
    assert min(score[u] for u in digits if "/en/2" in u) > max(score[u] for u in digits if "/en/1" in u)
    assert min(score[u] for u in far if mid + "x" in u and "/A" in u or mid + "y" in u and "/B" in u) > max(score[u] for u in far if mid + "y" in u and "/A" in u or mid + "x" in u and "/B" in u)


def test_markov_is_a_distribution():
    g = np.random.default_rng(1).integers(0, url_filter.SYMBOLS ** (url_filter.ORDER + 1), 500)
    model = url_filter.Markov(*np.unique(g, return_counts=True))
    context = int(g[0]) // url_filter.SYMBOLS * url_filter.SYMBOLS
    assert abs(np.exp(model.log_p(context + np.arange(url_filter.SYMBOLS))).sum() - 1) < 1e-9


def brute_neighbours(ids, x, step=100, k=10):
    out = {}
    for i in np.flatnonzero(ids % step == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        mine = ids != ids[i]
        order = np.lexsort((ids[mine], d[mine]))[:k]
        out[int(ids[i])] = [(int(ids[mine][j]), d[mine][j]) for j in order]
    return out


def test_neighbours_recall(spark):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(3000, 16)) + rng.normal(size=(12, 16))[rng.integers(12, size=3000)] * 2).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, 1.0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, rank int, score double")
    got = {}
    for r in neighbours.nearest_neighbours(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_neighbours(np.arange(3000), x.astype(np.float64))
    assert got.keys() == want.keys()
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((x[v].astype(float) - x[q].astype(float)) ** 2).sum())) < 1e-12 for _, v, s in rows)
        hits += len({r[1] for r in rows} & {v for v, _ in want[q]})
    assert hits / (10 * len(got)) >= 0.9


def test_few_neighbours_bad_vectors_ties(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (5, [0.0, 1.0]), (3, [0.0, -1.0]), (7, [0.0, 0.0]), (8, None), (9, [None, 1.0]), (10, [float("nan"), 1.0]), (11, [float("inf"), 0.0]), (None, [1.0, 1.0]), (12, [1.0, 2.0, 3.0]), (100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in neighbours.nearest_neighbours(df).collect())
    assert got == [(0, 1, 3, 1.414214), (0, 2, 5, 1.414214)]
    assert neighbours.nearest_neighbours(df.limit(0)).count() == 0
