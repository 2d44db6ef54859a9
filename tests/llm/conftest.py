from __future__ import annotations

import random

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): copies, near copies, shared passages, repeats inside a document, nulls, empty and short texts."""
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("an", "the", "Ör", "tion", "re", "ü", "Me") for b in ("ed", "ing", "la", "é", "st", "OR")]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    shared, base = prose(60), prose(120)
    rows = [(1, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "one  TWO"), (9, "la " * 300)]
    for i in range(10, 30):
        parts = base.split()
        for _ in range(rng.randrange(1, 8)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        rows.append((i, " ".join(parts)))
    for i in range(30, 45):
        rows.append((i, prose(rng.randrange(1, 90)) + " " + shared + "\n" + prose(rng.randrange(0, 40))))
    rows += [(i, prose(rng.randrange(1, 200))) for i in range(45, 60)]
    rows.append((60, prose(5000)))
    rows.append((61, rows[-1][1][5000:20000]))
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with columns whose names clash with those that operators use inside."""
    rows = [(i, t, "x", float(i), i % 3, None, "r") for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, score double, doc long, dh string, repeats string")
