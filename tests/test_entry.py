from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from folioloom import catalogue

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def rounded(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(rounded, v)) if isinstance(v, list) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=str)
    found = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(rounded(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()), key=str)


def test_entry_works_without_the_corpus_operators(tmp_path):
    """The subpackage and its pipeline can be taken out; the other queries stay."""
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); sys.modules['folioloom.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
