"""What queries over the archive view do once for each row, and not once for each group, comparison or column."""

from __future__ import annotations

import json
import random

import pytest

from folioloom.operators import lookups, sequences, state_machine
from folioloom.operators.boundaries import boundary_links
from folioloom.plans import linked_art, queries, view_queries  # noqa: F401 - registers its queries
from tests.test_operators import PAGES, row

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


FILES = "file string, row int, filename string, boundary string, identifier string, parts string, other string"


def test_small_files_are_read_together(spark):
    """Files of one row to some, one without a name, cut at batches of 7 rows; none costs a call of its own."""
    rng = random.Random(5)
    files = {None: 3} | {f"{i}_x.csv": rng.randrange(1, 30) for i in range(40)}
    rows = {f: [row(n, f"AR_1_{n % 9:04d}", rng.choice(["START", "END", f"SAME AS AR_1_{n % 5:04d}", None]), rng.choice(["T1", "T2", None]), rng.choice(["START", "END", None])) for n in range(k)] for f, k in files.items()}
    df = spark.createDataFrame([(f, *r.values()) for f, rs in rows.items() for r in rng.sample(rs, len(rs))], FILES)
    found = state_machine.segmentation_events(df)
    assert "FlatMapGroups" not in plan(found)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {(f, *g, i) for f, rs in rows.items() for i, g in enumerate(state_machine.segment_file(rs, "1"))}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_padded_names_are_made_once(spark):
    """The join's keys are columns: an expression is made anew in each comparison of its sort."""
    scans = spark.createDataFrame([("1", "AR_1_0007"), ("2", "AR_1_7"), ("0", "AR_1_7"), ("3", "AR_1_12345"), ("4", None)], "scan_id string, filename string")
    rows = spark.createDataFrame([("AR_1_7",), ("AR_1_07",), ("AR_1_07",), ("AR_1_012345",), ("AR_1_99999999999",), ("x",), (None,)], "name string")
    found = lookups.file_lookup(rows.hint("merge"), "name", scans.hint("merge"))
    joins = [line for line in plan(found).split("== Physical Plan ==")[1].splitlines() if "Join [" in line]
    assert len(joins) == 2 and not any("CASE WHEN" in line for line in joins)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("AR_1_7", "0"), ("AR_1_07", "1"), ("AR_1_07", "1"), ("AR_1_012345", "3"), ("AR_1_99999999999", None), ("x", None), (None, None)]))


def test_records_are_text_and_read_once(spark):
    """A record is put together from text, escaped where it must be, and a query reads its JSON once for all fields."""
    odd = ['a "b" \\ c', "tab\tend\n\x01", "ünï 💡", "", None]
    scan = spark.createDataFrame([(str(i), t, t, f"http://x/{t}/info.json", None if t == "" else i, 2, "nld") for i, t in enumerate(odd)], "id string, filename string, na_identifier string, iiif_image_info string, height int, width int, languages string")
    page = spark.createDataFrame([(f"p{t}", str(i), t, "Recto") for i, t in enumerate(odd)] + [("lone", "x", "1", None)], "id string, scan_id string, page_or_folio_number string, recto_verso string")
    made = linked_art.pages_jsonld(page, scan)
    assert "to_json(struct(@context" not in plan(made)
    got = {r.id: json.loads(r.json) for r in made.collect()}
    for i, t in enumerate(odd[:4]):
        record = got[f"p{t}"]
        assert record["id"].endswith(f":p{t}") and record["_label"] == f"Page {t or 'p'}" and record["carries"]["language"][0]["_label"] == "Dutch"
        shown = record["shows"]["digitally_shown_by"]
        assert shown["_label"] == f"Scan {t}" and shown["identified_by"][0]["content"] == t and [d["value"] for d in shown["dimension"]] == [None if t == "" else i, 2]
    assert got["lone"]["shows"]["digitally_shown_by"] is None and got["lone"]["carries"]["language"] is None
    fields = queries._fields(made, "id", number="$.shows.digitally_shown_by.dimension[1].value", kind="$.classified_as[0].classified_as[0]._label", none="$.carries.language[3].id", own="$.shows.digitally_shown_by.identified_by[1].content")
    physical = plan(fields).split("== Physical Plan ==")[1]
    assert physical.count("from_json(") == 1 and "get_json_object" not in physical
    assert {tuple(r) for r in fields.where("key = 'p'").collect()} == {("p", "2", "Part Type", None, "3")}


@pytest.mark.parametrize("name", ["first_last_scan", "document_details", "timeline_items", "strongest_links", "document_table", "document_jsonld", "folio_match_links"])
def test_the_view_is_made_once(spark, name):
    """Links bear what is asked of their pages, so scans are put in order once, and no second time for long ranges or the pages."""
    found = queries.QUERIES[name](spark, SMALL)
    assert plan(found).split("== Physical Plan ==")[1].count("Window [row_number() windowspecdefinition(l_suppkey") == 1


def test_runs_are_grouped_once(spark):
    pages = spark.createDataFrame([(0, f"p{n}{s}", f"s{n}", f"f{n}", n, s, False, None, f) for n, s, f in [(1, "Verso", "5, 6"), (1, "Recto", "5"), (2, None, "5,x"), (3, None, " 5"), (4, None, None), (5, None, "5")]], PAGES)
    scans = pages.select("inventory_id", "scan_id", "filename", "scan_order").distinct()
    runs = sequences.repeated_runs(scans, pages, 2)
    assert plan(runs).split("== Physical Plan ==")[1].count("Join") == 1
    assert {tuple(r) for r in runs.collect()} == {(0, 5, 1, 3, 3, f"s{n}") for n in (1, 2, 3)}


def test_inventories_are_solved_together(spark):
    """Boundaries and ranges of small inventories are not a call each."""
    base = spark.createDataFrame([(v, f"B{v}", f"p{v}_{i}", i) for v in range(5) for i in range(6)], "inventory_id int, document_id string, page_id string, index int")
    docs = spark.createDataFrame([(v, f"T{v}", 10, 15) for v in range(5)], "inventory_id int, id string, folio_start int, folio_end int")
    links = spark.createDataFrame([(f"p{v}_{i}", f"T{v}", 10 + i) for v in range(5) for i in range(1, 5)], "page_id string, document_id string, index int")
    found = boundary_links(base, docs, links)
    assert "FlatMapGroups" not in plan(found)
    assert {tuple(r) for r in found.collect()} == {(f"p{v}_{i}", f"T{v}", 10 + i) for v in range(5) for i in (0, 5)}
    assert "FlatMapGroups" not in plan(queries.QUERIES["manifest_json"](spark, SMALL))
