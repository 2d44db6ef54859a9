from __future__ import annotations

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from folioloom import snapshots
from folioloom.plans import corrections, holdings, views


def table(spark, name, rows):
    """Rows given as dicts; columns that are not given are null."""
    fields = snapshots.SCHEMAS[name]
    return spark.createDataFrame([tuple(r.get(c) for c in fields.names) for r in rows], fields)


def test_pages_of_lists(spark):
    scans = table(spark, "scan", [{"id": str(n), "filename": f"f{n:03d}", "inventory_id": str(n % 2)} for n in range(61)])
    first, third = views.scan_list(scans), views.scan_list(scans, page=3)
    assert [r.filename for r in first.rows.collect()] == [f"f{n:03d}" for n in range(30)] and [r.filename for r in third.rows.collect()] == ["f060"]
    assert tuple(first.totals.first()) == (61, 3) and tuple(views.scan_list(scans, "1").totals.first()) == (30, 1)
    assert views.scan_list(scans, page=4).rows.count() == 0 and tuple(views.scan_list(scans, "none").totals.first()) == (0, 0)
    with pytest.raises(ValueError):
        views.scan_list(scans, page=0)
    pages = table(spark, "page", [{"id": "a", "scan_id": "1", "inventory_id": "1"}, {"id": "b", "scan_id": None, "inventory_id": "1"}])
    got = views.page_list(pages, scans)
    assert [r.id for r in got.rows.collect()] == ["a"] and got.totals.first().total == 2
    with pytest.raises(LookupError):
        views.one(scans, "filename", "gone")
    assert views.one(scans, "filename", "f007").first().id == "7"


def test_page_detail_and_info(spark):
    scans = table(spark, "scan", [{"id": "s", "filename": "f1", "inventory_id": "i"}, {"id": "t", "filename": "f0", "inventory_id": "i"}])
    pages = table(spark, "page", [{"id": "a", "scan_id": "s", "inventory_id": "i", "recto_verso": "Recto"}, {"id": "b", "scan_id": "s", "inventory_id": "i", "recto_verso": "Verso", "is_blank": True}, {"id": "c", "scan_id": "t", "inventory_id": "i"}, {"id": "x"}])
    link = table(spark, "page2document", [{"id": "1", "page_id": "a", "document_id": d, "index": 0} for d in "edd"])
    assert tuple(views.page_detail(pages, scans, link, "a").first()) == ("a", "f1", "c", "b", ["d", "e"])
    assert tuple(views.page_detail(pages, scans, link, "x").first()) == ("x", None, None, None, [])
    shown = views.inventory_scans(scans, pages, link, "i")
    assert [(r.filename, r.id, r.features, r.in_document) for r in shown.rows.collect()] == [("f0", "c", "No features", False), ("f1", "b", "Blank", False), ("f1", "a", "No features", True)]


def test_places_methods_and_shortened_texts(spark):
    places = table(spark, "settlement", [{"id": "1", "glob_id": "g1"}, {"id": "2", "glob_id": "g2"}])
    labels = table(spark, "settlement_label", [{"id": "a", "label": "Galle", "settlement_id": "2"}, {"id": "b", "label": "GALLE fort", "settlement_id": "2"}])
    assert [r.glob_id for r in views.place_list(places, labels, " galle ").rows.collect()] == ["g2"] and views.place_list(places, labels).totals.first().total == 2
    docs = table(spark, "document", [{"id": "d1", "location_id": "2"}, {"id": "d2", "location_id": "2", "date_earliest_begin": dt.date(1700, 1, 1)}, {"id": "d3", "location_id": "1"}])
    assert [r.id for r in views.place_documents(places, docs, "g2").rows.collect()] == ["d2", "d1"]
    row = spark.createDataFrame([(["a" * 50, "b", "c", "d"], "x" * 101)], "names array<string>, text string")
    assert tuple(row.select(views.first_of("names"), views.shortened("text", 100)).first()) == ("a" * 40 + ", b +2 more", "x" * 100 + "...")
    assert tuple(row.select(views.first_of(F.slice("names", 2, 2)), views.shortened(F.lit("short"), 100)).first()) == ("b, c", "short")


def test_methods_are_edited(spark):
    none = snapshots.empty(spark, corrections.METHODS)
    made = corrections.create_method(none, " Hand ", " ", "1999-02-30", "http://x")
    (m,) = made.collect()
    assert (m.name, m.description, m.date, m.url) == ("Hand", None, None, "http://x")
    with pytest.raises(ValueError):
        corrections.create_method(made, "  ")
    with pytest.raises(ValueError):
        corrections.create_method(made, "Hand")
    (e,) = corrections.edit_method(made, m.id, "Hand 2", "told", "1999-02-28").collect()
    assert (e.id, e.name, e.description, e.date, e.url) == (m.id, "Hand 2", "told", dt.date(1999, 2, 28), None)
    docs = table(spark, "document", [{"id": "d", "method_id": m.id}])
    with pytest.raises(ValueError):
        corrections.delete_method(made, docs, m.id)
    with pytest.raises(LookupError):
        corrections.edit_method(made, "gone", "x")
    assert corrections.delete_method(made, docs.limit(0), m.id).count() == 0


def archive(spark, numbers):
    scan = table(spark, "scan", [{"id": f"s{n}", "filename": f"f{n}", "inventory_id": "i", "scan_order": n} for n in range(len(numbers))])
    page = table(spark, "page", [{"id": f"p{n}", "scan_id": f"s{n}", "inventory_id": "i", "page_or_folio_number": x} for n, x in enumerate(numbers)])
    return scan, page


def test_interpolation_and_removal_report_what_they_change(spark):
    scan, page = archive(spark, ["1", None, None, "4", "5", "5", "5", "5"])
    link = table(spark, "page2document", [{"id": str(n), "page_id": f"p{n}", "document_id": "D", "index": n, "source": "FOLIO_RANGE", "confidence": "FOLIO_RANGE"} for n in (0, 3, 4, 5, 6, 7)] + [{"id": "v", "page_id": "p4", "document_id": "D", "index": 0, "source": "SEGMENTATION", "confidence": "VALIDATED"}])
    done = corrections.interpolate(page, scan, link, ["FOLIO_RANGE"])
    assert {(r.page_id, r.document_id, r["index"], r.source, r.confidence) for r in done.delta.collect()} == {("p1", "D", 0, "INTERPOLATED", "INTERPOLATED"), ("p2", "D", 0, "INTERPOLATED", "INTERPOLATED")}
    assert tuple(done.stats.first()) == (2, 2, 1) and done.page2document.count() == 9
    assert corrections.interpolate(page, scan, link, ["FOLIO_RANGE"], 1).delta.count() == 0
    assert corrections.interpolate(page, scan, link, ["FOLIO_RANGE"], dry_run=True).page2document.count() == 7
    document = table(spark, "document", [{"id": "D", "inventory_id": "i", "folio_start": 1, "folio_end": 9}])
    gone = corrections.remove_runs(page, scan, document, link)
    assert {r.id for r in gone.delta.collect()} == {"4", "5", "6", "7"} and {r.id for r in gone.page2document.collect()} == {"0", "3", "v"}
    assert corrections.remove_runs(page, scan, document, link, 4).delta.count() == 0


def test_boundaries_are_filled(spark):
    document = table(spark, "document", [{"id": "B", "inventory_id": "i", "method_id": "base"}, {"id": "T", "inventory_id": "i", "method_id": "m", "folio_start": 10, "folio_end": 15}])
    base = [{"id": f"b{n}", "page_id": f"p{n}", "document_id": "B", "index": n, "source": "BASELINE", "confidence": "DEFINITIVE"} for n in range(6)]
    mine = [{"id": f"t{n}", "page_id": f"p{n}", "document_id": "T", "index": 10 + n, "source": "FOLIO_RANGE", "confidence": "FOLIO_RANGE"} for n in range(1, 5)]
    done = corrections.fill_boundaries(document, table(spark, "page2document", base + mine), "base")
    assert {(r.page_id, r.document_id, r["index"], r.source) for r in done.delta.collect()} == {("p0", "T", 10, "BASELINE_BOUNDARY"), ("p5", "T", 15, "BASELINE_BOUNDARY")}
    assert tuple(done.stats.first()) == (2, 2, 1)
    rows = spark.createDataFrame([(" cover",), ("cover ",), ("",), (None,), ("index",)], "other string")
    assert {tuple(r) for r in corrections.other_page_types(rows).collect()} == {("cover", 2), ("index", 1)}


def test_nested_set_and_identifier_classes(spark, tmp_path):
    series = table(spark, "series", [{"id": "1", "title": 'Root "A"'}, {"id": "2", "title": "Leaf", "part_of_id": "1"}, {"id": "3", "title": None, "part_of_id": "1"}])
    inventory = table(spark, "inventory", [{"id": n, "inventory_number": n} for n in ("1053A", "999", "1053")])
    held = spark.createDataFrame([("1053A", "2"), ("999", "2"), ("1053", "2")], "inventory_id string, series_id string")
    whole = holdings.nested_set(series, inventory, held)
    (root,) = whole["member"]
    assert "member_of" not in root and [m["_label"] if "_label" in m else None for m in root["member"]] == [None, "Leaf"]
    assert [m["_label"] for m in root["member"][1]["member"]] == ["Inventory 999", "Inventory 1053", "Inventory 1053A"]
    holdings.write_json(whole, str(tmp_path / "set.json.gz"))
    with gzip.open(tmp_path / "set.json.gz", "rt") as f:
        assert json.load(f) == whole
    titles, labels, places = snapshots.empty(spark, "inventory_title"), snapshots.empty(spark, "settlement_label"), table(spark, "settlement", [{"id": "p", "glob_id": "g1"}, {"id": "q", "glob_id": "g2"}])
    docs = table(spark, "document", [{"id": "a", "inventory_id": "999", "location_id": "p", "title": "T"}, {"id": "b", "inventory_id": "999", "location_id": "p"}, {"id": "c", "inventory_id": "1053", "location_id": "p"}, {"id": "d", "inventory_id": "1053", "location_id": "q"}])
    made = {r.inventory_number: json.loads(r.json) for r in holdings.inventories_jsonld(inventory, titles, docs, places, labels, series, held).collect()}
    assert made["999"]["produced_by"]["took_place_at"]["_label"] == "g1" and [p["_label"] for p in made["1053"]["produced_by"]["took_place_at"]] == ["g1", "g2"]
    assert made["1053A"]["produced_by"]["took_place_at"] is None and made["1053A"]["part"] == [] and made["1053A"]["produced_by"]["timespan"] is None
    assert made["999"]["member_of"] == [{"type": "Set", "_label": "Leaf", "member_of": {"type": "Set", "_label": 'Root "A"'}}]
    assert [p["_label"] for p in made["999"]["part"]] == ["T", "Document b"]
    classes = {"OUTER": ("u1", "Outer"), "INDEX": ("u2", "Index")}
    rows = spark.createDataFrame([("an OUTER INDEX",), ("INDEX",), ("other",), (None,)], "context string")
    assert [tuple(r.c) for r in rows.select(holdings.identifier_class("context", classes).alias("c")).collect()] == [("u1", "Type", "Outer"), ("u2", "Type", "Index"), (None, "Type", None), (None, "Type", None)]
