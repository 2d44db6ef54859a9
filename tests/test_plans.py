from __future__ import annotations

import datetime as dt
import gzip
import json

from pyspark.sql import functions as F

from folioloom import snapshots
from folioloom.plans import exports, stages
from folioloom.streaming import FOLIO_PAGE, link_new_pages


def scan_rows(spark):
    rows = [("1", "{ABCDEF00-0000-0000-0000-000000000001}", "AR_1_0001", None, "http://i/1/info.json", 800, 1000, 0), ("1", "x", "AR_1_0001", None, "other", 1, 1, 1), ("1", None, "AR_1_0002", "http://web/2", "http://i/2/info.json", 800, 1000, 2), ("2", "bad", "AR_2_0001", None, None, 0, 0, 3)]
    return spark.createDataFrame(rows, "inventory_number string, na_identifier_inventory string, file_name_scan string, na_identifier_scan string, iiif_info_url string, width int, height int, seq int")


def imported(spark):
    dates = spark.createDataFrame([("1", ["1610", "1611-02/1611-02"]), ("2", ["1610-02"])], "key string, value array<string>")
    handles = spark.createDataFrame([("1", "http://h/1")], "key string, value string")
    titles = spark.createDataFrame([("1", ["A", "B"]), ("9", ["C"])], "key string, value array<string>")
    t = stages.import_scans(scan_rows(spark), dates, handles, titles)
    pages = spark.createDataFrame([("AR_1_0001", "1", "double", "['First']", None, "['5 ', '6']", True, False), ("AR_1_0002", "1", "single", "[]", "sig", None, None, None), ("AR_9_0001", "9", "single", None, None, None, None, None)], "doc_id string, inventory string, scan_type string, headers string, signature_marks string, page_numbers string, has_marginalia boolean, is_blank boolean")
    return t | stages.import_pages(pages, t["scan"])


def test_imports(spark):
    t = imported(spark)
    inv = {r.inventory_number: r for r in t["inventory"].collect()}
    assert (inv["1"].na_identifier, inv["1"].date_start, inv["1"].date_end) == ("abcdef00-0000-0000-0000-000000000001", dt.date(1610, 1, 1), dt.date(1611, 2, 28))
    assert (inv["2"].na_identifier, inv["2"].date_start) == (None, None)
    assert sorted(r.title for r in t["inventory_title"].collect()) == ["A", "B"]
    scans = {r.filename: r for r in t["scan"].collect()}
    assert scans["AR_1_0001"].iiif_image_info == "http://i/1/info.json" and scans["AR_1_0001"].scan_type == "Double" and scans["AR_2_0001"].scan_type is None
    pages = t["page"].collect()
    assert sorted((p.recto_verso or "", p.page_or_folio_number) for p in pages) == [("", None), ("Recto", "5,6"), ("Verso", "5,6")]
    assert snapshots.violations({k: snapshots.conform(v, k) for k, v in t.items()}).count() == 0


def test_violations_and_round_trip(spark, tmp_path):
    t = imported(spark)
    snapshots.save(t, str(tmp_path))
    back = snapshots.load(spark, str(tmp_path), "scan", "page")
    assert back["page"].count() == 3
    broken = back | {"scan": back["scan"].limit(1), "inventory": snapshots.conform(t["inventory"].unionByName(t["inventory"]), "inventory")}
    found = {(r.table, r.rule) for r in snapshots.violations(broken).collect()}
    assert ("inventory", "unique id") in found and any(t == "page" and "scan_id" in rule for t, rule in found)


def test_updates(spark):
    t = imported(spark)
    texts = spark.createDataFrame([("AR_1_0001", "x" * 30), ("AR_1_0001", None), (" AR_1_0002 ", "short"), ("nope", "")], "filename string, normalized_text string")
    flags = {r.recto_verso: r.is_blank for r in stages.blank_pages(texts, t["scan"], t["page"]).collect()}
    assert flags == {"Verso": False, "Recto": False, None: True}
    notes = spark.createDataFrame([("AR_1_0001", True, False, True, 0), ("AR_1_0001", False, True, True, 1)], "filename string, transcriptions boolean, entities boolean, events boolean, seq int")
    got = {r.filename: (r.has_transcriptions, r.has_entities, r.has_events) for r in stages.annotation_flags(t["scan"], notes).collect()}
    assert got == {"AR_1_0001": (False, True, True), "AR_1_0002": (False,) * 3, "AR_2_0001": (False,) * 3}
    langs = spark.createDataFrame([("AR_1_0002", "nld,fra", 0), ("AR_1_0002", "eng", 1)], "scan string, langs string, seq int")
    assert {r.filename: r.languages for r in stages.scan_languages(t["scan"], langs).collect()}["AR_1_0002"] == "nld,fra"
    assert {r.filename: r.scan_order for r in stages.number_scans(t["scan"]).collect()} == {"AR_1_0001": 1, "AR_1_0002": 2, "AR_2_0001": 1}


def test_baseline_titles_and_manifest(spark, tmp_path):
    t = imported(spark)
    base = stages.baseline_documents(t["page"], t["scan"], "m")
    document = snapshots.conform(base["document"], "document")
    assert document.count() >= 1
    assert stages.baseline_documents(t["page"], t["scan"], "m", document)["document"].count() == 0
    titled = stages.header_titles(document, base["page2document"], t["page"].withColumn("header", F.lit("['A', ' head']")), t["scan"], "m")
    assert {r.title for r in titled.collect()} == {"A head"}
    titles = t["inventory_title"].select("inventory_id", F.col("title").alias("seq"), F.col("title").alias("value"))
    made = exports.manifests(snapshots.conform(t["inventory"], "inventory"), t["scan"].withColumn("has_entities", F.lit(True)), t["page"], titled, base["page2document"], titles)
    m = {r.inventory_number: json.loads(r.json) for r in made.collect()}
    one = m["1"]
    assert one["type"] == "Manifest" and one["navDate"] == "1610-01-01T00:00:00+00:00"
    assert [c["label"]["en"][0] for c in one["items"]] == ["AR_1_0001", "AR_1_0002"]
    assert one["metadata"][3]["value"]["none"] == ["A; B"] and one["metadata"][4]["value"]["none"] == ["http://h/1"]
    assert one["items"][0]["metadata"][1]["value"]["none"] == ["Recto, Verso"]
    assert one["items"][0]["annotations"][0]["label"]["en"] == ["Entities identified on scan AR_1_0001"]
    assert one["items"][0]["items"][0]["items"][0]["body"]["id"] == "http://i/1/full/max/0/default.jpg"
    assert one["structures"][0]["items"][0]["label"]["en"] == ["A head"]
    exports.write_gzip(made, "inventory_number", str(tmp_path / "out"))
    with gzip.open(tmp_path / "out" / "1.json.gz", "rt") as f:
        assert json.load(f) == one
    docs = [json.loads(r.json) for r in exports.documents_jsonld(titled, base["page2document"], t["page"], t["scan"]).collect()]
    assert all(d["identified_by"]["content"] == "A head" for d in docs)
    both = json.loads(exports.collection(t["inventory"]).head()[0])
    assert [i["label"]["en"][0] for i in both["items"]] == ["Inventory 1", "Inventory 2"]


def test_ranges_are_nested(spark):
    def rows(name, *values):
        schema = snapshots.SCHEMAS[name]
        return spark.createDataFrame([tuple(v.get(c) for c in schema.names) for v in values], schema)

    inventory = rows("inventory", {"id": "i", "inventory_number": "7"}, {"id": "j", "inventory_number": "8"})
    scan = rows("scan", *[{"id": f"s{n}", "filename": f"f{n}", "inventory_id": "i", "iiif_image_info": f"http://x/{n}/info.json", "height": 2, "width": 1} for n in range(3)])
    page = rows("page", *[{"id": f"p{n}", "scan_id": f"s{n // 2}", "inventory_id": "i"} for n in range(6)])
    document = rows("document", {"id": "whole-document", "inventory_id": "i", "title": 'A "title"', "date_text": "May"}, {"id": "part-one", "inventory_id": "i", "part_of_id": "whole-document"}, {"id": "part-two", "inventory_id": "i", "part_of_id": "whole-document", "date_latest_end": dt.date(1700, 1, 2)}, {"id": "unlinked", "inventory_id": "i"})
    link = rows("page2document", *[{"page_id": f"p{n}", "document_id": d, "index": i} for d, n, i in [("whole-document", 0, 0), ("part-one", 5, 4), ("part-one", 0, 5), ("part-one", 1, 6), ("part-two", 2, 1)]])
    types = spark.createDataFrame([("part-one", "Letter")], "document_id string, label string")
    ids = spark.createDataFrame([("part-one", "tanap", "T1"), ("part-one", "OTHER", "o1"), ("part-one", None, "x")], "document_id string, context string, identifier string")
    made = {r.inventory_number: json.loads(r.json) for r in exports.manifests(inventory, scan, page, document, link, types=types, identifiers=ids).collect()}
    assert "structures" not in made["8"] and "thumbnail" not in made["8"]
    assert made["7"]["thumbnail"][0]["id"] == "http://x/0/full/982,/0/default.jpg" and made["7"]["thumbnail"][0]["service"][0]["@id"] == "http://x/0"
    (top,) = made["7"]["structures"]
    whole, other = top["items"]
    assert whole["id"].endswith("/range/doc-0-whole-do") and whole["label"] == {"en": ['A "title"']} and other["label"] == {"en": ["Document unlinked"]} and other["items"] == []
    two, one = whole["items"]
    assert two["id"].endswith("/range/doc-doc-0-whole-do-sub0-part-two") and [c["id"].rsplit(":", 1)[1] for c in one["items"]] == ["f2", "f0"]
    said = [(m["label"]["en"][0], *m["value"].values()) for m in one["metadata"]]
    assert said == [("Type", ["Letter"]), ("Inventory number", ["7"]), ("OTHER ID", ["o1"]), ("TANAP-id", ["T1"]), ("Identifier", ["part-one"])]
    assert [(m["label"]["en"][0], m["value"]) for m in whole["metadata"]][:2] == [("Title", {"en": ['A "title"']}), ("Date", {"none": ["May"]})]
    assert two["metadata"][0]["value"] == {"none": ["1700-01-02"]} and one["seeAlso"][0]["id"].endswith("document:part-one")


def test_catalogue_and_letters(spark):
    t = imported(spark)
    labels = spark.createDataFrame([("Batavia", "s1", 0), ("batavia ", "s2", 1)], "label string, settlement_id string, seq int")
    types = spark.createDataFrame([("abcdef00-0000-0000-0000-000000000001",)], "id string")
    names = {"title": "T", "number": "N", "from_year": "Y1", "to_year": "Y2", "type_a": "A", "type_b": "B", "place": "P", "first": "F", "last": "L", "key": "K"}
    rows = spark.createDataFrame([("Letter", "1", "1610", "1611", "http://x/abcdef00-0000-0000-0000-000000000001", None, " BATAVIA", "5", "7", "k1", "o1"), ("Bad", "1", "x", None, "#NAME?", None, None, None, None, "k2", None), ("Lost", "77", None, None, None, None, None, None, None, "k3", None)], "T string, N string, Y1 string, Y2 string, A string, B string, P string, F string, L string, K string, O string")
    got = stages.import_catalogue(rows, names, t["inventory"], labels, types, "m", {"O": "OUTER"})
    (d,) = got["document"].collect()
    assert (d.title, d.location_id, d.folio_start, d.folio_end, d.date_earliest_begin, d.date_latest_end) == ("Letter", "s2", 5, 7, dt.date(1610, 1, 1), dt.date(1611, 12, 31))
    assert got["document2documenttype"].count() == 1 and [r.identifier for r in got["external_id"].collect()] == ["o1"]
    letters = spark.createDataFrame([("a", "1", "L", "1 May", "1610-05-01", "AR_1_0001", "1", "2")], "key string, number string, title string, date_text string, date string, first_scan string, begin string, end string")
    made = stages.import_letters(letters, t["scan"], t["page"], t["inventory"], "g")
    assert sorted(r["index"] for r in made["page2document"].collect()) == [0, 1, 2]
    places = stages.import_settlements(spark.createDataFrame([("Batavia", "g1"), ("Batavia", "g1")], "label string, glob_id string"), snapshots.empty(spark, "settlement"), snapshots.empty(spark, "settlement_label"))
    assert places["settlement"].count() == places["settlement_label"].count() == 1


def test_validated_links_supersede(spark):
    t = imported(spark)
    pages = {(r.recto_verso or "S"): r.id for r in t["page"].collect()}
    rows = spark.createDataFrame([("1_x.csv", 0, "AR_1_0001", "START", "T", None, None)], "file string, row int, filename string, boundary string, identifier string, parts string, other string")
    old = spark.createDataFrame([("a", pages["Verso"], "d", 0, "BASELINE", "DEFINITIVE"), ("b", pages["Recto"], "d", 1, "X", "VALIDATED"), ("c", pages["S"], "d", 2, "BASELINE", "DEFINITIVE")], "id string, page_id string, document_id string, index int, source string, confidence string")
    got = stages.validated_links(rows, t["page"], t["scan"], old)
    assert got["new"].count() == 2
    assert {r.id for r in got["page2document"].collect()} & {"a", "b", "c"} == {"b", "c"}


def test_validated_links_leave_other_documents_alone(spark):
    """Weak links go from pages that the files link, and of documents that they name, wherever; not from pages such a document was on before."""
    t = imported(spark)
    pages = {(r.recto_verso or "S"): r.id for r in t["page"].collect()}
    rows = spark.createDataFrame([("1_x.csv", 0, "AR_1_0001", "START", "T", None, None)], "file string, row int, filename string, boundary string, identifier string, parts string, other string")
    links = "id string, page_id string, document_id string, index int, source string, confidence string"
    first = stages.validated_links(rows, t["page"], t["scan"], spark.createDataFrame([], links))["new"]
    mine = first.first().document_id
    old = spark.createDataFrame([("weak", pages["S"], mine, 0, "X", "CANDIDATE"), ("signed", pages["S"], mine, 1, "X", "VALIDATED"), ("other", pages["S"], "E", 0, "X", "CANDIDATE")], links)
    got = stages.validated_links(rows, t["page"], t["scan"], old)["page2document"]
    assert {r.id for r in got.collect()} & {"weak", "signed", "other"} == {"signed", "other"}


def test_stream_of_pages(spark, tmp_path):
    docs = spark.createDataFrame([("1", "d", 4, 6)], "inventory_id string, id string, folio_start int, folio_end int")
    spark.createDataFrame([("1", "p", "5"), ("1", "q", "9")], FOLIO_PAGE).write.parquet(str(tmp_path / "in"))
    link_new_pages(spark, str(tmp_path / "in"), docs, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    spark.createDataFrame([("1", "r", "6")], FOLIO_PAGE).write.mode("append").parquet(str(tmp_path / "in"))
    link_new_pages(spark, str(tmp_path / "in"), docs, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert {(r.page_id, r["index"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("p", 5), ("r", 6)}
