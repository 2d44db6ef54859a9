from __future__ import annotations

import pytest

from folioloom.sources import files, trees

TTL = """@prefix skos: <http://www.w3.org/2004/02/skos/core#> .
@prefix t: <http://x/thesaurus/> .
# a comment
t:11111111-1111-1111-1111-111111111111 a skos:Concept ; skos:inScheme t:kinds ;
  skos:prefLabel "brief"@nl, "letter \\"x\\""@en ; skos:note [ skos:value "inner" ] .
t:kinds skos:hasTopConcept <http://x/thesaurus/22222222-2222-2222-2222-222222222222> .
"""

EAD = """<ead><archdesc><dsc><c level="series"><did><unitid>1</unitid><unittitle>First   series</unittitle></did>
<c level="otherlevel" otherlevel="subseries"><did><unitid>1.1</unitid><unittitle>Sub</unittitle></did>
<c level="file"><did><unitid>10</unitid><unittitle>Ten</unittitle><unitdate normal="1610-02/1611"/><dao href="http://h/10"/></did></c></c>
<c level="subseries"><did><unitid>1.2</unitid><unittitle>Empty</unittitle></did><c level="file"><did><unitid>99</unitid></did></c></c>
</c></dsc></archdesc></ead>"""


def test_turtle(spark, tmp_path):
    (tmp_path / "t.ttl").write_text(TTL)
    rows = {tuple(r) for r in trees.triples(spark, str(tmp_path / "t.ttl")).collect()}
    key, skos = "http://x/thesaurus/11111111-1111-1111-1111-111111111111", trees.SKOS
    assert (key, skos + "prefLabel", "brief", "nl", False) in rows
    assert (key, skos + "prefLabel", 'letter "x"', "en", False) in rows
    assert (key, skos + "inScheme", "http://x/thesaurus/kinds", None, True) in rows
    assert len(rows) == 5


def test_finding_aid(tmp_path):
    path = tmp_path / "e.xml"
    path.write_text(EAD)
    got = trees.finding_aid(str(path), {"10"})
    assert [(s["id"], s["title"], s["part_of_id"]) for s in got["series"]] == [("1", "1 - First series", None), ("1/1.1", "1.1 - Sub", "1")]
    assert got["inventories"][0]["date_start"] == "1610-02-01" and got["inventories"][0]["date_end"] == "1611"
    assert got["inventory_series"] == [{"inventory_id": "10", "series_id": "1/1.1"}]


def test_names():
    assert trees.title_key("Condé-sur-l'Escaut") == "conde-sur-l-escaut"
    assert trees.code_key("7.27A, 7.37A") == "7.27A-7.37A"


def test_segmentation_files(spark, tmp_path):
    (tmp_path / "1_a.csv").write_text("﻿Scan File_Name ;TANAP Boundaries;TANAP ID;Subdocument boundaries;Type of non-document page\nf1;START;7;;\n\nf2;END;7;\"END;START\";x\n", encoding="utf-8")
    (tmp_path / "2_b.csv").write_text("Scan File_Name,TANAP Boundaries,TANAP ID,Subdocument boundaries,Type of non-document page\nf3,SAME AS f1,,,\n")
    got = {(r.file, r.filename, r.boundary, r.identifier, r.parts, r.other) for r in files.segmentation_rows(spark, str(tmp_path)).collect()}
    assert got == {("1_a.csv", "f1", "START", "7", None, None), ("1_a.csv", "f2", "END", "7", "END;START", "x"), ("2_b.csv", "f3", "SAME AS f1", None, None, None)}


def test_csv_and_json(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    head = ",".join(files.SCANS)
    a.write_text(f"{head}\n1,,f1,,http://i/info.json,10,20.0\n")
    b.write_text(f"{head}\n2,,f2,,,,\n")
    rows = {r.file_name_scan: (r.inventory_number, r.width, r.height) for r in files.scan_rows(spark, [str(a), str(b)]).collect()}
    assert rows == {"f1": ("1", 10, 20), "f2": ("2", 0, 0)}
    with pytest.raises(files.MissingColumns):
        files.page_rows(spark, [str(a)])
    j, k = tmp_path / "j.json", tmp_path / "k.json"
    j.write_text('{"1": ["1610"], "2": ["1611"]}')
    k.write_text('{"2": ["1700", "1701"]}')
    merged = files.merged_map(files.json_map(spark, str(j), "array<string>"), files.json_map(spark, str(k), "array<string>"))
    assert {r.key: r.value for r in merged.collect()} == {"1": ["1610"], "2": ["1700", "1701"]}
