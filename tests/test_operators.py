from __future__ import annotations

import random

from folioloom.operators import hierarchy, lookups, provenance, sequences
from folioloom.operators.boundaries import boundary_links
from folioloom.operators.state_machine import segment_file, segmentation_events


def random_pages(seed, inventories=6, scans=60):
    rng = random.Random(seed)
    out = []
    for inv in range(inventories):
        for n in range(scans):
            for side in rng.choice([["Verso", "Recto"], [None]]):
                out.append((inv, f"p{inv}_{n}_{side}", f"s{inv}_{n}", f"AR_{inv}_{n:04d}", n, side, rng.choice([True, False, False, None]), rng.choice(["sig", None, None, ""]), rng.choice([None, "77", str(n // 2), f"{n // 2}, {n // 2 + 3}"])))
    return out


PAGES = "inventory_id int, page_id string, scan_id string, filename string, scan_order int, recto_verso string, is_blank boolean, signatures string, page_or_folio_number string"


def ordered(pages, inv):
    return sorted((p for p in pages if p[0] == inv), key=lambda p: (p[3], {"Verso": 1, "Recto": 2}.get(p[5], 3), p[1]))


def test_baseline_segments(spark):
    pages = random_pages(1)
    want = {}
    for inv in range(6):
        doc, index, blank, signed = 0, 0, False, False
        for p in ordered(pages, inv)[1:]:
            if p[6]:
                blank = True
                continue
            if doc == 0 or blank or signed:
                doc, index = doc + 1, 0
            want[p[1]] = (doc, index)
            index, blank, signed = index + 1, False, bool(p[7])
    got = {r.page_id: (r.doc_no, r["index"]) for r in sequences.baseline_segments(spark.createDataFrame(pages, PAGES)).collect()}
    assert got == want


def test_gap_links(spark):
    rng = random.Random(3)
    pages = random_pages(2, 4, 80)
    scans = sorted({(p[0], p[2], p[3], p[4]) for p in pages})
    links = [(p[1], rng.choice("AB") if rng.random() < 0.9 else "C", rng.randrange(9), "FOLIO_RANGE" if rng.random() < 0.8 else "BASELINE") for p in pages if rng.random() < 0.35]
    links = sorted(set((a, f"{a.split('_')[0]}{b}", c, d) for a, b, c, d in links))
    want = {}
    for inv in range(4):
        mine = sorted((s for s in scans if s[0] == inv), key=lambda s: s[3])
        docs = [sorted({x[1] for x in links if x[3] == "FOLIO_RANGE" and x[0] in {p[1] for p in pages if p[2] == s[1]}}) for s in mine]
        i = 0
        while i < len(mine):
            j = i
            while j < len(mine) and not docs[j]:
                j += 1
            if j > i:
                if 0 < i and j < len(mine) and j - i <= 3 and len(docs[i - 1]) == 1 and docs[i - 1] == docs[j]:
                    for s in mine[i:j]:
                        for p in (p for p in pages if p[2] == s[1]):
                            have = [x for x in links if x[0] == p[1]]
                            if docs[j][0] not in [x[1] for x in have]:
                                want[(p[1], docs[j][0])] = max((x[2] for x in have), default=-1) + 1
                i = j
            else:
                i += 1
    df = spark.createDataFrame(pages, PAGES)
    got = sequences.gap_links(spark.createDataFrame(scans, "inventory_id int, scan_id string, filename string, scan_order int"), df, spark.createDataFrame(links, "page_id string, document_id string, index int, source string"), ["FOLIO_RANGE"], 3)
    assert {(r.page_id, r.document_id): r["index"] for r in got.collect()} == want
    assert want


def test_repeated_runs(spark):
    pages = [(0, f"p{n}", f"s{n}", f"f{n}", n, None, False, None, "5" if n in (1, 2, 3, 4, 9, 10, 11) else str(n)) for n in range(14)]
    scans = [(0, f"s{n}", f"f{n}", n) for n in range(14)]
    runs = sequences.repeated_runs(spark.createDataFrame(scans, "inventory_id int, scan_id string, filename string, scan_order int"), spark.createDataFrame(pages, PAGES), 3)
    assert {(r.folio, r.scan_id, r.length) for r in runs.collect()} == {(5, f"s{n}", 5) for n in (1, 2, 3, 4, 5)}


def test_long_ranges_join_by_comparison(spark, monkeypatch):
    pages = spark.createDataFrame([(0, "a", "s", "f", 1, None, False, None, "5, 9"), (0, "b", "s", "f", 1, None, False, None, "30")], PAGES)
    docs = spark.createDataFrame([(0, "d", 4, 20), (0, "e", 9, None), (0, "g", 9, 2), (1, "h", 1, 99)], "inventory_id int, id string, folio_start int, folio_end int")
    want = {("a", "d", 5), ("a", "e", 9), ("a", "g", 9)}
    assert {tuple(r) for r in sequences.folio_links(pages, docs).collect()} == want
    monkeypatch.setattr(sequences, "EXPLODED", 3)
    assert {tuple(r) for r in sequences.folio_links(pages, docs).collect()} == want
    have = spark.createDataFrame([("a", "d")], "page_id string, document_id string")
    assert {tuple(r) for r in sequences.folio_links(pages, docs, have).collect()} == want - {("a", "d", 5)}


def test_boundary_links(spark):
    base = spark.createDataFrame([(0, "B", f"p{i}", i) for i in range(6)], "inventory_id int, document_id string, page_id string, index int")
    docs = spark.createDataFrame([(0, "T", 10, 15)], "inventory_id int, id string, folio_start int, folio_end int")
    links = spark.createDataFrame([(f"p{i}", "T", 10 + i) for i in range(1, 5)], "page_id string, document_id string, index int")
    assert {tuple(r) for r in boundary_links(base, docs, links).collect()} == {("p0", "T", 10), ("p5", "T", 15)}


def test_boundary_claims_close_pages(spark):
    base = spark.createDataFrame([(0, "B", f"p{i}", i) for i in range(5)], "inventory_id int, document_id string, page_id string, index int")
    docs = spark.createDataFrame([(0, "T", 1, 3), (0, "U", 4, 6)], "inventory_id int, id string, folio_start int, folio_end int")
    links = spark.createDataFrame([("p0", "T", 1), ("p4", "U", 6)], "page_id string, document_id string, index int")
    assert {tuple(r) for r in boundary_links(base, docs, links).collect()} == {("p1", "T", 2), ("p2", "T", 3), ("p3", "U", 5)}


def row(n, name, boundary=None, identifier=None, parts=None, other=None):
    return {"row": n, "filename": name, "boundary": boundary, "identifier": identifier, "parts": parts, "other": other}


def test_segment_file():
    rows = [row(0, "a", "START", "T1"), row(1, "b", None, "T1", "START"), row(2, "c", "END", "T1", "END/START"), row(3, "d", "SAME AS e"), row(4, "e", "START", "T2", None, None), row(5, "x", None, "T2", None, "cover"), row(6, None, "START", "T9"), row(7, "g", "SAME AS x")]
    got = segment_file(rows, "12")
    assert {(g[1], g[2], g[3]) for g in got} == {
        ("a", "T1", None),
        ("b", "T1", None),
        ("b", "12-SUBDOC-0001", "T1"),
        ("c", "T1", None),
        ("c", "12-SUBDOC-0001", "T1"),
        ("c", "12-SUBDOC-0002", "T1"),
        ("d", "12-SUBDOC-0002", "T1"),
        ("d", "T2", None),
        ("e", "T2", None),
        ("e", "12-SUBDOC-0002", "T1"),
        ("g", "12-SUBDOC-0002", "T1"),
        ("g", "T2", None),
    }


def test_segment_file_same_as_end_and_order():
    """SAME AS links documents, not parts, and last; END closes only on a row with an identifier, as it is written."""
    rows = [row(0, "a", "START", "D1", "START"), row(1, "b", "END"), row(2, "c", None, None, "END/START"), row(3, "d", "end", "D2"), row(4, "e", None, None, "START"), row(5, "a", "SAME AS d"), row(6, "f", "SAME AS a"), row(7, "g", "END", "D2", "END"), row(8, "h", None, None, "START"), row(9, "i", "SAME AS nowhere")]
    got = segment_file(rows, "7")
    part_of = {g[2]: g[3] for g in got if g[4] == "part"}
    assert part_of == {"7-SUBDOC-0001": "D1", "7-SUBDOC-0002": "D1", "7-SUBDOC-0003": "D2", "7-SUBDOC-0004": None}
    by_reference = [g[:3] for g in got if g[0] in (5, 6, 9) and g[4] == "document"]
    assert by_reference == [(5, "a", "D2"), (6, "f", "D1")]
    assert [g[:3] for g in got[-2:]] == by_reference


def test_file_number_without_letters(spark):
    rows = [("1053_-_Document_Segmentation.csv", 0, "scan", "START", "T", "START", None)]
    got = segmentation_events(spark.createDataFrame(rows, "file string, row int, filename string, boundary string, identifier string, parts string, other string")).collect()
    assert {r.document for r in got} == {"T", "1053-SUBDOC-0001"} and sorted(r.seq for r in got) == [0, 1]


def test_segmentation_events_by_file(spark):
    rows = [("8697_x.csv", i, f"AR_8697_{i:04d}", "START" if i == 0 else "END" if i == 3 else None, "T" if i < 4 else None, "START" if i == 1 else None, None) for i in range(6)]
    got = segmentation_events(spark.createDataFrame(rows, "file string, row int, filename string, boundary string, identifier string, parts string, other string")).collect()
    assert {r.document for r in got} == {"T", "8697-SUBDOC-0001"}
    assert sum(r.document == "T" for r in got) == 4


def test_provenance(spark):
    links = spark.createDataFrame([("1", "p", "d", 0, "BASELINE", "DEFINITIVE"), ("2", "p", "d", 1, "X", "VALIDATED"), ("3", "q", "d", 0, "X", "odd")], "id string, page_id string, document_id string, index int, source string, confidence string")
    assert {r.id for r in provenance.strongest(links).collect()} == {"2", "3"}
    pages = spark.createDataFrame([("p",)], "page_id string")
    assert {r.id for r in provenance.supersede(links, pages).collect()} == {"2", "3"}
    gone = spark.createDataFrame([("p", "d")], "page_id string, document_id string")
    assert {r.id for r in provenance.delete_links(links, gone).collect()} == {"3"}
    assert {r.id for r in provenance.delete_links(links, gone, "X").collect()} == {"1", "3"}


def test_lookups(spark):
    scans = spark.createDataFrame([("1", "AR_1_0007"), ("2", "AR_1_7")], "scan_id string, filename string")
    rows = spark.createDataFrame([("AR_1_7",), ("AR_1_07",), ("AR_1_8",)], "name string")
    assert {(r["name"], r.scan_id) for r in lookups.file_lookup(rows, "name", scans).collect()} == {("AR_1_7", "2"), ("AR_1_07", "1"), ("AR_1_8", None)}
    spans = spark.createDataFrame([("k", "AR_1_", 5, 8), ("l", "AR_1_", 8, 5)], "k string, prefix string, a int, b int")
    assert [(r.k, r.scan_id, r.position) for r in lookups.interval_scans(spans, "k", "prefix", "a", "b", scans).collect()] == [("k", "1", 7)]
    doc = spark.createDataFrame([("a", None), ("b", " "), ("c", "t")], "id string, title string")
    new = spark.createDataFrame([(x, "n") for x in "abcd"], "id string, title string")
    assert {tuple(r) for r in lookups.update_columns(doc, new, "id", ["title"], replace=False).collect()} == {("a", "n"), ("b", "n"), ("c", "t")}
    assert {tuple(r) for r in lookups.update_columns(doc, new, "id", ["title"]).collect()} == {("a", "n"), ("b", "n"), ("c", "n")}


def test_hierarchy(spark):
    s = spark.createDataFrame([("a", "A", None), ("b", "B", "a"), ("c", "C", "b"), ("x", "X", None)], "id string, title string, part_of_id string")
    assert {(r.id, r.path) for r in hierarchy.paths(s).collect()} == {("a", "A"), ("b", "A > B"), ("c", "A > B > C"), ("x", "X")}
    assert {r.id for r in hierarchy.closure(s, spark.createDataFrame([("c",)], "id string")).collect()} == {"a", "b", "c"}
    loop = spark.createDataFrame([("a", "A", "b"), ("b", "B", "a")], "id string, title string, part_of_id string")
    assert hierarchy.ancestors(loop, 5).count() == 12


def test_hierarchy_has_no_depth_cap(spark):
    deep = spark.createDataFrame([(i, f"t{i}", i - 1 if i else None) for i in range(24)], "id long, title string, part_of_id long").coalesce(1)
    assert hierarchy.ancestors(deep).where("id = 23").count() == 24
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "id string, part_of_id string")
    assert sorted(map(tuple, hierarchy.ancestors(loop).collect())) == [("a", "a", 0), ("a", "b", 1), ("b", "a", 1), ("b", "b", 0), ("c", "a", 1), ("c", "b", 2), ("c", "c", 0)]
