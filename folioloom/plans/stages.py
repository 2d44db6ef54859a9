"""Import and derivation stages. Each takes DataFrames and gives the tables or changes it makes; nothing is updated in place.

Ids are name-based hashes of natural keys, so a stage gives the same rows when it
is run again, and skipping what exists is an anti-join on the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import date_range, dates_of, languages, name_id, placeholder, scan_order, scan_type, strip, to_int, type_ids, uuid_or_null, year_end, year_start
from ..functions.literals import parse_folios, parse_header
from ..operators import lookups, provenance, sequences
from ..operators.hierarchy import closure
from ..operators.state_machine import segmentation_events
from ..schemas import CONFIDENCE


def inventory_id(number):
    return name_id(F.lit("inventory"), number)


def import_scans(rows: DataFrame, dates: DataFrame, handles: DataFrame, titles: DataFrame) -> dict[str, DataFrame]:
    """Inventories, their titles, and scans, from scan rows with `seq`, their order.

    The first row of an inventory gives its identifier, be it null; the first row
    of a file name gives the scan. One unreadable date voids an inventory's dates.
    """
    first = rows.where("inventory_number is not null").groupBy("inventory_number").agg(F.min_by(F.struct("na_identifier_inventory"), "seq").alias("f"))
    span = dates.select(F.col("key").alias("inventory_number"), dates_of("value").alias("d"))
    inv = first.join(span, "inventory_number", "left").join(handles.select(F.col("key").alias("inventory_number"), F.col("value").alias("handle")), "inventory_number", "left")
    inventory = inv.select(inventory_id("inventory_number").alias("id"), "inventory_number", uuid_or_null("f.na_identifier_inventory").alias("na_identifier"), "handle", F.col("d.first").alias("date_start"), F.col("d.last").alias("date_end"))
    title = titles.join(first.select(F.col("inventory_number").alias("key")), "key", "left_semi").select(inventory_id("key").alias("inventory_id"), F.posexplode("value").alias("n", "title"))
    title = title.select(name_id("inventory_id", "n", "title").alias("id"), "title", "inventory_id")
    scan = sequences.keep_first(rows.where("file_name_scan is not null"), ["file_name_scan"], ["seq"])
    off = F.lit(False)
    scan = scan.select(name_id(F.lit("scan"), "file_name_scan").alias("id"), F.col("file_name_scan").alias("filename"), uuid_or_null("na_identifier_scan").alias("na_identifier"), F.col("iiif_info_url").alias("iiif_image_info"), inventory_id("inventory_number").alias("inventory_id"), F.coalesce("height", F.lit(0)).alias("height"), F.coalesce("width", F.lit(0)).alias("width"), F.lit(None).cast("string").alias("scan_type"), off.alias("has_transcriptions"), off.alias("has_entities"), off.alias("has_events"), F.lit(None).cast("int").alias("scan_order"), F.lit(None).cast("string").alias("languages"))
    return {"inventory": inventory, "inventory_title": title, "scan": scan}


def import_pages(rows: DataFrame, scan: DataFrame) -> dict[str, DataFrame]:
    """Scans with their types, and a page for each side of a double scan or one for another scan; rows of unknown scans are dropped."""
    typed = rows.withColumn("_type", scan_type("scan_type")).join(scan.select(F.col("filename").alias("doc_id"), F.col("id").alias("scan_id"), "inventory_id"), "doc_id")
    types = typed.groupBy(F.col("scan_id").alias("id")).agg(F.max("_type").alias("scan_type"))
    sides = F.when(F.col("_type") == "Double", F.array(F.lit("Verso"), F.lit("Recto"))).otherwise(F.array(F.lit(None).cast("string")))
    page = typed.withColumn("recto_verso", F.explode(sides))
    none = F.lit(None).cast("boolean")
    page = page.select(name_id(F.lit("page"), "doc_id", "recto_verso").alias("id"), parse_folios("page_numbers").alias("page_or_folio_number"), "recto_verso", F.col("headers").alias("header"), "inventory_id", "scan_id", F.lit(None).cast("string").alias("detected_languages"), F.lit(0).alias("rotation"), F.col("signature_marks").alias("signatures"), "has_marginalia", none.alias("has_table"), none.alias("has_illustration"), none.alias("has_print"), "is_blank")
    return {"scan": lookups.update_columns(scan, types, "id", ["scan_type"]), "page": page}


def import_hierarchy(series: DataFrame, links: DataFrame, numbers: DataFrame, inventory: DataFrame, only_relevant: bool = False) -> dict[str, DataFrame]:
    """Series and their inventories, by inventory number. numbers: id, inventory_number of the hierarchy file."""
    known = numbers.join(inventory.select("inventory_number", F.col("id").alias("inventory_id")), "inventory_number").select(F.col("id").alias("_file_id"), "inventory_id")
    inventory_series = links.withColumnRenamed("inventory_id", "_file_id").join(known, "_file_id").select("inventory_id", "series_id").distinct()
    kept = series.select("id", "title", "part_of_id")
    if only_relevant:
        kept = kept.join(closure(kept, inventory_series.select(F.col("series_id").alias("id")).distinct()), "id", "left_semi")
    return {"series": kept, "inventory_series": inventory_series}


def blank_pages(texts: DataFrame, scan: DataFrame, page: DataFrame, threshold: int = 20) -> DataFrame:
    """Pages with is_blank set where the longest text of their scan is known: shorter than `threshold` characters."""
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    flags = texts.where("filename is not null and trim(filename) <> ''").groupBy(F.trim("filename").alias("filename")).agg((F.max(F.length(F.coalesce("normalized_text", F.lit("")))) < threshold).alias("is_blank"))
    of = flags.join(scan.select(F.col("filename"), F.col("id").alias("scan_id")), "filename").groupBy("scan_id").agg(F.max("is_blank").alias("is_blank"))
    return lookups.update_columns(page, of, "scan_id", ["is_blank"])


def baseline_documents(page: DataFrame, scan: DataFrame, method_id: str, existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """Documents and links of the baseline segmentation; inventories that have documents of the method are left alone."""
    pages = page.select(F.col("id").alias("page_id"), "scan_id", "recto_verso", "is_blank", "signatures").join(scan.select(F.col("id").alias("scan_id"), "filename", "inventory_id"), "scan_id")
    if existing is not None:
        pages = pages.join(existing.where(F.col("method_id") == method_id).select("inventory_id").distinct(), "inventory_id", "left_anti")
    segments = sequences.baseline_segments(pages).withColumn("document_id", name_id(F.lit(method_id), "inventory_id", "doc_no"))
    documents = segments.select(F.col("document_id").alias("id"), "inventory_id", F.lit(method_id).alias("method_id")).distinct()
    return {"document": documents, "page2document": provenance.as_links(segments)}


def thesaurus_concepts(triples: DataFrame, schemes: dict[str, str]) -> DataFrame:
    """(id, scheme, pref_label_nl, pref_label_en) of concepts; schemes: URI to name. A concept of two schemes has two rows."""
    skos = "http://www.w3.org/2004/02/skos/core#"
    names = F.create_map(*[F.lit(x) for kv in schemes.items() for x in kv])
    member = triples.where(F.col("is_uri") & (F.col("predicate") == f"{skos}inScheme")).select(F.col("subject").alias("uri"), F.col("object").alias("scheme"))
    top = triples.where(F.col("is_uri") & (F.col("predicate") == f"{skos}hasTopConcept")).select(F.col("object").alias("uri"), F.col("subject").alias("scheme"))
    both = member.union(top).distinct().where(F.col("scheme").isin(list(schemes)))
    labels = triples.where(F.col("predicate") == f"{skos}prefLabel").groupBy(F.col("subject").alias("uri")).agg(*[F.min(F.when(F.col("lang") == lang, F.col("object"))).alias(f"pref_label_{lang}") for lang in ("nl", "en")])
    return both.join(labels, "uri", "left").select(uuid_or_null(F.regexp_extract("uri", "([0-9a-fA-F-]{32,36})$", 1)).alias("id"), names[F.col("scheme")].alias("scheme"), "pref_label_nl", "pref_label_en").where("id is not null")


def import_settlements(rows: DataFrame, settlement: DataFrame, label: DataFrame) -> dict[str, DataFrame]:
    """New settlements and labels only."""
    rows = rows.select("label", "glob_id", name_id(F.lit("settlement"), "glob_id").alias("settlement_id")).distinct()
    new = rows.select(F.col("settlement_id").alias("id"), "glob_id").distinct().join(settlement.select("glob_id"), "glob_id", "left_anti")
    labels = rows.select(name_id("settlement_id", "label").alias("id"), "label", "settlement_id").join(label.select("label", "settlement_id"), ["label", "settlement_id"], "left_anti")
    return {"settlement": new.select("id", "glob_id"), "settlement_label": labels}


def import_catalogue(rows: DataFrame, columns: dict[str, str], inventory: DataFrame, labels: DataFrame, types: DataFrame, method_id: str, contexts: dict[str, str]) -> dict[str, DataFrame]:
    """Documents of a catalogue with their types and outer identifiers.

    columns: our names (title, number, from_year, to_year, type_a, type_b, place,
    first, last, key) to the file's; contexts: identifier columns to context names.
    Rows whose types are placeholders are skipped. labels: label, settlement_id,
    seq; of equal ones the last counts.
    """
    named = rows.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()], *[F.col(f"`{c}`").alias(f"_id_{i}") for i, c in enumerate(contexts)])
    good = named.where(~placeholder("type_a") & ~placeholder("type_b"))
    inv = inventory.select(F.col("inventory_number").alias("number"), F.col("id").alias("inventory_id"))
    placed = lookups.lookup_last(good.withColumn("number", strip("number")).join(inv, "number"), "place", labels, "label", "settlement_id", "seq")
    docs = placed.withColumn("id", name_id(F.lit(method_id), "key"))
    document = docs.select("id", "inventory_id", "title", year_start("from_year").alias("date_earliest_begin"), year_end("from_year").alias("date_latest_begin"), year_start("to_year").alias("date_earliest_end"), year_end("to_year").alias("date_latest_end"), F.col("settlement_id").alias("location_id"), to_int("first").alias("folio_start"), to_int("last").alias("folio_end"), F.lit(method_id).alias("method_id")).dropDuplicates(["id"])
    link = docs.select("id", F.explode(F.array_distinct(F.concat(F.coalesce(type_ids("type_a"), F.array().cast("array<string>")), F.coalesce(type_ids("type_b"), F.array().cast("array<string>"))))).alias("document_type_id")).distinct()
    link = link.join(types.select(F.col("id").alias("document_type_id")), "document_type_id", "left_semi").select(name_id("id", "document_type_id").alias("_i"), F.col("id").alias("document_id"), "document_type_id").withColumnRenamed("_i", "id")
    pairs = F.array(*[F.struct(F.lit(context).alias("context"), strip(f"_id_{i}").alias("identifier")) for i, context in enumerate(contexts.values())])
    ids = docs.select(F.col("id").alias("document_id"), F.inline(pairs)).where("identifier is not null and identifier <> ''").withColumn("external_id", name_id("context", "identifier"))
    return {"document": document, "document2documenttype": link, "external_id": ids.select(F.col("external_id").alias("id"), F.lit(None).cast("string").alias("url"), "identifier", "context").distinct(), "document2external_id": ids.select(name_id("document_id", "external_id").alias("id"), "document_id", "external_id").distinct()}


def import_letters(rows: DataFrame, scan: DataFrame, page: DataFrame, inventory: DataFrame, method_id: str) -> dict[str, DataFrame]:
    """Letters with dated spans of scans. rows: key, number, title, date_text, date, first_scan (a file name), begin, end (scan numbers)."""
    inv = inventory.select(F.col("inventory_number").alias("number"), F.col("id").alias("inventory_id"))
    docs = rows.withColumn("number", strip("number")).join(inv, "number").withColumn("id", name_id(F.lit(method_id), "key")).withColumn("d", date_range("date"))
    document = docs.select("id", "inventory_id", "title", "date_text", F.col("d.begin").alias("date_earliest_begin"), F.col("d.begin").alias("date_latest_begin"), F.col("d.end").alias("date_earliest_end"), F.col("d.end").alias("date_latest_end"), F.lit(method_id).alias("method_id"))
    spans = docs.withColumn("prefix", F.regexp_replace("first_scan", r"\d+$", "")).withColumn("a", to_int("begin")).withColumn("b", F.coalesce(to_int("end"), to_int("begin")))
    scans = scan.select(F.col("id").alias("scan_id"), "filename")
    on = lookups.interval_scans(spans, "id", "prefix", "a", "b", scans).join(page.select(F.col("id").alias("page_id"), "scan_id", "recto_verso"), "scan_id")
    order = Window.partitionBy("id").orderBy("position", F.when(F.col("recto_verso") == "Verso", 1).otherwise(2), "page_id")
    links = on.select("page_id", F.col("id").alias("document_id"), (F.row_number().over(order) - 1).alias("index"))
    return {"document": document, "page2document": provenance.as_links(links)}


def annotation_flags(scan: DataFrame, rows: DataFrame) -> DataFrame:
    """Scans with all flags reset and set from the rows; of equal file names the last row (`seq`) counts."""
    last = sequences.keep_last(rows, ["filename"], "seq")
    joined = scan.drop("has_transcriptions", "has_entities", "has_events").join(last.select("filename", "transcriptions", "entities", "events"), "filename", "left")
    return joined.withColumns({f"has_{c}": F.coalesce(c, F.lit(False)) for c in ("transcriptions", "entities", "events")}).select(scan.columns)


def number_scans(scan: DataFrame) -> DataFrame:
    return scan.withColumn("scan_order", scan_order("filename"))


def scan_languages(scan: DataFrame, rows: DataFrame) -> DataFrame:
    """Scans with the languages of the first row (`seq`) of their file name."""
    first = sequences.keep_first(rows.where("scan is not null"), ["scan"], ["seq"]).select(F.col("scan").alias("filename"), F.col("langs").alias("languages"))
    return lookups.update_columns(scan, first, "filename", ["languages"])


def header_titles(document: DataFrame, link: DataFrame, page: DataFrame, scan: DataFrame, method_id: str, overwrite: bool = False) -> DataFrame:
    """Documents of a method with the first header of their pages as title; blank titles only, unless `overwrite`."""
    headers = page.select(F.col("id").alias("page_id"), "header", "scan_id").join(scan.select(F.col("id").alias("scan_id"), "filename"), "scan_id", "left")
    mine = link.join(document.where(F.col("method_id") == method_id).select(F.col("id").alias("document_id")), "document_id", "left_semi")
    first = sequences.first_titles(mine, headers, ["index", "filename", "page_id"])
    titles = first.select(F.col("document_id").alias("id"), parse_header("header").alias("title")).where("title is not null")
    return lookups.update_columns(document, titles, "id", ["title"], replace=overwrite)


def validated_links(rows: DataFrame, page: DataFrame, scan: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """Links of validated segmentation files, and all links after them.

    On pages that the files link, and of documents that they name, links weaker
    than a sign-off go; a document's other links elsewhere do not concern the
    documents that share their pages. Indices follow the order of the links in
    their file, so those by reference to another scan come last.
    """
    events = segmentation_events(rows)
    sides = page.select(F.col("id").alias("page_id"), "scan_id", "recto_verso").join(scan.select(F.col("id").alias("scan_id"), "filename"), "scan_id")
    on = events.join(sides, "filename").groupBy("file", "document", "page_id").agg(F.min("seq").alias("seq"), F.first("recto_verso").alias("recto_verso"))
    order = Window.partitionBy("document").orderBy("file", "seq", F.when(F.col("recto_verso") == "Recto", 1).otherwise(2), "page_id")
    new = provenance.as_links(on.select("page_id", name_id(F.lit("segment"), "document").alias("document_id"), (F.row_number().over(order) - 1).alias("index")), "SEGMENTATION", "DEFINITIVE")
    left = provenance.supersede(links, new, CONFIDENCE[0])
    left = provenance.supersede(left, new, CONFIDENCE[0], "document_id")
    return {"new": new, "page2document": left.unionByName(new)}
