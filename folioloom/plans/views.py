"""Views with parameters: a page of a list with its totals, and the details of one record.

Lists are ordered in full, so a page of them is the same each time, and take one
page only (a sort of page times size rows at most). Nulls come last. A parameter
that is None or empty does not filter.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contains_folded, coverage, feature_labels, natural_key

#: Rows of a page of each list.
INVENTORIES, SCANS, PAGES, PLACES, METHODS, DOCUMENTS = 20, 30, 20, 50, 50, 20
SHOWN_SCANS = 50


class Listed(NamedTuple):
    """Rows of one page, and (total, pages): one row about the whole list."""

    rows: DataFrame
    totals: DataFrame


def listed(rows: DataFrame, order: list[Column | str], page: int = 1, size: int = 20, counted: DataFrame | None = None) -> Listed:
    """counted: the rows that the total is of, if other than those listed."""
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    total = (rows if counted is None else counted).agg(F.count("*").alias("total"))
    return Listed(rows.orderBy(*order).offset((page - 1) * size).limit(size), total.select("total", F.ceil(F.col("total") / size).alias("pages")))


def wanted(rows: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column has the value; all if no value is given."""
    return rows if value is None or value == "" else rows.where(F.col(column) == value)


def one(rows: DataFrame, column: str, value) -> DataFrame:
    """The one row with the value; LookupError without any."""
    found = rows.where(F.col(column) == value).limit(1)
    if found.isEmpty():
        raise LookupError(f"no row has {column} = {value!r}")
    return found


def inventory_list(inventory: DataFrame, page: int = 1) -> Listed:
    return listed(inventory, [natural_key("inventory_number"), "id"], page, INVENTORIES)


def inventory_documents(document: DataFrame, link: DataFrame, page: DataFrame, scan: DataFrame, inventory_id) -> DataFrame:
    """Documents of an inventory with the files of their first and last page by index (ties by file, then page); null without pages."""
    mine = wanted(document, "inventory_id", inventory_id)
    files = page.select(F.col("id").alias("page_id"), "scan_id").join(scan.select(F.col("id").alias("scan_id"), "filename"), "scan_id", "left")
    on = link.join(mine.select(F.col("id").alias("document_id")), "document_id", "left_semi").join(files, "page_id")
    order = F.struct("index", "filename", "page_id")
    ends = on.groupBy("document_id").agg(F.min_by(F.struct("filename"), order).alias("a"), F.max_by(F.struct("filename"), order).alias("b"))
    return mine.join(ends, F.col("id") == F.col("document_id"), "left").select(mine["*"], F.col("a.filename").alias("first_scan_filename"), F.col("b.filename").alias("last_scan_filename"))


def page_info(page: DataFrame, link: DataFrame) -> DataFrame:
    """Pages with the names of their features and whether any document has them."""
    held = page.join(link.select(F.col("page_id").alias("id")).distinct().withColumn("in_document", F.lit(True)), "id", "left")
    features = feature_labels(*[F.col(c) for c in ("is_blank", "has_marginalia", "has_table", "has_illustration", "has_print", "signatures")])
    return held.select("id", "scan_id", "recto_verso", "page_or_folio_number", features.alias("features"), F.coalesce("in_document", F.lit(False)).alias("in_document"))


def inventory_scans(scan: DataFrame, page: DataFrame, link: DataFrame, inventory_id, size: int = SHOWN_SCANS) -> Listed:
    """The first scans of an inventory, a row for each of their pages (verso first), and the count of all scans."""
    first = listed(wanted(scan, "inventory_id", inventory_id), ["filename", "id"], 1, size)
    shown = first.rows.select(F.col("id").alias("scan_id"), "filename")
    pages = page.join(F.broadcast(shown.select("scan_id")), "scan_id", "left_semi")  # `size` rows
    info = page_info(pages, link.join(pages.select(F.col("id").alias("page_id")), "page_id", "left_semi"))
    return Listed(shown.join(info, "scan_id", "left").orderBy("filename", F.desc_nulls_last("recto_verso"), "id"), first.totals)


def scan_list(scan: DataFrame, inventory_id=None, page: int = 1) -> Listed:
    return listed(wanted(scan, "inventory_id", inventory_id), ["filename", "id"], page, SCANS)


def scan_pages(scan: DataFrame, page: DataFrame, filename: str) -> DataFrame:
    """Pages of the scan of that name."""
    return page.join(scan.where(F.col("filename") == filename).select(F.col("id").alias("scan_id"), "filename"), "scan_id")


def page_list(page: DataFrame, scan: DataFrame, inventory_id=None, number: int = 1) -> Listed:
    """Pages by file and id. Pages without a scan are not listed, yet the total counts them."""
    mine = wanted(page, "inventory_id", inventory_id)
    return listed(mine.join(scan.select(F.col("id").alias("scan_id"), "filename"), "scan_id"), ["filename", "id"], number, PAGES, mine)


def page_detail(page: DataFrame, scan: DataFrame, link: DataFrame, page_id: str) -> DataFrame:
    """(id, filename, previous_id, next_id, documents): a page, those beside it in its inventory by file and id, and the ids of its documents in order."""
    inventory = page.where(F.col("id") == page_id).select("inventory_id").where("inventory_id is not null")
    around = page.join(F.broadcast(inventory), "inventory_id", "left_semi").join(scan.select(F.col("id").alias("scan_id"), "filename"), "scan_id")  # one row
    w = Window.partitionBy("inventory_id").orderBy("filename", "id")
    placed = around.select("id", "filename", F.lag("id").over(w).alias("previous_id"), F.lead("id").over(w).alias("next_id")).where(F.col("id") == page_id)
    documents = link.where(F.col("page_id") == page_id).groupBy("page_id").agg(F.array_sort(F.collect_set("document_id")).alias("documents"))
    mine = page.where(F.col("id") == page_id).select("id").join(placed, "id", "left").join(documents, F.col("id") == F.col("page_id"), "left")
    return mine.select("id", "filename", "previous_id", "next_id", F.coalesce("documents", F.array().cast("array<string>")).alias("documents"))


def place_list(settlement: DataFrame, label: DataFrame, search: str = "", page: int = 1) -> Listed:
    """Settlements whose name or any label holds the text, in either case of letters."""
    search = search.strip()
    found = settlement
    if search:
        named = label.where(contains_folded("label", search)).select(F.col("settlement_id").alias("id"), F.lit(True).alias("_named")).distinct()
        found = settlement.join(named, "id", "left").where(contains_folded("glob_id", search) | F.col("_named")).drop("_named")
    return listed(found, ["glob_id", "id"], page, PLACES)


def place_documents(settlement: DataFrame, document: DataFrame, glob_id: str, page: int = 1) -> Listed:
    """Documents of a settlement, earliest first."""
    place = settlement.where(F.col("glob_id") == glob_id).select(F.col("id").alias("location_id"))
    mine = document.join(F.broadcast(place), "location_id", "left_semi")  # one row
    return listed(mine, [F.asc_nulls_last("date_earliest_begin"), "id"], page, DOCUMENTS)


def method_list(method: DataFrame, document: DataFrame, link: DataFrame, page_table: DataFrame, page: int = 1) -> Listed:
    """Methods by name with documents, links, and links over all pages in percent (links of one page count each, so it may exceed 100)."""
    shown = listed(method, ["name", "id"], page, METHODS)
    return Listed(method_stats(shown.rows, document, link, page_table).orderBy("name", "id"), shown.totals)


def method_stats(method: DataFrame, document: DataFrame, link: DataFrame, page_table: DataFrame) -> DataFrame:
    per_document = link.groupBy("document_id").agg(F.count("*").alias("_n"))
    per = document.select("id", "method_id").join(per_document, F.col("id") == F.col("document_id"), "left").groupBy("method_id").agg(F.count("*").alias("documents"), F.coalesce(F.sum("_n"), F.lit(0)).alias("links"))
    total = page_table.agg(F.count("*").alias("_total"))
    rows = method.join(per, F.col("id") == F.col("method_id"), "left").drop("method_id").join(F.broadcast(total))  # one row
    n = F.coalesce("links", F.lit(0))
    return rows.select(method["*"], F.coalesce("documents", F.lit(0)).alias("documents"), n.alias("links"), coverage(n, F.col("_total")).alias("coverage"))


def method_documents(document: DataFrame, method_id: str, page: int = 1) -> Listed:
    return listed(document.where(F.col("method_id") == method_id), ["id"], page, DOCUMENTS)


def type_list(document_type: DataFrame, links: DataFrame, scheme: str = "") -> DataFrame:
    """Types by scheme, English and Dutch label, with their counts of links, of one scheme or of all."""
    per = links.groupBy("document_type_id").agg(F.count("*").alias("_n"))
    mine = wanted(document_type, "scheme", scheme.strip())
    counted = mine.join(per, F.col("id") == F.col("document_type_id"), "left").select(mine["*"], F.coalesce("_n", F.lit(0)).alias("documents"))
    return counted.orderBy(F.asc_nulls_last("scheme"), F.asc_nulls_last("pref_label_en"), F.asc_nulls_last("pref_label_nl"), "id")


def type_documents(document: DataFrame, links: DataFrame, type_id: str, page: int = 1) -> Listed:
    mine = links.where(F.col("document_type_id") == type_id).select(F.col("document_id").alias("id"))
    return listed(document.join(mine, "id", "left_semi"), ["id"], page, DOCUMENTS)


def shortened(text: Column | str, length: int, more: str = "...") -> Column:
    """The text, or its beginning and a sign that it goes on."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit(more))).otherwise(c)


def first_of(names: Column | str, n: int = 2, length: int = 40) -> Column:
    """The first names of a list, cut to `length`, and how many more there are."""
    c = F.col(names) if isinstance(names, str) else names
    head = F.array_join(F.transform(F.slice(c, 1, n), lambda x: F.substring(x, 1, length)), ", ")
    return F.when(F.size(c) > n, F.concat(head, F.lit(" +"), (F.size(c) - n).cast("string"), F.lit(" more"))).otherwise(head)
