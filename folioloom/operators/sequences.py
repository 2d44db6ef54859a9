"""Operators over ordered pages and scans.

All windows are partitioned by inventory, a bound volume of some thousand pages,
so their partitions stay small however many inventories there are. Orders are
total, so results do not depend on how rows are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import effective_end, folio_numbers, side_order


def page_order(*first: Column | str) -> list[Column | str]:
    return [*first, "filename", side_order("recto_verso"), F.col("page_id")]


def baseline_segments(pages: DataFrame, order: list | None = None) -> DataFrame:
    """(inventory_id, page_id, doc_no, index): pages by the document they open or continue.

    Of each inventory the first page is left out, and so are blank ones (null is
    not blank). A page opens a document if it is the first, if blanks lie before
    it, or if the page before it bears signatures.
    """
    order = order or page_order()
    inventory = Window.partitionBy("inventory_id")
    placed = pages.withColumn("_pos", F.row_number().over(inventory.orderBy(*order)) - 1)
    used = placed.where((F.col("_pos") > 0) & ~F.coalesce("is_blank", F.lit(False)))
    w = inventory.orderBy("_pos")
    before = F.lag("_pos").over(w)
    opens = before.isNull() | (F.col("_pos") - before > 1) | (F.coalesce(F.lag("signatures").over(w), F.lit("")) != "")
    numbered = used.withColumn("doc_no", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    index = F.row_number().over(Window.partitionBy("inventory_id", "doc_no").orderBy("_pos")) - 1
    return numbered.select("inventory_id", "page_id", F.col("doc_no").cast("int").alias("doc_no"), index.cast("int").alias("index"))


#: Folios of a document's range up to which the range is exploded; longer ones join by comparison.
EXPLODED = 10_000


def folio_links(pages: DataFrame, documents: DataFrame, existing: DataFrame | None = None, carry: tuple[str, ...] = (), near: str | None = None) -> DataFrame:
    """(page_id, document_id, index) where a page's folio lies in a document's range in the same inventory.

    index is the smallest folio that matches. Ranges become rows, so the join is
    an equi-join on inventory and folio; ranges beyond EXPLODED folios, which only
    faulty data have, are joined by inventory and comparison instead, and only if
    there are any, since that takes all folios once more.

    carry: columns of the page that come along, so that links need not be joined
    with pages again. near: the column by which links are dealt out (page_id or
    document_id), so that what is grouped by it next is not exchanged again.
    """
    folios = pages.where("page_or_folio_number is not null").select("inventory_id", "page_id", *carry, F.explode(folio_numbers("page_or_folio_number")).alias("folio"))
    ranges = documents.where("folio_start is not null").select("inventory_id", F.col("id").alias("document_id"), "folio_start", effective_end("folio_start", "folio_end").alias("folio_last"))
    long = F.col("folio_last") - F.col("folio_start") > EXPLODED
    short = ranges.where(~long).select("inventory_id", "document_id", F.explode(F.sequence("folio_start", "folio_last")).alias("folio"))
    matched = folios.join(short, ["inventory_id", "folio"]).select("page_id", "document_id", *carry, "folio")
    wide = ranges.where(long)
    if documents.isStreaming or not wide.isEmpty():
        matched = matched.unionByName(folios.join(wide, "inventory_id").where("folio between folio_start and folio_last").select("page_id", "document_id", *carry, "folio"))
    if near:
        matched = matched.repartition(near)
    links = matched.groupBy("page_id", "document_id", *carry).agg(F.min("folio").alias("index")).select("page_id", "document_id", "index", *carry)
    if existing is not None:
        links = links.join(existing.select("page_id", "document_id").distinct(), ["page_id", "document_id"], "left_anti")
    return links


def scan_gaps(scans: DataFrame, scan_documents: DataFrame) -> DataFrame:
    """Every scan without trusted links, with the linked scans around it.

    scans: inventory_id, scan_id, filename, scan_order. scan_documents: scan_id,
    document_id. Gives inventory_id, scan_id, gap (scans in a row without links),
    and the document sets before and after (null at an end of the inventory).
    """
    sets = scan_documents.groupBy("scan_id").agg(F.array_sort(F.collect_set("document_id")).alias("docs"))
    return _gaps(scans.join(sets, "scan_id", "left"))


def _gaps(scans: DataFrame, *more: str) -> DataFrame:
    """The scans whose `docs` are null, with what is around them and the columns `more`."""
    order = Window.partitionBy("inventory_id").orderBy(F.asc_nulls_last("scan_order"), "filename", "scan_id")
    placed = scans.withColumn("_pos", F.row_number().over(order))
    here = F.when(F.col("docs").isNotNull(), F.struct("_pos", "docs"))

    def nearest(order: Column) -> Column:
        # A frame that only grows costs one step a row; one that shrinks is read anew for each.
        return F.last(here, ignorenulls=True).over(Window.partitionBy("inventory_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))

    around = placed.withColumn("_prev", nearest(F.asc("_pos"))).withColumn("_next", nearest(F.desc("_pos")))
    last = F.max("_pos").over(Window.partitionBy("inventory_id"))
    gap = F.coalesce(F.col("_next._pos"), last + 1) - F.coalesce(F.col("_prev._pos"), F.lit(0)) - 1
    return around.withColumn("gap", gap.cast("int")).where("docs is null").select("inventory_id", "scan_id", "filename", "gap", F.col("_prev.docs").alias("left_docs"), F.col("_next.docs").alias("right_docs"), F.col("_prev._pos").alias("left_pos"), *more)


def gap_reason(max_gap: int) -> Column:
    left, right = F.col("left_docs"), F.col("right_docs")
    return (
        F.when(F.col("gap") > max_gap, "gap too wide")
        .when(left.isNull() | right.isNull(), "missing neighbour")
        .when((F.size(left) != 1) | (F.size(right) != 1), "ambiguous neighbours")
        .when(left[0] != right[0], "neighbours disagree")
        .otherwise("filled")
    )


def gap_links(scans: DataFrame, pages: DataFrame, links: DataFrame, trusted: list[str], max_gap: int = 3) -> DataFrame:
    """(page_id, document_id, index) for pages of scans in gaps whose two neighbours have one and the same document.

    links: page_id, document_id, index, source. index is one more than the
    page's largest, of any document, or 0.
    """
    mine = F.when(F.col("source").isin(trusted), F.col("document_id"))
    per_page = links.groupBy("page_id").agg(F.max("index").alias("top"), F.collect_set("document_id").alias("all"), F.collect_set(mine).alias("trusted"))
    # The links of a page, and the pages of a scan, come along in one row, so links are made and exchanged once.
    on_scan = pages.select("page_id", "scan_id").join(per_page, "page_id", "left").groupBy("scan_id")
    sets = on_scan.agg(F.collect_list(F.struct("page_id", "top", "all")).alias("_pages"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("trusted")))).alias("docs"))
    held = scans.join(sets.withColumn("docs", F.when(F.size("docs") > 0, F.col("docs"))), "scan_id", "left")
    filled = _gaps(held, "_pages").where(gap_reason(max_gap) == "filled").select(F.col("left_docs")[0].alias("document_id"), F.explode("_pages").alias("p"))
    fresh = filled.where(~F.array_contains(F.coalesce("p.all", F.array().cast("array<string>")), F.col("document_id")))
    return fresh.select("p.page_id", "document_id", F.coalesce(F.col("p.top") + 1, F.lit(0)).alias("index"))


def repeated_runs(scans: DataFrame, pages: DataFrame, max_repeat: int = 3) -> DataFrame:
    """(inventory_id, folio, start_pos, end_pos, length, scan_id): scans in runs of more than `max_repeat` in a row that bear the same folio.

    Only scans with a number and a page count, in the order of the number, then
    of their sides (none first), then of the file name.
    """
    # Sides and folios of a scan come in one row, so pages are grouped, and scans joined, once.
    folios = F.coalesce(folio_numbers("page_or_folio_number"), F.array().cast("array<int>"))
    found = pages.groupBy("scan_id").agg(F.min(F.coalesce("recto_verso", F.lit(""))).alias("_side"), F.array_distinct(F.flatten(F.collect_list(folios))).alias("_folios"))
    placed = scans.where("scan_order is not null").join(found, "scan_id").withColumn("_pos", F.row_number().over(Window.partitionBy("inventory_id").orderBy("scan_order", "_side", "filename", "scan_id")))
    at = placed.select("scan_id", "inventory_id", "_pos", F.explode("_folios").alias("folio"))
    value = Window.partitionBy("inventory_id", "folio")
    islands = at.withColumn("_island", F.col("_pos") - F.row_number().over(value.orderBy("_pos")))
    sized = islands.groupBy("inventory_id", "folio", "_island").agg(F.min("_pos").alias("start_pos"), F.max("_pos").alias("end_pos"), F.count("*").cast("int").alias("length"), F.collect_list("scan_id").alias("scans"))
    return sized.where(F.col("length") > max_repeat).select("inventory_id", "folio", "start_pos", "end_pos", "length", F.explode("scans").alias("scan_id"))


def misplaced_links(runs: DataFrame, pages: DataFrame, documents: DataFrame, links: DataFrame, source: str = "FOLIO_RANGE") -> DataFrame:
    """Links to take out: of pages on a run's scans, to documents whose range holds the run's folio."""
    ranges = documents.where("folio_start is not null").select(F.col("id").alias("document_id"), "folio_start", effective_end("folio_start", "folio_end").alias("folio_last"))
    # Few pages are on a run's scans: they are found first, and only their links meet the ranges.
    on_run = pages.select("page_id", "scan_id").join(runs.select("scan_id", "folio").distinct(), "scan_id").select("page_id", "folio")
    on_page = links.where(F.col("source") == source).select("page_id", "document_id").join(on_run, "page_id")
    return on_page.join(ranges, "document_id").where("folio between folio_start and folio_last").select("page_id", "document_id").distinct()


def neighbours(pages: DataFrame, order: list | None = None) -> DataFrame:
    """(inventory_id, page_id, previous_id, next_id) in inventory order."""
    w = Window.partitionBy("inventory_id").orderBy(*(order or page_order()))
    return pages.select("inventory_id", "page_id", F.lag("page_id").over(w).alias("previous_id"), F.lead("page_id").over(w).alias("next_id"))


def timeline(pages: DataFrame, links: DataFrame, order: list | None = None) -> DataFrame:
    """(inventory_id, document_id, start, end, pages, total_pages): spans of documents over the pages of their inventory; start is 1 for the first page, end one beyond the last."""
    placed = places(pages, order)
    return spans_of(placed.join(links.select("page_id", "document_id").distinct(), "page_id"))


def places(pages: DataFrame, order: list | None = None, *more: str) -> DataFrame:
    """Pages with their place in their inventory, from 0 (`_pos`), and its number of pages (`_n`)."""
    inventory = Window.partitionBy("inventory_id")
    placed = pages.withColumn("_pos", F.row_number().over(inventory.orderBy(*(order or page_order()))) - 1).withColumn("_n", F.count("*").over(inventory))
    return placed.select("inventory_id", "page_id", "_pos", "_n", *more)


def spans_of(on: DataFrame) -> DataFrame:
    """The spans of `timeline` from links with the place of their page."""
    spans = on.groupBy("inventory_id", "document_id").agg(F.min("_pos").alias("a"), F.max("_pos").alias("b"), F.count("*").alias("pages"), F.first("_n").alias("_n"))
    return spans.select("inventory_id", "document_id", (F.col("a") + 1).cast("int").alias("start"), (F.col("b") + 2).cast("int").alias("end"), "pages", (F.col("_n") + 1).alias("total_pages"))


def first_titles(links: DataFrame, headers: DataFrame, order: list) -> DataFrame:
    """(document_id, header): the first header that is not blank, in the order given. It is chosen before it is read, so a first header of [] leaves the document without a title."""
    w = Window.partitionBy("document_id").orderBy(*order)
    rows = links.join(headers.where("trim(header) <> ''"), "page_id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("document_id", "header")


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; an aggregate, so it combines before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("_r")).select(*keys, "_r.*")
