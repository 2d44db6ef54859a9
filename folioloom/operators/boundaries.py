"""Boundary extension: free pages beside a document's linked block take its missing folios.

A page that one document claims is closed to the next, so documents of an
inventory are taken one after the other, in the order of their ranges; inventories
are independent and go to separate groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import effective_end
from .grouped import solve_groups

SCHEMA = T.StructType().add("page_id", "string").add("document_id", "string").add("index", "integer")
_COLUMNS = ("kind", "document_id", "page_id", "index_", "folio_start", "folio_last")


def _extend(group: dict[str, list]) -> list[tuple[str, str, int]]:
    """New links of one inventory; its rows come by kind, document, index, page, and those of ranges by start, then document."""
    blocks: dict[str, list[str]] = {}
    block_of: dict[str, str] = {}
    linked: dict[str, list[tuple[str, int]]] = {}
    ranges: list[tuple[str, int, int]] = []
    for kind, doc, page, index, first, last in zip(*(group[c] for c in _COLUMNS), strict=True):
        if kind == "base":
            blocks.setdefault(doc, []).append(page)
            block_of[page] = doc
        elif kind == "link":
            linked.setdefault(doc, []).append((page, index))
        else:
            ranges.append((doc, first, last))
    taken = {page for pages in linked.values() for page, _ in pages}
    out: list[tuple[str, str, int]] = []
    for doc, first, last in ranges:
        have = linked.get(doc, [])
        covered = {i for _, i in have if first <= i <= last}
        pages = {p for p, _ in have}
        votes: dict[str, int] = {}
        for p in pages:
            if p in block_of:
                votes[block_of[p]] = votes.get(block_of[p], 0) + 1
        if not covered or len(covered) == last - first + 1 or not votes:
            continue
        block = blocks[min(votes, key=lambda b: (-votes[b], b))]
        places = [i for i, p in enumerate(block) if p in pages]
        # Outwards on either side: nearest free page, nearest missing folio.
        for at, step, folio, folio_end in ((places[0] - 1, -1, min(covered) - 1, first), (places[-1] + 1, 1, max(covered) + 1, last)):
            while 0 <= at < len(block) and block[at] not in taken and (folio - folio_end) * step <= 0:
                out.append((block[at], doc, folio))
                taken.add(block[at])
                at, folio = at + step, folio + step
    return out


def boundary_links(baseline: DataFrame, documents: DataFrame, links: DataFrame) -> DataFrame:
    """(page_id, document_id, index) of new links.

    baseline: inventory_id, document_id, page_id, index of the baseline segmentation.
    documents: inventory_id, id, folio_start, folio_end. links: page_id, document_id,
    index of every link to a document with a range. Each document is anchored in the
    baseline document that holds most of its pages (ties to the smaller id).
    """
    none = F.lit(None)
    ranges = documents.where("folio_start is not null").select("inventory_id", F.col("id").alias("document_id"), "folio_start", effective_end("folio_start", "folio_end").alias("folio_last"))
    rows = (
        baseline.select("inventory_id", F.lit("base").alias("kind"), "document_id", "page_id", F.col("index").cast("integer").alias("index_"), none.cast("integer").alias("folio_start"), none.cast("integer").alias("folio_last"))
        .unionByName(ranges.select("inventory_id", F.lit("doc").alias("kind"), "document_id", none.cast("string").alias("page_id"), none.cast("integer").alias("index_"), "folio_start", "folio_last"))
        .unionByName(links.join(ranges.select("document_id", "inventory_id"), "document_id").select("inventory_id", F.lit("link").alias("kind"), "document_id", "page_id", F.col("index").cast("integer").alias("index_"), none.cast("integer").alias("folio_start"), none.cast("integer").alias("folio_last")))
    )

    return solve_groups(rows, "inventory_id", ["kind", "folio_start", *[F.asc_nulls_last(c) for c in ("document_id", "index_", "page_id")]], _extend, SCHEMA)
