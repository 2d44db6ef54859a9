"""Queries over the archive view, one for each operator or group of operators, with DuckDB SQL for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import archive_view as A
from ..functions import confidence_from_number, confidence_rank, contains_folded, coverage, date_label, feature_labels, folio_numbers, languages, name_id, natural_key, scan_order, side_order
from ..operators import hierarchy, lookups, provenance, sequences
from ..operators.boundaries import boundary_links
from ..schemas import CONFIDENCE
from ..settling import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, view: bool = True):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = A.with_view(sql) if view else sql.strip()
        return f

    return register


# -- sequences -------------------------------------------------------------------------------------------------


@query("SELECT inventory_id, page_id, CAST(doc_no AS INTEGER) AS doc_no, CAST(row_number() OVER (PARTITION BY inventory_id, doc_no ORDER BY pos) - 1 AS INTEGER) AS \"index\" FROM arch_segment")
def baseline_segmentation(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.baseline_segments(A.pages(spark, sf))


@query("""
SELECT i.inventory_number, count(DISTINCT s.doc_no) AS documents, count(*) AS pages, max(n) AS longest
FROM (SELECT *, count(*) OVER (PARTITION BY inventory_id, doc_no) AS n FROM arch_segment) s JOIN arch_inventory i USING (inventory_id) GROUP BY 1""")
def segmentation_stats_by_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Documents are counted from their sizes: one shuffle by document, then by inventory."""
    sizes = sequences.baseline_segments(A.pages(spark, sf)).groupBy("inventory_id", "doc_no").agg(F.count("*").alias("n"))
    stats = sizes.groupBy("inventory_id").agg(F.count("*").alias("documents"), F.sum("n").alias("pages"), F.max("n").alias("longest"))
    return stats.join(A.inventories(spark, sf).select("inventory_id", "inventory_number"), "inventory_id").drop("inventory_id")


def _links(spark: SparkSession, sf: str, *carry: str, near: str | None = None) -> DataFrame:
    """Links, with columns of their pages: these are made once, and need not be joined with the links."""
    return sequences.folio_links(A.pages(spark, sf), A.documents(spark, sf), carry=carry, near=near)


@query('SELECT page_id, document_id, "index" FROM arch_link')
def folio_match_links(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf)


@query('SELECT d.inventory_id, count(*) AS links, count(DISTINCT l.document_id) AS documents, min("index") AS lowest, max("index") AS highest FROM arch_link l JOIN arch_document d ON d.id = l.document_id GROUP BY 1')
def folio_match_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = A.documents(spark, sf).select(F.col("id").alias("document_id"), "inventory_id")
    per = _links(spark, sf, near="document_id").groupBy("document_id").agg(F.count("*").alias("n"), F.min("index").alias("a"), F.max("index").alias("b"))
    return per.join(docs, "document_id").groupBy("inventory_id").agg(F.sum("n").alias("links"), F.count("*").alias("documents"), F.min("a").alias("lowest"), F.max("b").alias("highest"))


@query("SELECT filename, TRY_CAST(nullif(regexp_extract(filename, '_(\\d+)[A-Za-z]*$', 1), '') AS INTEGER) AS scan_order FROM arch_scan")
def scan_order_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return A.scans(spark, sf).select("filename", scan_order("filename").alias("scan_order"))


@query("SELECT inventory_number, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(inventory_number, '^\\d*') AS BIGINT), upper(regexp_replace(inventory_number, '^\\d*', ''))) AS BIGINT) AS place FROM arch_inventory")
def natural_sort_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Place in natural order: a range-partitioned sort, settled once, then counts of the partitions before (no single-partition window)."""
    inv = A.inventories(spark, sf).select("inventory_number", natural_key("inventory_number").alias("k"))
    part = settled(inv.repartitionByRange("k").sortWithinPartitions("k").withColumn("p", F.spark_partition_id()).withColumn("m", F.monotonically_increasing_id()))
    local = part.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy("m")))
    sizes = local.groupBy("p").agg(F.count("*").alias("size"))
    before = sizes.select(F.explode(F.expr("sequence(p + 1, p + 1)")).alias("q"), "p", "size")
    offset = sizes.select(F.col("p").alias("p0")).join(before, F.col("p") < F.col("p0"), "left").groupBy("p0").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("offset"))
    return local.join(offset, F.col("p") == F.col("p0")).select("inventory_number", (F.col("n") + F.col("offset")).alias("place"))


_GAPS = """,
gap_doc AS (SELECT DISTINCT p.filename, l.document_id FROM arch_link l JOIN arch_page p USING (page_id)),
gap_set AS (SELECT filename, count(*) AS n, min(document_id) AS doc FROM gap_doc GROUP BY 1),
gap_pos AS (SELECT s.inventory_id, s.filename, g.n, g.doc, row_number() OVER (PARTITION BY s.inventory_id ORDER BY s.scan_no, s.filename) AS pos,
                   count(*) OVER (PARTITION BY s.inventory_id) AS total FROM arch_scan s LEFT JOIN gap_set g USING (filename)),
gap_all AS (SELECT *, last_value(CASE WHEN n IS NOT NULL THEN {'pos': pos, 'n': n, 'doc': doc} END IGNORE NULLS) OVER (PARTITION BY inventory_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
                   first_value(CASE WHEN n IS NOT NULL THEN {'pos': pos, 'n': n, 'doc': doc} END IGNORE NULLS) OVER (PARTITION BY inventory_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM gap_pos),
gap AS (SELECT *, coalesce(next.pos, total + 1) - coalesce(prev.pos, 0) - 1 AS gap,
               CASE WHEN coalesce(next.pos, total + 1) - coalesce(prev.pos, 0) - 1 > 3 THEN 'gap too wide' WHEN prev IS NULL OR next IS NULL THEN 'missing neighbour'
                    WHEN prev.n <> 1 OR next.n <> 1 THEN 'ambiguous neighbours' WHEN prev.doc <> next.doc THEN 'neighbours disagree' ELSE 'filled' END AS reason
        FROM gap_all WHERE n IS NULL)
"""


def _view(more: str, select: str) -> str:
    return f"{more.strip()}\n{select}"


@query(_view(_GAPS, 'SELECT p.page_id, g.prev.doc AS document_id, CAST(coalesce((SELECT max("index") FROM arch_link l WHERE l.page_id = p.page_id) + 1, 0) AS INTEGER) AS "index" FROM gap g JOIN arch_page p USING (filename) WHERE reason = \'filled\''))
def gap_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    pages = settled(A.pages(spark, sf).select("inventory_id", "page_id", "scan_id", "filename", "scan_order", "page_or_folio_number"))
    links = provenance.as_links(sequences.folio_links(pages, A.documents(spark, sf), near="page_id"), "FOLIO_RANGE", "FOLIO_RANGE")
    return sequences.gap_links(pages.select("inventory_id", "scan_id", "filename", "scan_order").distinct(), pages, links, ["FOLIO_RANGE"], 3)


@query(_view(_GAPS, "SELECT inventory_id, reason, count(*) AS scans FROM gap GROUP BY 1, 2"))
def gap_skip_reasons(spark: SparkSession, sf: str) -> DataFrame:
    on = _links(spark, sf, "scan_id", near="scan_id").select("scan_id", "document_id").distinct()
    gaps = sequences.scan_gaps(A.scans(spark, sf), on)
    return gaps.withColumn("reason", sequences.gap_reason(3)).groupBy("inventory_id", "reason").agg(F.count("*").alias("scans"))


_RUNS = """,
run_pos AS (SELECT inventory_id, filename, row_number() OVER (PARTITION BY inventory_id ORDER BY scan_no, side, filename) AS pos
            FROM (SELECT inventory_id, filename, scan_no, min(coalesce(recto_verso, '')) AS side FROM arch_page GROUP BY 1, 2, 3)),
run_at AS (SELECT DISTINCT f.inventory_id, f.folio, r.pos, f.filename FROM arch_folio f JOIN run_pos r USING (filename)),
run_island AS (SELECT *, pos - row_number() OVER (PARTITION BY inventory_id, folio ORDER BY pos) AS island FROM run_at),
run AS (SELECT *, count(*) OVER w AS length, min(pos) OVER w AS start_pos, max(pos) OVER w AS end_pos FROM run_island WINDOW w AS (PARTITION BY inventory_id, folio, island)),
suspect AS (SELECT inventory_id, folio, start_pos, end_pos, CAST(length AS INTEGER) AS length, filename FROM run WHERE length > 3)
"""


@query(_view(_RUNS, "SELECT DISTINCT inventory_id, folio, start_pos, end_pos, length FROM suspect"))
def suspect_runs(spark: SparkSession, sf: str) -> DataFrame:
    pages = settled(A.pages(spark, sf).select("inventory_id", "scan_id", "filename", "scan_order", "recto_verso", "page_or_folio_number"))
    return sequences.repeated_runs(pages.select("inventory_id", "scan_id", "filename", "scan_order").distinct(), pages, 3).drop("scan_id").distinct()


@query(_view(_RUNS, 'SELECT DISTINCT l.page_id, l.document_id FROM arch_link l JOIN arch_page p USING (page_id) JOIN arch_document d ON d.id = l.document_id JOIN suspect s ON s.filename = p.filename AND s.folio BETWEEN d.folio_start AND coalesce(d.folio_end, d.folio_start)'))
def repeated_run_removal(spark: SparkSession, sf: str) -> DataFrame:
    pages, documents = settled(A.pages(spark, sf).select("inventory_id", "page_id", "scan_id", "filename", "scan_order", "recto_verso", "page_or_folio_number")), A.documents(spark, sf)
    runs = sequences.repeated_runs(pages.select("inventory_id", "scan_id", "filename", "scan_order").distinct(), pages, 3)
    return sequences.misplaced_links(runs, pages, documents, sequences.folio_links(pages, documents, near="page_id").withColumn("source", F.lit("FOLIO_RANGE")))


@query()
def boundary_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Claims depend on the documents before, so SQL has no plain form; tests compare it with a literal loop."""
    base = sequences.baseline_segments(A.pages(spark, sf)).select("inventory_id", F.concat_ws("-", "inventory_id", F.format_string("%06d", "doc_no")).alias("document_id"), "page_id", "index")
    return boundary_links(base, A.documents(spark, sf), _links(spark, sf))


@query("SELECT inventory_id, page_id, lag(page_id) OVER w AS previous_id, lead(page_id) OVER w AS next_id FROM arch_page WINDOW w AS (PARTITION BY inventory_id ORDER BY filename, side_order, page_id)")
def page_prev_next(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.neighbours(A.pages(spark, sf))


@query("""
SELECT inventory_id, document_id, CAST(min(pos) + 1 AS INTEGER) AS start, CAST(max(pos) + 2 AS INTEGER) AS "end", count(*) AS pages, max(n) + 1 AS total_pages
FROM (SELECT inventory_id, page_id, row_number() OVER (PARTITION BY inventory_id ORDER BY filename, side_order, page_id) - 1 AS pos, count(*) OVER (PARTITION BY inventory_id) AS n FROM arch_page)
JOIN arch_link USING (page_id) GROUP BY 1, 2""")
def timeline_items(spark: SparkSession, sf: str) -> DataFrame:
    placed = sequences.places(A.pages(spark, sf), None, "page_or_folio_number")
    on = sequences.folio_links(placed, A.documents(spark, sf), carry=("inventory_id", "_pos", "_n"), near="document_id")
    return sequences.spans_of(on)


@query("""
SELECT document_id, min_by(filename, (pos, page_id)) AS first_scan, max_by(filename, (pos, page_id)) AS last_scan, count(DISTINCT filename) AS scans, count(*) AS pages
FROM (SELECT l.document_id, p.filename, p.page_id, lpad(CAST(p.scan_no AS VARCHAR), 8, '0') || CAST(p.side_order AS VARCHAR) AS pos FROM arch_link l JOIN arch_page p USING (page_id)) GROUP BY 1""".replace("(pos, page_id)", "pos || page_id"))
def first_last_scan(spark: SparkSession, sf: str) -> DataFrame:
    on = _links(spark, sf, "filename", "scan_no", "recto_verso", near="document_id")
    order = F.struct("scan_no", side_order("recto_verso"), "page_id")
    return on.groupBy("document_id").agg(F.min_by("filename", order).alias("first_scan"), F.max_by("filename", order).alias("last_scan"), F.countDistinct("filename").alias("scans"), F.count("*").alias("pages"))


@query("""
SELECT document_id, header FROM (SELECT l.document_id, 'part ' || CAST(p.l_partkey AS VARCHAR) AS header, row_number() OVER (PARTITION BY l.document_id ORDER BY l."index", p.filename, l.page_id) AS n
 FROM arch_link l JOIN arch_page p USING (page_id) WHERE p.l_partkey % 3 <> 0) WHERE n = 1""")
def first_header_title(spark: SparkSession, sf: str) -> DataFrame:
    """Headers of pages come from their parts; a third is blank and passed over."""
    header = F.when(F.col("l_partkey") % 3 == 0, "  ").otherwise(F.concat(F.lit("part "), F.col("l_partkey")))
    headers = A.pages(spark, sf).select("page_id", "filename", header.alias("header"))
    return sequences.first_titles(_links(spark, sf), headers, ["index", "filename", "page_id"])


# -- joins, updates and merges ---------------------------------------------------------------------------------


@query("SELECT filename, recto_verso, page_id, CAST(folio AS VARCHAR) AS page_or_folio_number FROM arch_page")
def scan_pages_explode(spark: SparkSession, sf: str) -> DataFrame:
    return A.pages(spark, sf).select("filename", "recto_verso", "page_id", "page_or_folio_number")


@query("""
SELECT source AS filename, max(length(coalesce(text, ''))) < 15000 AS is_blank, count(*) AS texts FROM documents WHERE trim(source) <> '' GROUP BY 1""", view=False)
def blank_flags(spark: SparkSession, sf: str) -> DataFrame:
    d = A.read(spark, sf, "documents").where("source is not null and trim(source) <> ''")
    return d.groupBy(F.trim("source").alias("filename")).agg((F.max(F.length(F.coalesce("text", F.lit("")))) < 15000).alias("is_blank"), F.count("*").alias("texts"))


@query("SELECT count(*) AS unmatched FROM (SELECT DISTINCT 'src' || CAST(s_suppkey AS VARCHAR) AS filename FROM supplier) s ANTI JOIN (SELECT DISTINCT source AS filename FROM documents) d USING (filename)", view=False)
def blank_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    names = A.read(spark, sf, "supplier").select(F.concat(F.lit("src"), "s_suppkey").alias("filename")).distinct()
    return lookups.missing_from(names, "filename", A.read(spark, sf, "documents"), "source").agg(F.count("*").alias("unmatched"))


@query("""
SELECT s.s_suppkey, f.label FROM supplier s LEFT JOIN (SELECT lower(trim(n_name)) AS k, max_by(n_nationkey, n_nationkey) AS label FROM (SELECT n_name, n_nationkey FROM nation UNION ALL SELECT ' ' || lower(n_name) || ' ', n_nationkey + 100 FROM nation WHERE n_nationkey % 2 = 0) GROUP BY 1) f
 ON f.k = lower(trim(CASE WHEN s_suppkey % 5 = 0 THEN 'nowhere' ELSE (SELECT n_name FROM nation n WHERE n.n_nationkey = s.s_nationkey) END))""", view=False)
def settlement_lookup_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    nation = A.read(spark, sf, "nation").select("n_name", "n_nationkey")
    again = nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("n_name"), (F.col("n_nationkey") + 100).alias("n_nationkey"))
    labels = nation.unionByName(again).withColumn("seq", F.col("n_nationkey")).withColumnRenamed("n_nationkey", "label")
    sup = A.read(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, "nowhere").otherwise(F.col("n_name")).alias("place"))
    return lookups.lookup_last(sup, "place", labels, "n_name", "label", "seq").select("s_suppkey", "label")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1", view=False)
def keep_first_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.keep_first(A.read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])


@query("""
SELECT change, count(*) AS rows FROM (SELECT CASE WHEN o.k IS NULL THEN 'created' WHEN n.k IS NULL THEN 'kept' WHEN o.t IS DISTINCT FROM n.t OR o.b IS DISTINCT FROM n.b THEN 'updated' ELSE 'skipped' END AS change
 FROM (SELECT p_partkey AS k, p_type AS t, p_brand AS b FROM part WHERE p_partkey % 4 <> 0) o
 FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS t, p_brand AS b FROM part WHERE p_partkey % 5 <> 0) n ON o.k = n.k) GROUP BY 1""", view=False)
def upsert_stats(spark: SparkSession, sf: str) -> DataFrame:
    part = A.read(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    new = part.where("p_partkey % 5 <> 0").withColumn("p_type", F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")))
    return lookups.upsert(part.where("p_partkey % 4 <> 0"), new, "p_partkey", ["p_type", "p_brand"]).groupBy("change").agg(F.count("*").alias("rows"))


@query("""
SELECT w.name, s.filename AS scan_id FROM (SELECT DISTINCT regexp_replace(filename, '_0+(\\d+)$', '_\\1') AS name FROM arch_scan WHERE scan_no % 97 <> 0) w
 LEFT JOIN arch_scan s ON s.filename = CASE WHEN length(regexp_extract(w.name, '_(\\d+)$', 1)) < 4 THEN regexp_replace(w.name, '_\\d+$', '_' || lpad(regexp_extract(w.name, '_(\\d+)$', 1), 4, '0')) ELSE w.name END""")
def pad_fallback_lookup(spark: SparkSession, sf: str) -> DataFrame:
    scans = A.scans(spark, sf)
    wanted = scans.where("scan_no % 97 <> 0").select(F.regexp_replace("filename", r"_0+(\d+)$", "_$1").alias("name")).distinct()
    return lookups.file_lookup(wanted, "name", scans.select("scan_id", "filename")).select("name", "scan_id")


@query(f"""
SELECT i.inventory_number AS letter, s.filename AS scan_id, CAST(s.scan_no AS BIGINT) AS position FROM arch_inventory i JOIN arch_scan s USING (inventory_id)
 WHERE s.scan_no BETWEEN i.inventory_id % 17 AND i.inventory_id % 31 AND s.scan_no % 97 <> 0 AND s.filename LIKE '{A.PREFIX}%'""")
def interval_scan_links(spark: SparkSession, sf: str) -> DataFrame:
    letters = A.inventories(spark, sf).select(F.col("inventory_number").alias("letter"), F.concat(F.lit(A.PREFIX), "inventory_number", F.lit("_")).alias("prefix"), (F.col("inventory_id") % 17).alias("a"), (F.col("inventory_id") % 31).alias("b"))
    return lookups.interval_scans(letters, "letter", "prefix", "a", "b", A.scans(spark, sf))


@query('SELECT page_id, count(DISTINCT document_id) AS documents FROM arch_link GROUP BY 1 HAVING count(DISTINCT document_id) > 1')
def ambiguous_pages(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.ambiguous_pages(_links(spark, sf))


def _ranked(c: str) -> str:
    return f"list_position([{', '.join(repr(x) for x in CONFIDENCE)}], {c})"


@query(f"SELECT c AS confidence, count(*) AS links FROM (SELECT CASE WHEN \"index\" % 5 = 0 THEN 'DEFINITIVE' WHEN \"index\" % 5 = 1 THEN 'FOLIO_RANGE' WHEN \"index\" % 5 = 2 THEN 'CANDIDATE' ELSE {CONFIDENCE[0]!r} END AS c FROM arch_link) GROUP BY 1")
def confidence_audit(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("index") % 5
    raw = F.when(number == 0, "1.0").when(number == 1, "0.8").when(number == 2, "0.3").otherwise(CONFIDENCE[0])
    return provenance.confidence_audit(_links(spark, sf).withColumn("confidence", confidence_from_number(raw)))


@query(f"""
, tagged AS (SELECT *, CASE WHEN "index" % 3 = 0 THEN 'VALIDATED' WHEN "index" % 3 = 1 THEN 'FOLIO_RANGE' ELSE 'CANDIDATE' END AS confidence FROM arch_link)
SELECT page_id, document_id, "index", confidence FROM tagged WHERE NOT ({_ranked('confidence')} > 1 AND page_id IN (SELECT page_id FROM arch_page WHERE is_blank))""")
def supersede_links(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("index") % 3
    links = _links(spark, sf).withColumn("confidence", F.when(n == 0, "VALIDATED").when(n == 1, "FOLIO_RANGE").otherwise("CANDIDATE"))
    return provenance.supersede(links, A.pages(spark, sf).where("is_blank")).select("page_id", "document_id", "index", "confidence")


@query(f"""
, two_sources AS (SELECT page_id, document_id, "index", 'FOLIO_RANGE' AS confidence FROM arch_link UNION ALL SELECT page_id, document_id, "index" + 1, CASE WHEN "index" % 2 = 0 THEN 'DEFINITIVE' ELSE 'CANDIDATE' END FROM arch_link)
SELECT page_id, document_id, min("index") AS "index", confidence FROM (SELECT *, rank() OVER (PARTITION BY page_id, document_id ORDER BY {_ranked('confidence')}, "index") AS n FROM two_sources) WHERE n = 1 GROUP BY page_id, document_id, confidence""")
def strongest_links(spark: SparkSession, sf: str) -> DataFrame:
    other = F.struct((F.col("index") + 1).alias("index"), F.lit("IMPORT").alias("source"), F.when(F.col("index") % 2 == 0, "DEFINITIVE").otherwise("CANDIDATE").alias("confidence"))
    weak = F.struct("index", F.lit("FOLIO_RANGE").alias("source"), F.lit("FOLIO_RANGE").alias("confidence"))
    # Both links of a page and document come of one row, where they are; they are neither made twice nor exchanged again.
    both = _links(spark, sf).select("page_id", "document_id", F.inline(F.array(weak, other)))
    links = both.select(name_id("page_id", "document_id", "source", "index").alias("id"), "page_id", "document_id", "index", "source", "confidence")
    return provenance.strongest(links).select("page_id", "document_id", "index", "confidence")


# -- hierarchy -------------------------------------------------------------------------------------------------


_SERIES = """,
series AS (SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS id, r_name AS title, NULL AS part_of_id FROM region
 UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), n_name, 'r' || CAST(n_regionkey AS VARCHAR) FROM nation
 UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), s_name, 'n' || CAST(s_nationkey AS VARCHAR) FROM supplier),
up AS (SELECT id, id AS ancestor_id, 0 AS depth FROM series UNION ALL SELECT up.id, s.part_of_id, depth + 1 FROM up JOIN series s ON s.id = up.ancestor_id WHERE s.part_of_id IS NOT NULL)
"""


def _series(spark: SparkSession, sf: str) -> DataFrame:
    region = A.read(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("title"), F.lit(None).cast("string").alias("part_of_id"))
    nation = A.read(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("title"), F.concat(F.lit("r"), "n_regionkey").alias("part_of_id"))
    leaf = A.read(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("title"), F.concat(F.lit("n"), "s_nationkey").alias("part_of_id"))
    return region.unionByName(nation).unionByName(leaf)


@query(_view(_SERIES, "SELECT id, ancestor_id, depth FROM up"))
def series_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.ancestors(_series(spark, sf))


@query(_view(_SERIES, "SELECT up.id, string_agg(s.title, ' > ' ORDER BY depth DESC) AS path, max(depth) AS depth FROM up JOIN series s ON s.id = ancestor_id GROUP BY 1"))
def series_paths(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.paths(_series(spark, sf))


@query(_view(_SERIES, "SELECT DISTINCT ancestor_id AS id FROM up WHERE id IN (SELECT 's' || CAST(l_suppkey AS VARCHAR) FROM lineitem)"))
def series_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Series of the suppliers that have line items, and all above them."""
    wanted = A.read(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("id")).distinct()
    return hierarchy.closure(_series(spark, sf), wanted)


# -- serving: counts, search, lists, details --------------------------------------------------------------------


@query("SELECT 'inventories' AS name, count(*) AS n FROM supplier UNION ALL SELECT 'scans', count(*) FROM lineitem UNION ALL SELECT 'documents', count(*) FROM arch_document UNION ALL SELECT 'settlements', count(*) FROM nation")
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    parts = {"inventories": A.read(spark, sf, "supplier"), "scans": A.read(spark, sf, "lineitem"), "documents": A.documents(spark, sf), "settlements": A.read(spark, sf, "nation")}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT o_orderpriority AS method, count(DISTINCT o_orderkey) AS documents, count(*) AS links, count(*) / (SELECT count(*) FROM lineitem) * 100 AS coverage FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1", view=False)
def method_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Links of a method over all pages; links count, so coverage may exceed 100 %. Links are summed by document before the join."""
    line = A.read(spark, sf, "lineitem").select("l_orderkey")
    per = line.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    total = line.agg(F.count("*").alias("total"))
    orders = A.read(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    stats = orders.join(per, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderpriority").alias("method")).agg(F.countDistinct("o_orderkey").alias("documents"), F.sum("n").alias("links"))
    return stats.join(F.broadcast(total)).select("method", "documents", "links", coverage(F.col("links"), F.col("total")).alias("coverage"))


@query("SELECT p_type AS type, count(l_orderkey) AS documents FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) ON l_partkey = p_partkey GROUP BY 1", view=False)
def type_counts(spark: SparkSession, sf: str) -> DataFrame:
    per = A.read(spark, sf, "lineitem").select("l_partkey", "l_orderkey").distinct().groupBy("l_partkey").agg(F.count("*").alias("n"))
    part = A.read(spark, sf, "part").select("p_partkey", F.col("p_type").alias("type"))
    return part.join(per, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("type").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"))


@query("SELECT DISTINCT p_brand AS scheme FROM part", view=False)
def scheme_list(spark: SparkSession, sf: str) -> DataFrame:
    return A.read(spark, sf, "part").select(F.col("p_brand").alias("scheme")).distinct()


@query("""
SELECT o_orderkey AS id, c_name AS inventory, CAST(o_orderdate AS DATE) AS date FROM orders JOIN customer ON c_custkey = o_custkey
 WHERE contains(lower(o_orderpriority), 'urgent') OR contains(lower(c_name), '99') ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 50""", view=False)
def documents_search(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of a search in titles or inventory names, latest first."""
    both = A.read(spark, sf, "orders").join(A.read(spark, sf, "customer").select("c_custkey", "c_name"), F.col("c_custkey") == F.col("o_custkey"))
    found = both.where(contains_folded("o_orderpriority", "URGENT") | contains_folded("c_name", "99"))
    return found.orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").offset(50).limit(50).select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("inventory"), F.to_date("o_orderdate").alias("date"))


@query("""
SELECT * FROM (SELECT 'inventory' AS kind, s_name AS label FROM supplier WHERE contains(lower(s_name), '1') ORDER BY s_name LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'settlement', n_name FROM nation WHERE contains(lower(n_name), 'an') OR contains(lower(n_name), '1') ORDER BY n_name LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'scan', filename FROM arch_scan WHERE contains(lower(filename), '_001') ORDER BY filename LIMIT 20)""")
def global_search(spark: SparkSession, sf: str) -> DataFrame:
    inv = A.read(spark, sf, "supplier").select(F.lit("inventory").alias("kind"), F.col("s_name").alias("label")).where(contains_folded("label", "1"))
    place = A.read(spark, sf, "nation").select(F.lit("settlement").alias("kind"), F.col("n_name").alias("label")).where(contains_folded("label", "AN") | contains_folded("label", "1"))
    scan = A.scans(spark, sf).select(F.lit("scan").alias("kind"), F.col("filename").alias("label")).where(contains_folded("label", "_001"))
    out = [x.orderBy("label").limit(20) for x in (inv, place, scan)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND contains(lower(c_name), '00001'))", view=False)
def settlement_search(spark: SparkSession, sf: str) -> DataFrame:
    labels = A.read(spark, sf, "customer").where(contains_folded("c_name", "00001")).select(F.col("c_nationkey").alias("n_nationkey"))
    return A.read(spark, sf, "nation").join(labels, "n_nationkey", "left_semi").select("n_nationkey", "n_name")


@query("""
SELECT inventory_number, title, pages, documents FROM arch_inventory i
 LEFT JOIN (SELECT inventory_id, count(*) AS pages FROM arch_page GROUP BY 1) p USING (inventory_id) LEFT JOIN (SELECT inventory_id, count(*) AS documents FROM arch_document GROUP BY 1) d USING (inventory_id)
 ORDER BY CAST(regexp_extract(inventory_number, '^\\d*') AS BIGINT), regexp_replace(inventory_number, '^\\d*', '') LIMIT 30""")
def inventory_list(spark: SparkSession, sf: str) -> DataFrame:
    pages = A.pages(spark, sf).groupBy("inventory_id").agg(F.count("*").alias("pages"))
    docs = A.documents(spark, sf).groupBy("inventory_id").agg(F.count("*").alias("documents"))
    inv = A.inventories(spark, sf).orderBy(natural_key("inventory_number")).limit(30)
    return inv.join(pages, "inventory_id", "left").join(docs, "inventory_id", "left").select("inventory_number", "title", "pages", "documents")


@query("""
SELECT d.id, d.folio_start, d.folio_end, count(l.page_id) AS pages, count(DISTINCT p.filename) AS scans, string_agg(DISTINCT p.recto_verso, ', ' ORDER BY p.recto_verso) AS sides
 FROM arch_document d LEFT JOIN arch_link l ON l.document_id = d.id LEFT JOIN arch_page p USING (page_id) GROUP BY 1, 2, 3""")
def document_details(spark: SparkSession, sf: str) -> DataFrame:
    on = _links(spark, sf, "filename", "recto_verso", near="document_id")
    per = on.groupBy("document_id").agg(F.count("*").alias("pages"), F.countDistinct("filename").alias("scans"), F.array_join(F.array_sort(F.collect_set("recto_verso")), ", ").alias("sides"))
    docs = A.documents(spark, sf).join(per, F.col("id") == F.col("document_id"), "left")
    return docs.select("id", "folio_start", "folio_end", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("scans", F.lit(0)).alias("scans"), F.nullif("sides", F.lit("")).alias("sides"))


@query("""
SELECT page_id, coalesce(nullif(concat_ws(', ', CASE WHEN is_blank THEN 'Blank' END, CASE WHEN scan_no % 3 = 0 THEN 'Marginalia' END, CASE WHEN scan_no % 7 = 0 THEN 'Print' END, CASE WHEN coalesce(signatures, '') <> '' THEN 'Signature' END), ''), 'No features') AS features FROM arch_page""")
def page_features(spark: SparkSession, sf: str) -> DataFrame:
    n, none = F.col("scan_no"), F.lit(None).cast("boolean")
    return A.pages(spark, sf).select("page_id", feature_labels(F.col("is_blank"), n % 3 == 0, none, none, n % 7 == 0, F.col("signatures")).alias("features"))


@query("SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, count(DISTINCT lang) AS n FROM documents WHERE lang <> 'de' GROUP BY 1", view=False)
def languages_list(spark: SparkSession, sf: str) -> DataFrame:
    raw = A.read(spark, sf, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("lang") == "de", "unknown").otherwise(F.concat(F.lit(" "), F.upper("lang"))))), ",").alias("raw"))
    return raw.select("source", F.array_join(languages("raw"), ",").alias("languages"), F.size(languages("raw")).cast("bigint").alias("n")).where("n > 0")


_DATES = "SELECT *, CAST(o_orderdate AS DATE) AS a, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate WHEN o_orderkey % 3 = 1 THEN o_orderdate + INTERVAL 30 DAY END AS DATE) AS b, CAST(CASE WHEN o_orderkey % 5 < 3 THEN o_orderdate + INTERVAL 60 DAY END AS DATE) AS c, CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 60 DAY WHEN o_orderkey % 5 = 1 THEN o_orderdate + INTERVAL 90 DAY END AS DATE) AS d FROM orders"


@query(f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'undated' ELSE
 concat_ws(' ', CASE WHEN b IS NULL THEN 'From ' || CAST(a AS VARCHAR) WHEN a = b THEN CAST(a AS VARCHAR) ELSE CAST(a AS VARCHAR) || ' - ' || CAST(b AS VARCHAR) END,
  CASE WHEN c IS NOT NULL AND d IS NOT NULL AND c <> d THEN 'to ' || CAST(c AS VARCHAR) || ' - ' || CAST(d AS VARCHAR) END) END AS label FROM ({_DATES})""", view=False)
def date_range_label(spark: SparkSession, sf: str) -> DataFrame:
    o, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    b = F.when(k % 3 == 0, o).when(k % 3 == 1, F.date_add(o, 30))
    c = F.when(k % 5 < 3, F.date_add(o, 60))
    d = F.when(k % 5 == 0, F.date_add(o, 60)).when(k % 5 == 1, F.date_add(o, 90))
    return A.read(spark, sf, "orders").select("o_orderkey", date_label(F.when(k % 11 == 0, "undated"), o, b, c, d).alias("label"))


@query("""
SELECT s_suppkey, min(CAST(l_shipdate AS DATE)) AS date_start, max(CAST(l_shipdate AS DATE)) AS date_end FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""", view=False)
def inventory_dates(spark: SparkSession, sf: str) -> DataFrame:
    line = A.read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    return A.read(spark, sf, "supplier").join(line, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", F.to_date("a").alias("date_start"), F.to_date("b").alias("date_end"))


@query("""
SELECT d.id AS identifier, i.inventory_number, min_by(p.filename, p.filename || CAST(p.side_order AS VARCHAR)) AS start_scan_filename, max_by(p.filename, p.filename || CAST(p.side_order AS VARCHAR)) AS end_scan_filename,
 min_by(p.scan_type, p.filename || CAST(p.side_order AS VARCHAR)) AS start_scan_type, string_agg(DISTINCT t.p_type, ',' ORDER BY t.p_type) AS types
 FROM arch_document d JOIN arch_inventory i USING (inventory_id) LEFT JOIN arch_link l ON l.document_id = d.id LEFT JOIN arch_page p ON p.page_id = l.page_id LEFT JOIN part t ON t.p_partkey = p.l_partkey GROUP BY 1, 2""")
def document_csv(spark: SparkSession, sf: str) -> DataFrame:
    types = A.read(spark, sf, "part").select("p_partkey", "p_type")
    on = _links(spark, sf, "filename", "scan_type", "recto_verso", "l_partkey", near="document_id")
    order = F.struct("filename", side_order("recto_verso"))
    # Documents are settled with the keys of their parts, so only pairs of a document and a part travel to the types.
    per = settled(on.groupBy("document_id").agg(F.min_by("filename", order).alias("start_scan_filename"), F.max_by("filename", order).alias("end_scan_filename"), F.min_by("scan_type", order).alias("start_scan_type"), F.collect_set("l_partkey").alias("parts")))
    pairs = per.select(F.col("document_id").alias("_d"), F.explode("parts").alias("l_partkey")).join(types, F.col("p_partkey") == F.col("l_partkey"))
    typed = pairs.groupBy("_d").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))
    per = per.drop("parts").join(typed, F.col("document_id") == F.col("_d"), "left").drop("_d")
    docs = A.documents(spark, sf).join(A.inventories(spark, sf).select("inventory_id", "inventory_number"), "inventory_id")
    return docs.join(per, F.col("id") == F.col("document_id"), "left").select(F.col("id").alias("identifier"), "inventory_number", "start_scan_filename", "end_scan_filename", "start_scan_type", F.nullif("types", F.lit("")).alias("types"))


@query("SELECT confidence, CAST(rank AS INTEGER) AS rank FROM (VALUES ('VALIDATED', 0), ('DEFINITIVE', 1), ('FOLIO_RANGE', 2), ('INTERPOLATED', 3), ('CANDIDATE', 4), ('other', 4)) t(confidence, rank)", view=False)
def confidence_ranks(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in [*CONFIDENCE, "other"]])).alias("confidence"))
    return names.select("confidence", confidence_rank("confidence").alias("rank"))


@query("SELECT page_id, list_sort(list(folio)) AS folios FROM (SELECT DISTINCT page_id, folio FROM arch_folio) GROUP BY 1")
def page_folio_sets(spark: SparkSession, sf: str) -> DataFrame:
    return A.pages(spark, sf).where("page_or_folio_number is not null").select("page_id", F.array_sort(F.array_distinct(folio_numbers("page_or_folio_number"))).alias("folios"))


# -- records: the flat fields of their JSON ---------------------------------------------------------------------


def _schema(paths: list[list[str]]) -> str:
    """Type of the JSON value that has strings at the ends of the paths, whose steps are names and '[n]'."""
    if not any(paths):
        return "string"
    below: dict[str, list[list[str]]] = {}
    for step, *rest in paths:
        below.setdefault("[]" if step.startswith("[") else step, []).append(rest)
    if "[]" in below:
        return f"array<{_schema(below['[]'])}>"
    return f"struct<{','.join(f'`{name}`: {_schema(rest)}' for name, rest in below.items())}>"


def _fields(rows: DataFrame, key: str, **paths: str) -> DataFrame:
    """Strings inside the JSON of each row, which is read once for all of them."""
    steps = {c: re.findall(r"[^.$\[\]]+|\[\d+\]", p) for c, p in paths.items()}
    # As a column, the optimizer would read the JSON anew for each field; as the rows of a generator it is read once.
    read = rows.select(F.col(key).alias("key"), F.explode(F.array(F.from_json("json", _schema(list(steps.values()))))).alias("_r"))

    def at(path: list[str]) -> Column:
        out = F.col("_r")
        for step in path:
            out = F.get(out, F.lit(int(step[1:-1]))) if step.startswith("[") else out.getField(step)
        return out

    return read.select("key", *[at(path).alias(c) for c, path in steps.items()])


@query("""
SELECT filename AS key, 'urn:uuid:' || filename AS id, 'Scan ' || filename AS label, '' AS archive_id, filename AS own_id, '1000' AS height, 'pixels' AS unit, 'https://images.example/' || filename || '/full/max/0/default.jpg' AS image FROM arch_scan""")
def scan_records(spark: SparkSession, sf: str) -> DataFrame:
    from .linked_art import scans_jsonld

    paths = {"id": "$.id", "label": "$._label", "archive_id": "$.identified_by[0].content", "own_id": "$.identified_by[1].content", "height": "$.dimension[0].value", "unit": "$.dimension[1].unit._label", "image": "$.access_point.id"}
    return _fields(scans_jsonld(_tables(spark, sf)["scan"]), "id", **paths)


@query("""
SELECT page_id AS key, 'https://archive.example/document:' || page_id AS id, 'Page ' || coalesce(folio, substr(page_id, 1, 8)) AS label, coalesce(recto_verso, 'Page') AS side, 'Part Type' AS kind,
 CASE scan_no % 3 WHEN 0 THEN 'Dutch' WHEN 1 THEN 'qqq' END AS language, CASE scan_no % 3 WHEN 0 THEN 'http://vocab.getty.edu/aat/300388256' END AS language_id, 'PageXML of ' || filename AS carried, 'Scan ' || filename AS shown FROM arch_page""")
def page_records(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of scans in Dutch, in a language without an entry, or in none known."""
    from .linked_art import pages_jsonld

    t = _tables(spark, sf)
    number = F.col("scan_no") % 3
    spoken = A.scans(spark, sf).select(F.col("scan_id").alias("id"), F.when(number == 0, "nld,NLD").when(number == 1, "qqq").otherwise("unknown").alias("languages"))
    paths = {"id": "$.id", "label": "$._label", "side": "$.classified_as[0]._label", "kind": "$.classified_as[0].classified_as[0]._label", "language": "$.carries.language[0]._label", "language_id": "$.carries.language[0].id", "carried": "$.carries.digitally_carried_by._label", "shown": "$.shows.digitally_shown_by._label"}
    return _fields(pages_jsonld(t["page"], t["scan"].join(spoken, "id")), "id", **paths)


@query("""
SELECT 'g' || CAST(n_nationkey AS VARCHAR) AS key, 'https://archive.example/place:g' || CAST(n_nationkey AS VARCHAR) AS id, coalesce(min(trim(s_name)), 'g' || CAST(n_nationkey AS VARCHAR)) AS label, CAST(nullif(count(DISTINCT s_name), 0) AS VARCHAR) AS names
 FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal >= 6000 GROUP BY n_nationkey""", view=False)
def place_records(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as settlements, and their suppliers with much on account as labels, twice."""
    from .linked_art import places_jsonld

    places = A.read(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("g"), "n_nationkey").alias("glob_id"))
    labels = A.read(spark, sf, "supplier").where("s_acctbal >= 6000").select(F.col("s_name").alias("id"), F.concat(F.lit(" "), "s_name").alias("label"), F.col("s_nationkey").cast("string").alias("settlement_id"))
    got = places_jsonld(places, labels.unionByName(labels))
    names = F.size(F.from_json(F.get_json_object("json", "$.identified_by"), "array<struct<content:string>>"))
    return got.select(F.col("glob_id").alias("key"), F.get_json_object("json", "$.id").alias("id"), F.get_json_object("json", "$._label").alias("label"), F.when(names > 0, names.cast("string")).alias("names"))


@query(_view(_SERIES, """SELECT s.id AS key, 'https://archive.example/series:' || s.id AS id, s.title AS label, s.title AS name, CASE WHEN s.part_of_id IS NULL THEN 'Archival Grouping' ELSE 'Archival Subseries (subgroups)' END AS kind,
 'https://archive.example/series:' || u.id AS member_of, u.title AS member_label FROM series s LEFT JOIN series u ON u.id = s.part_of_id"""))
def series_records(spark: SparkSession, sf: str) -> DataFrame:
    from .linked_art import series_jsonld

    paths = {"id": "$.id", "label": "$._label", "name": "$.identified_by[0].content", "kind": "$.classified_as[0]._label", "member_of": "$.member_of[0].id", "member_label": "$.member_of[0]._label"}
    return _fields(series_jsonld(_series(spark, sf)), "id", **paths)


# -- nested exports and token rows: tests hold them against literal versions -------------------------------------


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The view in the columns of the archive model, as far as exports need them."""
    none, off = F.lit(None).cast("string"), F.lit(False)
    scan = A.scans(spark, sf)
    inventory = A.inventories(spark, sf)
    return {
        "inventory": inventory.select(F.col("inventory_id").alias("id"), "inventory_number", none.alias("handle"), none.cast("date").alias("date_start"), none.cast("date").alias("date_end")),
        "scan": scan.select(F.col("scan_id").alias("id"), "filename", none.alias("na_identifier"), F.concat(F.lit("https://images.example/"), "filename", F.lit("/info.json")).alias("iiif_image_info"), "inventory_id", F.lit(1000).alias("height"), F.lit(800).alias("width"), (F.col("scan_no") % 2 == 0).alias("has_transcriptions"), off.alias("has_entities"), off.alias("has_events")),
        "page": A.pages(spark, sf).select(F.col("page_id").alias("id"), "scan_id", "recto_verso", "page_or_folio_number"),
        "document": A.documents(spark, sf).select("id", "inventory_id", none.alias("title"), none.cast("date").alias("date_earliest_begin"), none.cast("date").alias("date_latest_end")),
        "link": _links(spark, sf, "recto_verso", "page_or_folio_number", "filename", near="document_id"),
    }


@query()
def manifest_json(spark: SparkSession, sf: str) -> DataFrame:
    from .exports import manifests

    t = _tables(spark, sf)
    return manifests(t["inventory"], t["scan"], t["page"], t["document"], t["link"])


@query()
def document_jsonld(spark: SparkSession, sf: str) -> DataFrame:
    from .exports import documents_jsonld

    t = _tables(spark, sf)
    return documents_jsonld(t["document"], t["link"], t["page"], t["scan"])


@query()
def segmentation_events(spark: SparkSession, sf: str) -> DataFrame:
    """Boundary tokens from orders: each customer's orders are a file of scans."""
    from ..operators.state_machine import segmentation_events as solve

    o = A.read(spark, sf, "orders")
    k = F.col("o_orderkey")
    row = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = o.select(F.col("o_custkey").cast("string").alias("file"), row.alias("row"), F.concat(F.lit("AR_1.1_"), "o_custkey", F.lit("_"), F.format_string("%04d", row)).alias("filename"), F.when(k % 5 == 0, "START").when(k % 5 == 3, "END").alias("boundary"), F.when(k % 5 < 4, F.concat(F.lit("T"), (k / 7).cast("int"))).alias("identifier"), F.when(k % 6 == 0, "START").when(k % 6 == 4, "END").when(k % 6 == 5, "END/START").alias("parts"), F.when(k % 13 == 0, "cover").alias("other"))
    return solve(rows)
