"""The archive tables as a view over a star schema, for queries and benchmarks.

Inventories are suppliers, scans are their line items in a total order, pages are
the sides of scans, and documents are spans of fourteen scans with folio ranges.
`SQL` is the same view as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
PREFIX = "AR_1.1_"


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _number(key: str):
    return F.concat((F.col(key) + 1000).cast("string"), F.when(F.col(key) % 7 == 0, "A").otherwise(""))


def inventories(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("inventory_id"), _number("s_suppkey").alias("inventory_number"), F.col("s_name").alias("title"), F.col("s_nationkey").alias("series_id"))


def scans(spark: SparkSession, sf: str) -> DataFrame:
    line = read(spark, sf, "lineitem").select("l_suppkey", *LINE_ORDER)
    n = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*LINE_ORDER))
    line = line.withColumn("scan_no", n)
    number = F.col("scan_no").cast("string")
    name = F.concat(F.lit(PREFIX), _number("l_suppkey"), F.lit("_"), F.when(F.col("scan_no") < 1000, F.lpad(number, 4, "0")).otherwise(number), F.when(F.col("scan_no") % 97 == 0, "A").otherwise(""))
    kind = F.when(F.col("l_returnflag") == "A", "Double").when(F.col("l_returnflag") == "N", "Single").otherwise("Other")
    return line.select(F.col("l_suppkey").alias("inventory_id"), name.alias("scan_id"), name.alias("filename"), "scan_no", F.col("scan_no").alias("scan_order"), kind.alias("scan_type"), (F.col("l_quantity") <= 8).alias("is_blank"), F.when(F.col("l_discount") >= 0.10, "sig").alias("signatures"), "l_partkey", "l_linestatus", "l_shipdate")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    s = scans(spark, sf)
    sides = F.when(F.col("scan_type") == "Double", F.array(F.lit("Verso"), F.lit("Recto"))).otherwise(F.array(F.lit(None).cast("string")))
    folio = F.floor((F.col("scan_no") + 1) / 2).cast("int")
    number = F.when((F.col("scan_no") % 50).between(20, 25), "77").when(F.col("scan_no") % 11 == 0, F.lit(None)).when(F.col("scan_no") % 13 == 0, F.concat(folio.cast("string"), F.lit(", "), (folio + 10).cast("string"))).otherwise(folio.cast("string"))
    rows = s.withColumn("recto_verso", F.explode(sides))
    return rows.select("inventory_id", F.concat("scan_id", F.lit("_"), F.coalesce("recto_verso", F.lit("S"))).alias("page_id"), "scan_id", "filename", "scan_no", "scan_order", "scan_type", "recto_verso", "is_blank", "signatures", number.alias("page_or_folio_number"), "l_partkey", "l_linestatus")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of fourteen scans of each inventory."""
    last = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.floor((F.count("*") - 1) / 14).alias("last"))
    b = last.select(F.col("l_suppkey").alias("inventory_id"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("b"))
    return b.select("inventory_id", F.concat(_number("inventory_id"), F.lit("-"), F.col("b")).alias("id"), (F.col("b") * 7 + 1).cast("int").alias("folio_start"), F.when(F.col("b") % 5 != 4, F.col("b") * 7 + 7).cast("int").alias("folio_end"))


SQL = f"""
arch_inventory AS (
  SELECT s_suppkey AS inventory_id, CAST(1000 + s_suppkey AS VARCHAR) || CASE WHEN s_suppkey % 7 = 0 THEN 'A' ELSE '' END AS inventory_number,
         s_name AS title, s_nationkey AS series_id FROM supplier),
arch_line AS (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {", ".join(LINE_ORDER)}) AS scan_no FROM lineitem),
arch_scan AS (
  SELECT l_suppkey AS inventory_id,
         '{PREFIX}' || CAST(1000 + l_suppkey AS VARCHAR) || CASE WHEN l_suppkey % 7 = 0 THEN 'A' ELSE '' END || '_'
           || CASE WHEN scan_no < 10000 THEN lpad(CAST(scan_no AS VARCHAR), 4, '0') ELSE CAST(scan_no AS VARCHAR) END
           || CASE WHEN scan_no % 97 = 0 THEN 'A' ELSE '' END AS filename,
         scan_no, CASE l_returnflag WHEN 'A' THEN 'Double' WHEN 'N' THEN 'Single' ELSE 'Other' END AS scan_type,
         l_quantity <= 8 AS is_blank, CASE WHEN l_discount >= 0.10 THEN 'sig' END AS signatures, l_partkey, l_linestatus, l_shipdate
  FROM arch_line),
arch_page AS (
  SELECT s.*, side AS recto_verso, filename || '_' || coalesce(side, 'S') AS page_id,
         CASE side WHEN 'Verso' THEN 1 WHEN 'Recto' THEN 2 ELSE 3 END AS side_order,
         CASE WHEN scan_no % 50 BETWEEN 20 AND 25 THEN '77' WHEN scan_no % 11 = 0 THEN NULL
              WHEN scan_no % 13 = 0 THEN CAST((scan_no + 1) // 2 AS VARCHAR) || ', ' || CAST((scan_no + 1) // 2 + 10 AS VARCHAR)
              ELSE CAST((scan_no + 1) // 2 AS VARCHAR) END AS folio
  FROM arch_scan s, unnest(CASE WHEN scan_type = 'Double' THEN ['Verso', 'Recto'] ELSE [NULL] END) AS u(side)),
arch_document AS (
  SELECT l_suppkey AS inventory_id, CAST(1000 + l_suppkey AS VARCHAR) || CASE WHEN l_suppkey % 7 = 0 THEN 'A' ELSE '' END || '-' || CAST(b AS VARCHAR) AS id,
         7 * b + 1 AS folio_start, CASE WHEN b % 5 <> 4 THEN 7 * b + 7 END AS folio_end
  FROM (SELECT l_suppkey, unnest(range(0, (count(*) - 1) // 14 + 1)) AS b FROM lineitem GROUP BY l_suppkey)),
arch_folio AS (
  SELECT inventory_id, page_id, filename, scan_no, CAST(trim(part) AS INTEGER) AS folio
  FROM arch_page, unnest(string_split(folio, ',')) AS u(part) WHERE folio IS NOT NULL),
arch_link AS (
  SELECT f.page_id, d.id AS document_id, min(f.folio) AS "index"
  FROM arch_folio f JOIN arch_document d ON f.inventory_id = d.inventory_id
   AND f.folio BETWEEN d.folio_start AND coalesce(d.folio_end, d.folio_start)
  GROUP BY f.page_id, d.id),
arch_segment AS (
  SELECT inventory_id, page_id, sum(opens) OVER (PARTITION BY inventory_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS doc_no, pos FROM (
    SELECT *, CASE WHEN lag(pos) OVER w IS NULL OR pos - lag(pos) OVER w > 1 OR coalesce(lag(signatures) OVER w, '') <> '' THEN 1 ELSE 0 END AS opens
    FROM (SELECT inventory_id, page_id, signatures, coalesce(is_blank, false) AS blank,
                 row_number() OVER (PARTITION BY inventory_id ORDER BY filename, side_order, page_id) - 1 AS pos FROM arch_page)
    WHERE pos > 0 AND NOT blank WINDOW w AS (PARTITION BY inventory_id ORDER BY pos)))
"""


def with_view(query: str) -> str:
    return f"WITH RECURSIVE {SQL.strip()}\n{query.strip()}"
