"""Joins by natural key, with the fallbacks and merges of the import stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import padded_filename, strip


def lookup_last(rows: DataFrame, key: str, table: DataFrame, table_key: str, value: str, sequence: str) -> DataFrame:
    """rows with `value` of the last table row whose key is equal without case and outer white space; null without one."""
    folded = table.select(F.lower(strip(table_key)).alias("_k"), F.col(value).alias("_v"), F.col(sequence).alias("_s")).where("_k is not null")
    last = folded.groupBy("_k").agg(F.max_by("_v", "_s").alias(value))
    return rows.join(last, F.lower(strip(F.col(key))) == F.col("_k"), "left").drop("_k")


def file_lookup(rows: DataFrame, filename: str, scans: DataFrame) -> DataFrame:
    """rows with the scan (`scan_id`) of a file name: the exact one, else the one with its number padded."""
    # File names hardly repeat, so they are exchanged as they are and sorted once, not before the exchange too.
    by_name = scans.select(F.col("filename").alias("_f"), "scan_id").repartition("_f").groupBy("_f").agg(F.min("scan_id").alias("_s"))
    exact = rows.join(by_name, F.col(filename) == F.col("_f"), "left").withColumnRenamed("_s", "_exact").drop("_f")
    # The padded name is a column of its own: as an expression of the join it is made anew in each comparison of the sort.
    wanted = exact.withColumn("_name", F.when(F.col("_exact").isNull(), padded_filename(filename)))
    padded = wanted.join(by_name, F.col("_name") == F.col("_f"), "left").withColumnRenamed("_s", "_padded").drop("_f", "_name")
    return padded.withColumn("scan_id", F.coalesce("_exact", "_padded")).drop("_exact", "_padded")


def interval_scans(rows: DataFrame, key: str, prefix: str, first: str, last: str, scans: DataFrame) -> DataFrame:
    """(key, scan_id, position): the scans whose file name is `prefix` and a number of the interval; an interval that ends before it begins is empty."""
    numbers = rows.where(F.col(last) >= F.col(first)).select(key, prefix, F.explode(F.sequence(F.col(first), F.col(last))).alias("_n"))
    named = numbers.withColumn("_name", F.concat(F.col(prefix), F.format_string("%04d", "_n")))
    return named.join(scans.select("scan_id", F.col("filename").alias("_name")), "_name").select(key, "scan_id", F.col("_n").alias("position"))


def missing_from(rows: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    return rows.join(table.select(F.col(table_key).alias(key)), key, "left_anti")


def upsert(current: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows after the merge, with `change`: created, updated, skipped (equal) or kept (not in the input)."""
    old = current.select(F.col(key), *[F.col(f).alias(f"_old_{f}") for f in fields], F.lit(True).alias("_was"))
    new = incoming.select(key, *fields).withColumn("_is", F.lit(True))
    both = old.join(new, key, "full_outer")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"_old_{f}"))
    change = F.when(F.col("_was").isNull(), "created").when(F.col("_is").isNull(), "kept").when(differs, "updated").otherwise("skipped")
    return both.withColumn("change", change).select(key, *[F.when(F.col("_is").isNull(), F.col(f"_old_{f}")).otherwise(F.col(f)).alias(f) for f in fields], "change")


def update_columns(rows: DataFrame, changes: DataFrame, key: str, columns: list[str], replace: bool = True) -> DataFrame:
    """rows with the columns of matching changes; without `replace`, only null or blank values are filled."""
    new = changes.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = rows.join(new, F.col(key) == F.col("_k"), "left")
    out = []
    for c in rows.columns:
        if c not in columns:
            out.append(F.col(c))
        elif replace:
            out.append(F.when(F.col("_k").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            empty = F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
            out.append(F.when(empty & F.col("_k").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(*out)
