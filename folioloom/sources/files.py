"""Tabular inputs. Everything is read as text and cast with try_cast, so a typed guess never turns an integer into a float."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blank_to_null, strip


class MissingColumns(ValueError):
    pass


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df


def csv(spark: SparkSession, paths: str | list[str], required: list[str] = (), separator: str = ",") -> DataFrame:
    """CSV files with headers, all columns text, united by name; blank values are null."""
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        df = spark.read.csv(path, header=True, sep=separator, multiLine=True, escape='"', inferSchema=False)
        df = df.select(*[F.col(f"`{c}`").alias(c.strip().lstrip("﻿")) for c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    require(out, list(required))
    return out.select(*[blank_to_null(F.col(f"`{c}`")).alias(c) for c in out.columns])


SCANS = ["inventory_number", "na_identifier_inventory", "file_name_scan", "na_identifier_scan", "iiif_info_url", "width", "height"]
PAGES = ["doc_id", "inventory", "scan_type", "headers", "signature_marks", "page_numbers", "has_marginalia", "is_blank"]


def scan_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    df = csv(spark, paths, SCANS)
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double").cast("int"), F.lit(0)) for c in ("width", "height")})


def truth(c: str):
    """A Boolean of text; null stays null."""
    v = F.lower(strip(c))
    return F.when(v.isin("true", "1", "1.0", "yes"), True).when(v.isin("false", "0", "0.0", "no"), False)


def page_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    return csv(spark, paths, PAGES).withColumns({c: truth(c) for c in ("has_marginalia", "is_blank")})


def location_rows(spark: SparkSession, path: str, label: str = "SETTLEMENT", key: str = "ID") -> DataFrame:
    df = csv(spark, path, [label, key])
    return df.select(blank_to_null(strip(label)).alias("label"), blank_to_null(strip(key)).alias("glob_id")).dropna()


def annotation_rows(spark: SparkSession, path: str) -> DataFrame:
    names = ["transcriptions", "entities", "events"]
    df = csv(spark, path, ["filename", *names])
    return df.select("filename", *[(F.col(c).try_cast("int") == 1).alias(c) for c in names])


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of one JSON object; value is a type name."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "value"))


def merged_map(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Both maps; an extra entry takes the place of the base one."""
    new = extra.select("key", F.col("value").alias("_new"), F.lit(True).alias("_has"))
    return base.join(new, "key", "full_outer").select("key", F.when(F.col("_has"), F.col("_new")).otherwise(F.col("value")).alias("value"))


HIERARCHY = "series array<struct<id:string,title:string,part_of_id:string,code:string,level:string,path:string>>, inventories array<struct<id:string,inventory_number:string>>, inventory_series array<struct<inventory_id:string,series_id:string>>"


def hierarchy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(series, inventories, inventory_series) of a hierarchy file."""
    doc = spark.read.schema(HIERARCHY).json(path, multiLine=True)
    return tuple(doc.select(F.inline(c)) for c in ("series", "inventories", "inventory_series"))


def parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return require(spark.read.parquet(path), columns).select(*columns)


SEGMENTS = {"Scan File_Name": "filename", "TANAP Boundaries": "boundary", "TANAP ID": "identifier", "Subdocument boundaries": "parts", "Type of non-document page": "other"}


def segmentation_rows(spark: SparkSession, folder: str, pattern: str = "*.csv", recursive: bool = False, columns: dict[str, str] = SEGMENTS) -> DataFrame:
    """Rows of all segmentation files in a folder, with file and row number; each file is separated by ; or , as its header shows."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=recursive).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "^﻿", "").alias("body"))
    lines = files.select("file", F.split("body", r"\r?\n").alias("lines"))
    head = F.element_at("lines", 1)
    mark = F.when(F.size(F.split(head, ";")) >= F.size(F.split(head, ",")), ";").otherwise(",")
    rows = lines.select("file", mark.alias("mark"), head.alias("head"), F.posexplode(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).alias("row", "line")).where(F.trim("line") != "")

    def fields(text, sep):
        # A separator inside quotes does not count.
        return F.transform(F.split(text, sep + '(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), '^"|"$', ""), '""', '"'))

    def both(text):
        return F.when(F.col("mark") == ";", fields(text, ";")).otherwise(fields(text, ","))

    split = rows.select("file", "row", both(F.col("head")).alias("names"), both(F.col("line")).alias("values"))

    def named(name):
        at = F.array_position("names", F.lit(name))
        return blank_to_null(strip(F.when(at > 0, F.try_element_at("values", at.cast("int")))))

    return split.select("file", "row", *[named(name).alias(short) for name, short in columns.items()])
