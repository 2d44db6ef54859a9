"""Linked Art records of scans, pages, places and series, made of columns and turned into JSON by Spark."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import image_url, languages
from ..functions.jsontext import Raw, json_text, number
from .exports import LINKED_ART, Publisher, _json

#: Fixed values of the output: identifiers of a public vocabulary.
AAT = "http://vocab.getty.edu/aat/"
DIGITIZED_IMAGE = ("300417380", "Digitized image")
HEIGHT = ("300055644", "Height")
WIDTH = ("300055647", "Width")
PIXELS = ("300266190", "pixels")
RECTO = ("300078817", "Recto")
VERSO = ("300010292", "Verso")
PART = ("300241583", "Page")
PART_TYPE = ("300241583", "Part Type")
SUBSERIES = ("300404023", "Archival Subseries (subgroups)")
GROUPING = ("300404022", "Archival Grouping")
PRIMARY_NAME = ("300404670", "Primary Name")
#: Fixed values of the output: names of languages by code, and their vocabulary numbers where there are any.
LANGUAGES = {
    "nld": ("Dutch", "300388256"),
    "fra": ("French", "300388306"),
    "eng": ("English", "300388277"),
    "lat": ("Latin", "300388693"),
    "por": ("Portuguese", "300389115"),
    "msa": ("Malay", "300388786"),
    "sin": ("Sinhala", "300389279"),
    "deu": ("German", "300388344"),
    "spa": ("Spanish", "300389311"),
    "dan": ("Danish", "300388204"),
    "ita": ("Italian", "300388474"),
    "tam": ("Tamil", "300389365"),
    "fas": ("Persian", "300389087"),
    "jpn": ("Japanese", "300388486"),
    "ben": ("Bengali", "300387971"),
    "guj": ("Gujarati", "300388371"),
    "heb": ("Hebrew", "300388401"),
    "lzh": ("Literary Chinese", None),
    "chu": ("Church Slavic", "300389289"),
    "bug": ("Buginese", None),
    "grc": ("Ancient Greek", "300387827"),
    "art": ("Artificial language (unspecified)", "300389747"),
}


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _kind(entry: tuple[str, str], kind: str = "Type") -> dict:
    return {"id": AAT + entry[0], "type": kind, "_label": entry[1]}


def _type(entry: tuple[str, str]) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in _kind(entry).items()])


def language_objects(codes: Column) -> Column:
    """Language objects of a comma-separated list of codes, in order; a code without an entry is its own label."""
    pairs = [F.lit(x) for code, entry in LANGUAGES.items() for x in (code, entry[0])]
    numbers = [F.lit(x) for code, entry in LANGUAGES.items() if entry[1] for x in (code, AAT + entry[1])]
    label, uri = F.create_map(*pairs), F.create_map(*numbers)
    return F.transform(languages(codes), lambda c: F.struct(F.lit("Language").alias("type"), F.coalesce(F.try_element_at(label, c), c).alias("_label"), F.try_element_at(uri, c).alias("id")))


def _scan(c: str = "") -> dict:
    """The record of a scan from its columns, which may be fields of a struct."""

    def col(name: str) -> Column:
        return F.col(f"{c}{name}")

    def identifier(content: Column) -> dict:
        return {"type": "Identifier", "classified_as": None, "content": content}

    def dimension(entry: tuple[str, str], value: Column) -> dict:
        return {"type": "Dimension", "classified_as": _kind(entry), "value": Raw(number(value)), "unit": _kind(PIXELS, "MeasurementUnit")}

    return {
        "@context": LINKED_ART,
        "id": F.concat(F.lit("urn:uuid:"), col("id")),
        "type": "DigitalObject",
        "_label": F.concat(F.lit("Scan "), col("filename")),
        "classified_as": [_kind(DIGITIZED_IMAGE)],
        "identified_by": [identifier(F.coalesce(col("na_identifier"), F.lit(""))), identifier(col("id"))],
        "dimension": [dimension(HEIGHT, col("height")), dimension(WIDTH, col("width"))],
        "access_point": {"id": F.coalesce(image_url(f"{c}iiif_image_info", "max"), F.lit("")), "type": "DigitalObject"},
        "format": "image/jpeg",
        "digitally_carries": None,
        "digitally_shows": None,
    }


def scans_jsonld(scan: DataFrame) -> DataFrame:
    """(id, json) of each scan."""
    return scan.select("id", json_text(_scan()).alias("json"))


def pages_jsonld(page: DataFrame, scan: DataFrame, by: Publisher | None = None) -> DataFrame:
    """(id, json) of each page, with the scan that shows it and the languages of that scan."""
    by = by or Publisher()
    s = scan.select(F.col("id").alias("scan_id"), F.struct(*scan.columns).alias("s"))
    p = page.join(s, "scan_id", "left")

    def side(entry: tuple[str, str]) -> str:
        return json.dumps(_kind(entry) | {"classified_as": [_kind(PART_TYPE)]}, separators=(",", ":"))

    kind = F.when(F.col("recto_verso") == "Recto", side(RECTO)).when(F.col("recto_verso") == "Verso", side(VERSO)).otherwise(side(PART))
    codes = F.col("s.languages") if "languages" in scan.columns else _null()
    spoken = F.when(codes.isNotNull() & (F.size(languages(codes)) > 0), _json(language_objects(codes))).otherwise("null")
    carried = {"id": "", "type": "DigitalObject", "_label": F.concat(F.lit("PageXML of "), F.coalesce("s.filename", F.lit("unknown scan")))}
    record = {
        "@context": LINKED_ART,
        "id": by.uri("document", F.col("id")),
        "type": "PhysicalHumanMadeThing",
        "_label": F.concat(F.lit("Page "), F.coalesce(F.nullif("page_or_folio_number", F.lit("")), F.substring("id", 1, 8))),
        "classified_as": [Raw(kind)],
        "carries": {"id": None, "type": "LinguisticObject", "_label": "Textual content of the page", "language": Raw(spoken), "digitally_carried_by": carried},
        "shows": {"id": None, "type": "VisualItem", "_label": "Visual depiction of the page.", "digitally_shown_by": Raw(F.when(F.col("s").isNotNull(), json_text(_scan("s."))).otherwise("null"))},
    }
    return p.select("id", json_text(record).alias("json"))


def places_jsonld(settlement: DataFrame, label: DataFrame, by: Publisher | None = None) -> DataFrame:
    """(glob_id, json) of each settlement: its distinct labels in order of their ids, the first one naming it."""
    by = by or Publisher()
    told = label.withColumn("label", F.trim("label")).where("label <> ''")
    names = told.groupBy(F.col("settlement_id")).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("id", "label"))), lambda x: x["label"])).alias("names"))
    s = settlement.join(names, settlement["id"] == F.col("settlement_id"), "left")
    named = F.transform("names", lambda n: F.struct(F.lit("Name").alias("type"), n.alias("content")))
    fields = [F.lit("Place").alias("type"), F.coalesce(F.try_element_at("names", F.lit(1)), "glob_id").alias("_label"), by.uri("place", F.col("glob_id")).alias("id"), named.alias("identified_by")]
    return s.select("glob_id", F.to_json(F.struct(*fields)).alias("json"))  # a place has no fields that are null


def series_jsonld(series: DataFrame, by: Publisher | None = None) -> DataFrame:
    """(id, json) of each series, with the series that it is a member of."""
    by = by or Publisher()
    up = series.select(F.col("id").alias("up_id"), F.col("title").alias("up_title"))
    s = series.join(up, F.col("part_of_id") == F.col("up_id"), "left")
    name = F.struct(F.lit("Name").alias("type"), F.array(_type(PRIMARY_NAME)).alias("classified_as"), F.col("title").alias("content"))
    member = F.array(F.struct(by.uri("series", F.col("up_id")).alias("id"), F.lit("Set").alias("type"), F.col("up_title").alias("_label")))
    fields = [
        F.lit(LINKED_ART).alias("@context"),
        by.uri("series", F.col("id")).alias("id"),
        F.lit("Set").alias("type"),
        F.col("title").alias("_label"),
        F.array(F.when(F.col("part_of_id").isNotNull(), _type(SUBSERIES)).otherwise(_type(GROUPING))).alias("classified_as"),
        F.array(name).alias("identified_by"),
        F.when(F.col("up_id").isNotNull(), member).alias("member_of"),
    ]
    return s.select("id", F.to_json(F.struct(*fields)).alias("json"))  # a series without a parent has no such field
