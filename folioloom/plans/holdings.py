"""Records of inventories and of the series around them, the nested set of all, and the flat table of documents."""

from __future__ import annotations

import gzip
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import natural_key, side_order
from ..operators.hierarchy import ancestors
from .exports import LINKED_ART, Publisher
from .linked_art import AAT, PRIMARY_NAME, _type, places_jsonld, series_jsonld

#: Fixed values of the output: identifiers of a public vocabulary.
FILE_UNIT = ("300027046", "File unit")
ACCESSION_NUMBER = ("300312355", "Accession number")
ENTRY_NUMBER = ("300445023", "Entry number")
WEB_PAGE = ("300264578", "Web Page")
PLAIN_TEXT = ("300460247", "Plain text")
#: Fixed values of the output: what a manifest conforms to.
PRESENTATION = "http://iiif.io/api/presentation/"
MANIFEST_FORMAT = "application/ld+json;profile='http://iiif.io/api/presentation/3/context.json'"


def identifier_class(context: Column | str, classes: dict[str, tuple[str, str]]) -> Column:
    """(id, type, _label) of the first class whose name is part of the context; null ids for others, null contexts included."""
    c = F.coalesce(F.col(context) if isinstance(context, str) else context, F.lit(""))
    uri, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (i, text) in reversed(classes.items()):
        uri, label = F.when(c.contains(name), F.lit(i)).otherwise(uri), F.when(c.contains(name), F.lit(text)).otherwise(label)
    return F.struct(uri.alias("id"), F.lit("Type").alias("type"), label.alias("_label"))


def _chains(series: DataFrame) -> DataFrame:
    """(id, chain): JSON of each series inside-out: a set that is a member of the set above it, up to the root."""
    named = ancestors(series).join(series.select(F.col("id").alias("ancestor_id"), "title"), "ancestor_id")
    steps = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("depth", "title"))).alias("steps"))
    opened = F.array_join(F.transform("steps", lambda s: F.regexp_replace(F.to_json(F.struct(F.lit("Set").alias("type"), s["title"].alias("_label")), {"ignoreNullFields": "false"}), r"\}$", "")), ',"member_of":')
    return steps.select("id", F.concat(opened, F.repeat(F.lit("}"), F.size("steps"))).alias("chain"))


def _listed(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_l"))
    return got.select(key, F.concat(F.lit("["), F.array_join(F.transform("_l", lambda x: x[value]), ","), F.lit("]")).alias(name))


def inventories_jsonld(inventory: DataFrame, titles: DataFrame, document: DataFrame, settlement: DataFrame, label: DataFrame, series: DataFrame, inventory_series: DataFrame, by: Publisher | None = None) -> DataFrame:
    """(inventory_number, json): titles, dates, the distinct places of its documents, its series up to the root, and its documents by reference.

    One place is an object, several are a list in the order of their ids, none is null.
    """
    by = by or Publisher()
    keep = {"ignoreNullFields": "false"}
    number = F.col("inventory_number")
    uri = by.uri("inventory", number)
    title = _listed(titles.select("inventory_id", F.col("id").alias("o"), F.to_json(F.struct(F.lit("Title").alias("type"), F.col("title").alias("content")), keep).alias("j")), "inventory_id", "o", "j", "_titles")
    place = places_jsonld(settlement, label, by).withColumnRenamed("json", "j").join(settlement.select("glob_id", F.col("id").alias("location_id")), "glob_id")
    at = document.where("location_id is not null").select("inventory_id", "location_id").distinct().join(place, "location_id")
    places = at.groupBy("inventory_id").agg(F.array_sort(F.collect_list(F.struct("location_id", "j"))).alias("_p"))
    joined = F.array_join(F.transform("_p", lambda x: x["j"]), ",")
    places = places.select("inventory_id", F.when(F.size("_p") == 1, joined).otherwise(F.concat(F.lit("["), joined, F.lit("]"))).alias("_places"))
    reference = F.struct(by.uri("document", F.col("id")).alias("id"), F.lit("PhysicalHumanMadeThing").alias("type"), F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Document "), "id")).alias("_label"))
    parts = _listed(document.select("inventory_id", F.col("id").alias("o"), F.to_json(reference).alias("j")), "inventory_id", "o", "j", "_parts")
    chains = _listed(inventory_series.join(_chains(series).withColumnRenamed("id", "series_id"), "series_id").select("inventory_id", F.col("series_id").alias("o"), F.col("chain").alias("j")), "inventory_id", "o", "j", "_sets")
    inv = inventory.withColumnRenamed("id", "inventory_id")
    for more in (title, places, parts, chains):
        inv = inv.join(more, "inventory_id", "left")

    def identifier(entry: tuple[str, str], content: Column) -> Column:
        return F.struct(F.lit("Identifier").alias("type"), F.array(_type(entry)).alias("classified_as"), content.cast("string").alias("content"))

    span = F.when(F.col("date_start").isNotNull() | F.col("date_end").isNotNull(), F.struct(F.lit("Timespan").alias("type"), F.col("date_start").cast("string").alias("begin_of_the_begin"), F.col("date_end").cast("string").alias("end_of_the_end")))
    web = F.struct(F.lit("DigitalObject").alias("type"), F.concat(F.lit("Inventory "), number, F.lit(" at its archive")).alias("_label"), F.array(_type(WEB_PAGE)).alias("classified_as"), F.struct(F.nullif("handle", F.lit("")).alias("id"), F.lit("DigitalObject").alias("type")).alias("access_point"))
    manifest = F.struct(F.concat(uri, F.lit(".manifest")).alias("id"), F.lit("DigitalObject").alias("type"), F.concat(F.lit("IIIF Manifest for Inventory "), number).alias("_label"))
    iiif = F.struct(F.lit("DigitalObject").alias("type"), F.array(manifest).alias("access_point"), F.array(F.struct(F.lit(PRESENTATION).alias("id"), F.lit("InformationObject").alias("type"))).alias("conforms_to"), F.lit(MANIFEST_FORMAT).alias("format"))
    text = F.struct(F.concat(uri, F.lit(".txt")).alias("id"), F.lit("DigitalObject").alias("type"), F.concat(F.lit("Plain text of Inventory "), number).alias("_label"), _type(PLAIN_TEXT).alias("classified_as"), F.lit("text/plain").alias("format"))

    def carried(what: Column) -> Column:
        return F.to_json(F.struct(F.lit("LinguisticObject").alias("type"), F.array(what).alias("digitally_carried_by")), keep)

    def member(name: str, json_text: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), json_text)

    empty = F.lit("[]")
    made_by = F.concat(F.lit('{"type":"Production",'), member("took_place_at", F.coalesce("_places", F.lit("null"))), F.lit(","), member("timespan", F.coalesce(F.to_json(span, keep), F.lit("null"))), F.lit(',"carried_out_by":{"type":"Actor","_label":"Polity or Person"}}'))
    head = F.to_json(F.struct(F.lit(LINKED_ART).alias("@context"), uri.alias("id"), F.lit("CuratedHolding").alias("type"), F.concat(F.lit("Inventory "), number).alias("_label"), F.array(_type(FILE_UNIT)).alias("classified_as"), F.array(identifier(ACCESSION_NUMBER, number), identifier(ENTRY_NUMBER, F.col("inventory_id"))).alias("identified_by")), keep)
    carries = F.to_json(F.struct(F.lit("LinguisticObject").alias("type"), F.lit("Textual content of the inventory").alias("_label"), text.alias("digitally_carried_by")))
    rest = F.concat_ws(",", member("title", F.coalesce("_titles", empty)), member("produced_by", made_by), member("member_of", F.coalesce("_sets", empty)), member("part", F.coalesce("_parts", empty)), member("subject_of", F.concat(F.lit("["), carried(web), F.lit(","), carried(iiif), F.lit("]"))), member("carries", carries))
    return inv.select("inventory_number", F.concat(F.regexp_replace(head, r"\}$", ","), rest, F.lit("}")).alias("json"))


def series_members(series: DataFrame, inventory: DataFrame, inventory_series: DataFrame, by: Publisher | None = None) -> DataFrame:
    """(id, members): array of (id, type, _label) of each series: series below it by title, then inventories in natural order."""
    by = by or Publisher()
    key = "struct<number:bigint,suffix:string>"
    below = series.where("part_of_id is not null").select(F.col("part_of_id").alias("id"), F.struct(F.lit(0).alias("kind"), F.coalesce("title", F.lit("")).alias("name"), F.lit(None).cast(key).alias("number"), F.struct(by.uri("series", F.col("id").cast("string")).alias("id"), F.lit("Set").alias("type"), F.col("title").alias("_label")).alias("m")).alias("e"))
    held = inventory_series.join(inventory.select(F.col("id").alias("inventory_id"), "inventory_number"), "inventory_id")
    held = held.select(F.col("series_id").alias("id"), F.struct(F.lit(1).alias("kind"), F.lit("").alias("name"), natural_key("inventory_number").cast(key).alias("number"), F.struct(by.uri("inventory", F.col("inventory_number")).alias("id"), F.lit("CuratedHolding").alias("type"), F.concat(F.lit("Inventory "), "inventory_number").alias("_label")).alias("m")).alias("e"))
    return below.unionByName(held).groupBy("id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["m"]).alias("members"))


def series_with_members(series: DataFrame, inventory: DataFrame, inventory_series: DataFrame, by: Publisher | None = None) -> DataFrame:
    """(id, json): each series' record, with its members if it has any."""
    got = series_jsonld(series, by).join(series_members(series, inventory, inventory_series, by), "id", "left")
    more = F.concat(F.regexp_replace("json", r"\}$", ',"member":'), F.to_json("members", {"ignoreNullFields": "false"}), F.lit("}"))
    return got.select("id", F.when(F.col("members").isNotNull(), more).otherwise(F.col("json")).alias("json"))


def nested_set(series: DataFrame, inventory: DataFrame, inventory_series: DataFrame, label: str = "Set of all inventories", name: str = "All inventories", by: Publisher | None = None) -> dict:
    """The set of all series without a parent, each with all below it inside.

    One record of the whole tree, put together on the driver: a finding aid of some
    thousand entries. Series in a cycle are below no root and do not come.
    """
    by = by or Publisher()
    rows = {f"{by.base}series:{r.id}": (json.loads(r.json), r.part_of_id, r.title) for r in series_with_members(series, inventory, inventory_series, by).join(series.select("id", "part_of_id", "title"), "id").collect()}

    def nest(uri: str) -> dict:
        record = {k: v for k, v in rows[uri][0].items() if k != "member_of"}
        if "member" in record:
            record["member"] = [nest(m["id"]) if m["type"] == "Set" else m for m in record["member"]]
        return record

    roots = sorted((uri for uri, (_, up, _) in rows.items() if up is None), key=lambda uri: (rows[uri][2] or "", uri))
    carried = {"type": "DigitalObject", "access_point": [{"id": f"{by.base}inventory:collection", "type": "DigitalObject", "_label": "IIIF Collection of all inventories"}], "conforms_to": [{"id": PRESENTATION, "type": "InformationObject"}], "format": MANIFEST_FORMAT}
    kind = {"id": AAT + PRIMARY_NAME[0], "type": "Type", "_label": PRIMARY_NAME[1]}
    return {"@context": LINKED_ART, "id": f"{by.base}inventory:set", "type": "Set", "_label": label, "identified_by": [{"type": "Name", "classified_as": [kind], "content": name}], "member": [nest(r) for r in roots], "subject_of": [{"type": "LinguisticObject", "digitally_carried_by": [carried]}]}


def write_json(record: dict, path: str) -> None:
    """One record as a file, compressed if its name ends in .gz."""
    open_file = gzip.open if path.endswith(".gz") else open
    with open_file(path, "wt", encoding="utf-8") as f:
        json.dump(record, f, ensure_ascii=False, indent=2)


def document_table(document: DataFrame, inventory: DataFrame, link: DataFrame, page: DataFrame, scan: DataFrame, types: DataFrame, settlement: DataFrame, label: DataFrame, method: DataFrame, by: Publisher | None = None) -> DataFrame:
    """The flat table of documents in thirteen columns; what is missing is an empty string.

    Start and end are by file name, then side of the page. types: document_id,
    document_type_id. A settlement is named by the label with the smallest id, or
    by its own name. Links that bear `recto_verso`, `filename` and `scan_type` of
    their pages are not joined with pages.
    """
    by = by or Publisher()
    on = link
    if not {"recto_verso", "filename", "scan_type"} <= set(link.columns):
        pages = page.select(F.col("id").alias("page_id"), "scan_id", "recto_verso").join(scan.select(F.col("id").alias("scan_id"), "filename", "scan_type"), "scan_id", "left")
        on = link.join(pages, "page_id")
    order = F.struct(F.coalesce("filename", F.lit("")), side_order("recto_verso"))
    end = F.struct("filename", "scan_type")
    ends = on.groupBy(F.col("document_id").alias("id")).agg(F.min_by(end, order).alias("a"), F.max_by(end, order).alias("b"))
    uris = types.groupBy(F.col("document_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(by.uri("thesaurus", F.col("document_type_id")))), ",").alias("type_uuids"))
    named = label.groupBy("settlement_id").agg(F.min_by("label", "id").alias("_label"))
    place = settlement.select(F.col("id").alias("settlement_id"), "glob_id").join(named, "settlement_id", "left").select(F.col("settlement_id").alias("location_id"), F.coalesce("_label", "glob_id").alias("settlement"))
    d = document.join(inventory.select(F.col("id").alias("inventory_id"), "inventory_number"), "inventory_id", "left").join(ends, "id", "left").join(uris, "id", "left")
    d = d.join(place, "location_id", "left").join(method.select(F.col("id").alias("method_id"), F.col("name").alias("method")), "method_id", "left")

    def text(c: str, name: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)

    columns = {"inventory_number": "inventory_number", "type_uuids": "type_uuids", "start_scan_filename": "a.filename", "end_scan_filename": "b.filename", "start_scan_type": "a.scan_type", "end_scan_type": "b.scan_type", "title": "title", "date_start": "date_earliest_begin", "date_end": "date_latest_end", "settlement": "settlement"}
    place_id = F.when(F.col("settlement").isNotNull(), F.col("location_id").cast("string")).otherwise("").alias("settlement_id")
    return d.select(F.col("id").alias("identifier"), *[text(c, n) for n, c in columns.items()], place_id, text("method", "method"))
