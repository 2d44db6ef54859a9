"""Small trees that are read on the driver: a thesaurus in Turtle and a finding aid in EAD."""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ET
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_TOKEN = re.compile(r'''\s+|\#[^\n]*|<(?P<uri>[^>]*)>|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*""")|(?P<text>"(?:[^"\\\n]|\\.)*")|@(?P<lang>[A-Za-z][\w-]*)|\^\^|(?P<mark>[.;,\[\]()])|(?P<name>[^\s;,<>"\[\]()]+)''')
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
SKOS = "http://www.w3.org/2004/02/skos/core#"
TRIPLE = "subject string, predicate string, object string, lang string, is_uri boolean"


def turtle(text: str) -> list[tuple[str, str, str, str | None, bool]]:
    """Triples of a Turtle text: prefixes, predicate and object lists, plain and long strings with languages. Blank nodes are passed over."""
    prefixes: dict[str, str] = {}
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read Turtle at {text[at:at + 40]!r}")
        at = m.end()
        kind = m.lastgroup
        if kind == "name" and m[kind].endswith(".") and len(m[kind]) > 1:
            tokens += [("name", m[kind][:-1]), ("mark", ".")]
        elif kind:
            tokens.append((kind, m[kind]))

    def full(kind: str, value: str) -> str:
        if kind == "uri":
            return value
        if value == "a":
            return RDF_TYPE
        head, colon, tail = value.partition(":")
        return prefixes.get(head, head + colon) + tail if colon else value

    def plain(value: str) -> str:
        body = value[3:-3] if value.startswith('"""') else value[1:-1]
        return re.sub(r'\\(u[0-9A-Fa-f]{4}|.)', lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body)

    out: list[tuple[str, str, str, str | None, bool]] = []
    i = 0
    while i < len(tokens):
        kind, value = tokens[i]
        if (kind, value) == ("lang", "prefix") or (kind == "name" and value.lower() == "prefix"):
            prefixes[tokens[i + 1][1].rstrip(":")] = tokens[i + 2][1]
            i += 3 + (i + 3 < len(tokens) and tokens[i + 3] == ("mark", "."))
            continue
        if kind == "mark":
            i += 1
            continue
        subject, i = full(kind, value), i + 1
        predicate, depth = None, 0
        while i < len(tokens):
            kind, value = tokens[i]
            i += 1
            if kind == "mark" and value in "[(":
                depth += 1
            elif kind == "mark" and value in "])":
                depth -= 1
            elif depth:
                continue
            elif kind == "mark" and value == ".":
                break
            elif kind == "mark" and value == ";":
                predicate = None
            elif kind == "mark":
                continue
            elif predicate is None:
                predicate = full(kind, value)
            elif kind in ("text", "long"):
                lang = None
                if i < len(tokens) and tokens[i][0] == "lang":
                    lang, i = tokens[i][1], i + 1
                out.append((subject, predicate, plain(value), lang, False))
            else:
                out.append((subject, predicate, full(kind, value), None, True))
    return out


def triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(turtle(Path(path).read_text(encoding="utf-8")), TRIPLE)


def ascii_text(s: str) -> str:
    """Latin letters without their marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).encode("ascii", "ignore").decode()


def title_key(s: str) -> str:
    """Condé-sur-l'Escaut is conde-sur-l-escaut."""
    return re.sub(r"[^a-z0-9]+", "-", ascii_text(s).lower()).strip("-")


def code_key(s: str) -> str:
    """'7.27A, 7.37A' is 7.27A-7.37A."""
    return re.sub(r"[\s,/]+", "-", s.strip()).strip("-")


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _children(e: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in e if _local(c) == name]


def _text(e: ET.Element | None) -> str:
    return re.sub(r"\s{2,}", " ", "".join(e.itertext()).strip()) if e is not None else ""


def _levels(e: ET.Element) -> list[ET.Element]:
    return [c for c in e if re.fullmatch(r"c(?:\d\d)?", _local(c))]


def _did(e: ET.Element, name: str) -> ET.Element | None:
    did = next(iter(_children(e, "did")), None)
    return next(iter(_children(did, name)), None) if did is not None else None


def finding_aid(source: str, wanted: set[str] | None = None) -> dict[str, list[dict]]:
    """{series, inventories, inventory_series} of an EAD file: series with their paths, and each wanted inventory in its deepest series.

    Nodes without wanted inventories below them are left out. Ids are paths of
    codes, so they are the same in every run.
    """
    root = ET.parse(source).getroot()
    out: dict[str, list[dict]] = {"series": [], "inventories": [], "inventory_series": []}
    seen: set[str] = set()

    def walk(e: ET.Element, parent: str | None) -> bool:
        level = (e.get("level") or "").lower()
        level = (e.get("otherlevel") or level).lower() if level == "otherlevel" else level
        code, title = _text(_did(e, "unitid")), _text(_did(e, "unittitle"))
        if level in ("file", "item"):
            if not code or (wanted is not None and code not in wanted):
                return False
            date = _did(e, "unitdate")
            start, _, end = ((date.get("normal") or _text(date)) if date is not None else "").partition("/")
            dao = _did(e, "dao")
            if code not in seen:
                seen.add(code)
                out["inventories"].append({"id": code, "inventory_number": code, "handle": dao.get("href") if dao is not None else None, "date_start": ead_date(start), "date_end": ead_date(end or start), "titles": [title] if title else []})
            if parent is not None:
                out["inventory_series"].append({"inventory_id": code, "series_id": parent})
            return True
        here, at = parent, len(out["series"])
        is_series = level in ("series", "subseries") or (level == "fonds" and bool(title))
        if is_series:
            key = code_key(code) or title_key(title) or str(at)
            here = f"{parent}/{key}" if parent else key
            out["series"].append({"id": here, "title": f"{code} - {title}" if code else title, "part_of_id": parent, "code": code, "level": level, "path": here})
        found = [walk(c, here) for c in _levels(e)]
        if not any(found) and is_series:
            del out["series"][at:]
        return any(found)

    for dsc in (e for e in root.iter() if _local(e) == "dsc"):
        for c in _levels(dsc):
            walk(c, None)
    return out


def ead_date(s: str) -> str | None:
    """A year stays a year, a month gets its first day; anything else that is no date is null."""
    s = s.strip()
    if re.fullmatch(r"\d{4}|\d{4}-\d{2}-\d{2}", s):
        return s
    return f"{s}-01" if re.fullmatch(r"\d{4}-\d{2}", s) else None
