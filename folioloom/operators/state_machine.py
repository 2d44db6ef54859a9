"""Validated segmentation: rows of boundary tokens per file, read in order with the documents that are open.

The state (current document, current part, a counter) depends on every row
before, so a file is one group; a file describes one bound volume.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grouped import solve_groups

SCHEMA = T.StructType().add("file", "string").add("row", "integer").add("filename", "string").add("document", "string").add("part_of", "string").add("kind", "string").add("seq", "integer")
_COLUMNS = ("row", "filename", "boundary", "identifier", "parts", "other")
_SAME = re.compile(r"^\s*SAME\s+AS\s+(.+?)\s*$", re.IGNORECASE)


def _text(v: object) -> str | None:
    return v.strip() or None if isinstance(v, str) else None


def segment_file(rows: list[dict], inventory: str) -> list[tuple[int, str, str, str | None, str]]:
    """(row, filename, document, part_of, kind) of each link of a scan with a document, in order of rows; kind is document or part.

    A document is its identifier, whatever is open. START of a part counts up and
    belongs to the current document, also where that ends on the same row. END on
    a row with an identifier links first and closes then, and leaves none current.
    Pages of another type are not linked, but their boundaries take effect.
    'SAME AS f' links to the documents, not the parts, that rows of f name, be it
    later in the file; these links come after all others.
    """
    out: list[tuple[int, str, str, str | None, str]] = []
    of_scan: dict[str, list[tuple[str, str | None, str]]] = {}
    waiting: list[tuple[int, str, str, bool]] = []
    current = part = None
    parent_of: dict[str, str | None] = {}
    count = 0
    for r in rows:
        scan = _text(r["filename"])
        if scan is None:
            continue
        boundary, mine, closing = _text(r["boundary"]), [], False
        other = _text(r["other"]) is not None
        same = _SAME.match(boundary or "")
        if same:
            waiting.append((r["row"], scan, same[1], other))
        else:
            key = _text(r["identifier"])
            if key is not None:
                closing = boundary == "END"
                current = key
                mine.append((key, None, "document"))
        tokens = [t.strip().upper() for t in (_text(r["parts"]) or "").split("/") if t.strip()]
        for t in tokens:
            if t == "START":
                count += 1
                part = f"{inventory}-SUBDOC-{count:04d}"
                parent_of[part] = current
                mine.append((part, current, "part"))
            elif t == "END" and part is not None:
                mine.append((part, parent_of[part], "part"))
                part = None
        if not tokens and part is not None:
            mine.append((part, parent_of[part], "part"))
        if closing:
            current = None
        mine = list(dict.fromkeys(mine))
        of_scan.setdefault(scan, []).extend(m for m in mine if m[2] == "document")
        if not other:
            out += [(r["row"], scan, *m) for m in mine]
    have = {(s, d) for _, s, d, _, _ in out} if waiting else set()
    for row, scan, source, other in waiting:
        if not other:
            new = [(row, scan, *m) for m in dict.fromkeys(of_scan.get(source, [])) if (scan, m[0]) not in have]
            have.update((scan, n[2]) for n in new)
            out += new
    return out


def segmentation_events(rows: DataFrame) -> DataFrame:
    """Links of all files, `seq` being their order in a file. rows: file, row, filename, boundary, identifier, parts, other."""

    def solve(group: dict[str, list]) -> list[tuple]:
        file = group["file"][0]
        names = (p.rsplit("_", 2) for p in group["filename"] if p is not None)
        from_rows = next((p[1] for p in names if len(p) == 3 and p[2].isdigit()), None)
        from_file = re.match(r"\d+", file or "")
        inventory = from_rows or (from_file[0] if from_file else "0")
        lines = [dict(zip(_COLUMNS, r, strict=True)) for r in zip(*(group[c] for c in _COLUMNS), strict=True)]
        return [(file, *g, i) for i, g in enumerate(segment_file(lines, inventory))]

    return solve_groups(rows.select("file", *_COLUMNS), "file", [F.asc_nulls_last("row")], solve, SCHEMA)
