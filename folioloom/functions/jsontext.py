"""JSON as text: what is the same in all records is one literal, and only values are put in, without a generator for each record."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(c: Column) -> Column:
    """A string as JSON, null as null; to_json is asked only where something has to be escaped."""
    escaped = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNull(), "null").when(c.rlike(r'["\\\x00-\x1f]'), F.substr(escaped, F.lit(6), F.length(escaped) - 6)).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def number(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


class Raw:
    """A column that is JSON text already; it must not be null."""

    def __init__(self, column: Column):
        self.column = column


def json_text(value: object) -> Column:
    """JSON text of nested dicts and lists of constants, string columns, and Raw columns."""
    pieces: list[str | Column] = []

    def put(piece: str | Column) -> None:
        if isinstance(piece, str) and pieces and isinstance(pieces[-1], str):
            pieces[-1] += piece
        else:
            pieces.append(piece)

    def walk(v: object) -> None:
        if isinstance(v, dict):
            for i, (k, x) in enumerate(v.items()):
                put(f"{',' if i else '{'}{json.dumps(k)}:")
                walk(x)
            put("}" if v else "{}")
        elif isinstance(v, list):
            put("[")
            for i, x in enumerate(v):
                put("," if i else "")
                walk(x)
            put("]")
        elif isinstance(v, Raw):
            put(v.column)
        elif isinstance(v, Column):
            put(quoted(v))
        else:
            put(json.dumps(v, ensure_ascii=False))

    walk(value)
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces if not isinstance(p, str) or p])
