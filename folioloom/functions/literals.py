"""Python-literal lists in text ("['695 ', '696']"). No built-in function reads them, so these are Arrow UDFs."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _parsed(value: str | None):
    if value is None:
        return None, False
    try:
        return ast.literal_eval(value.strip()), True
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return value, False


def folio_text(value: str | None) -> str | None:
    """Stripped non-empty items of a list joined by commas; a scalar as text; unreadable text as it is; nothing: null."""
    found, read = _parsed(value)
    if not read:
        return value
    if isinstance(found, list):
        items = [str(x).strip() for x in found]
        return ",".join(x for x in items if x) or None
    return None if found is None else str(found)


def header_text(value: str | None) -> str | None:
    """Stripped items of a list or tuple joined by spaces; a quoted string unquoted; nothing: null."""
    found, read = _parsed(value)
    if not read:
        return (value or "").strip() or None
    if isinstance(found, list | tuple):
        return " ".join(x for x in (str(i).strip() for i in found) if x) or None
    return (str(found).strip() or None) if found is not None else None


@F.pandas_udf(T.StringType())
def parse_folios(values: pd.Series) -> pd.Series:
    return values.map(lambda v: folio_text(v if isinstance(v, str) else None))


@F.pandas_udf(T.StringType())
def parse_header(values: pd.Series) -> pd.Series:
    return values.map(lambda v: header_text(v if isinstance(v, str) else None))
