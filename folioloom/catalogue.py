"""Queries of the archive operators, with their DuckDB SQL."""

from __future__ import annotations

from .plans import view_queries  # noqa: F401 - registers its queries
from .plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "segmentation_stats_by_inventory"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
