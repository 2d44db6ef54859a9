"""The series tree: ancestors, paths and closures, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ancestors(series: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, ancestor_id, depth): every series with itself (depth 0) and all above it.

    In a cycle every series of it comes once; with `max_depth`, as often as that many levels bring it.
    """
    level = series.select("id", F.col("id").alias("ancestor_id"), F.lit(0).alias("depth"), F.array("id").alias("_seen"))
    up = series.select(F.col("id").alias("_child"), "part_of_id").where("part_of_id is not null")
    out = level.drop("_seen")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        level = level.join(up, F.col("ancestor_id") == F.col("_child"))
        if max_depth is None:
            level = level.where(~F.array_contains("_seen", F.col("part_of_id")))
        level = level.select("id", F.col("part_of_id").alias("ancestor_id"), F.lit(depth).alias("depth"), F.array_append("_seen", F.col("part_of_id")).alias("_seen"))
        if level.isEmpty():
            break
        out = out.unionByName(level.drop("_seen"))
    return out


def paths(series: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, path, depth): titles from the root down, joined by ' > '."""
    named = ancestors(series, max_depth).join(series.select(F.col("id").alias("ancestor_id"), "title"), "ancestor_id")
    grouped = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "title"))).alias("steps"), F.max("depth").alias("depth"))
    return grouped.select("id", F.array_join(F.transform("steps", lambda s: s.title), " > ").alias("path"), "depth")


def closure(series: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted series (id) and all above them."""
    return ancestors(series).join(wanted.select("id"), "id", "left_semi").select(F.col("ancestor_id").alias("id")).distinct()
