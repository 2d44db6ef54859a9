"""Table snapshots: load, save, and check what a database would enforce."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import FOREIGN, REQUIRED, SCHEMAS, UNIQUE


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order; missing ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields])


def save(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    for name, df in tables.items():
        conform(df, name).write.mode(mode).parquet(f"{folder}/{name}.parquet")


def load(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.schema(SCHEMAS[n]).parquet(f"{folder}/{n}.parquet") for n in names or SCHEMAS}


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, rows) for each broken rule: null keys, repeated unique values, references to nothing."""
    found = []

    def count(table: str, rule: str, rows: DataFrame) -> None:
        found.append(rows.agg(F.count("*").alias("rows")).select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), "rows"))

    for name, df in tables.items():
        for columns in UNIQUE.get(name, []):
            count(name, f"unique {', '.join(columns)}", df.groupBy(*columns).count().where("count > 1"))
        for table, column in sorted(REQUIRED):
            if table == name:
                count(name, f"required {column}", df.where(F.col(column).isNull()))
        for (table, column), target in FOREIGN.items():
            if table == name and target in tables:
                refs = df.where(F.col(column).isNotNull()).select(F.col(column).alias("id"))
                count(name, f"{column} in {target}", refs.join(tables[target].select("id"), "id", "left_anti"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.where("rows > 0")
