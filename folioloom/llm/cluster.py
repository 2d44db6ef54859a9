"""What the corpus operators share on the Spark side: inputs, sizes, settled tables and packed exchanges."""

from __future__ import annotations

__all__ = ["by_key", "buckets", "exchanged", "looked_up", "record", "restored", "schema_of", "settled", "shared_folder", "suspected", "table", "text_bytes", "with_text"]

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settling import settled, shared_folder
from ..shipping import ship
from .textarrays import trim

#: Bytes of text that one bucket of a packed exchange is meant to come from.
BUCKET_TEXT = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_text(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: bool = False) -> DataFrame:
    """(doc_id, text) with the names the kernels expect; other columns, clashing names included, stay out of them.

    With `carry`, the other columns come along as one struct, `row`.
    """
    ship(docs.sparkSession)
    columns = [F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")]
    if carry:
        others = [F.col(f"`{c}`") for c in docs.columns if c not in (text, key)]
        columns.append((F.struct(*others) if others else F.struct(F.lit(True).alias("none"))).alias("row"))
    return docs.select(*columns)


def schema_of(ddl: str, rows: DataFrame) -> T.StructType:
    """A kernel's columns, and `row` if it is carried along."""
    schema = T.StructType.fromDDL(ddl)
    return schema.add(rows.schema["row"]) if "row" in rows.columns else schema


def record(batch: pa.RecordBatch, names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    """A kernel's batch of results, with `row` if it is carried along."""
    if "row" in batch.schema.names:
        names, columns = [*names, "row"], [*columns, batch.column("row")]
    return pa.RecordBatch.from_arrays(columns, names=names)


def restored(rows: DataFrame, docs: DataFrame, text: str = "text", key: str = "doc_id", length: str | None = "n_chars") -> DataFrame:
    """Rows of a stage with the columns of `docs` again; `length`, if there is one, follows the text."""
    out = {key: F.col("doc_id"), text: F.col("text")}
    columns = [out[c].alias(c) if c in out else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == length else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return rows.select(*columns)


def text_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0)


def buckets(docs: DataFrame) -> int:
    """Buckets of a packed exchange: one for each BUCKET_TEXT of text, the session's shuffle partitions at least."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), text_bytes(docs) // BUCKET_TEXT + 1)


#: A key is hot with more than one in so many of all rows, so there are fewer hot keys than this.
HOT_KEYS = 1000


def looked_up(rows: DataFrame, told: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """`rows` joined with `told`, which has one row for each key, on keys that are never null.

    What is told of hot keys is broadcast, fewer than HOT_KEYS rows, so that their
    rows stay where they are; the others are joined by an exchange. Both tables
    are read more than once, so they are best settled.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    total = rows.count()
    hot = rows.groupBy(*keys).count().where(F.col("count") * HOT_KEYS > total).where(F.col("count") > 1).select(*keys).collect()
    if not hot:
        return rows.join(told, keys, how)
    few = F.broadcast(rows.sparkSession.createDataFrame(hot, rows.select(*keys).schema))
    warm = rows.join(few, keys, "left_semi").join(F.broadcast(told.join(few, keys, "left_semi")), keys, how)
    return warm.unionByName(rows.join(few, keys, "left_anti").join(told, keys, how))


#: Words (64 bits each) of a table of bits, which is broadcast: a row for each word with a bit.
BIT_WORDS = 1 << 18


def suspected(rows: DataFrame, keys: DataFrame, of: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key of `keys`, rows that have none), told by one bit for each hash of a key, without an exchange of `rows`.

    `of` makes the columns of `keys` from a row, null or not. The rows that may
    have a key are all that do, and some more, which grow in number as the keys
    come near the number of bits; an exact join must follow.
    """
    names = keys.columns
    key = F.xxhash64(*(c.cast(keys.schema[n].dataType) for c, n in zip(of, names, strict=True)))
    hashed = keys.select(F.xxhash64(*names).alias("_h"))
    words = hashed.select(F.pmod("_h", F.lit(BIT_WORDS)).alias("_word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(_h, 58) as int))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    told = F.broadcast(settled(words))
    marked = rows.withColumn("_h", key).withColumn("_word", F.pmod("_h", F.lit(BIT_WORDS))).join(told, "_word", "left")
    hit = F.expr("coalesce(getbit(_bits, cast(shiftrightunsigned(_h, 58) as int)), 0) = 1")
    return marked.where(hit).select(*(F.col(f"`{c}`") for c in rows.columns)), marked.where(~hit).select(*(F.col(f"`{c}`") for c in rows.columns))


def exchanged(df: DataFrame, n: int, key: str = "bucket") -> DataFrame:
    """Rows of a bucket together in one partition, bucket after bucket."""
    return df.repartition(n, key).sortWithinPartitions(key)


def by_key(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal values in `names`, from batches sorted by them; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in names), strict=True))
        a = 0
        for i, key in enumerate(keys):
            if key != last:
                if i > a:
                    held.append(batch.slice(a, i - a))
                if held:
                    yield last, pa.Table.from_batches(held)
                    trim()
                held, last, a = [], key, i
        held.append(batch.slice(a))
    if held:
        yield last, pa.Table.from_batches(held)
