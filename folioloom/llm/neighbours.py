"""Operator 9: approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order. It is posted in the
inverted file of its nearest pivot; a query reads the files of its own nearest
pivots, ranks their vectors by the footrule distance between the orders, and
measures exactly those within a radius. How many files and what radius is
calibrated on a bounded sample, so that its true neighbours are inside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .cluster import by_key, settled, table

PIVOTS, PREFIX = 64, 32
#: Rows that pivots, radius and number of files are fitted on, at most.
SAMPLE = 4000
SAMPLE_QUERIES = 300
#: Share of the sample's true neighbours that the files, and the radius, keep at least.
KEEP = 0.985
#: Vectors of a file that one task takes; a larger file is split.
FILE_ROWS = 20_000
QUERY_ROWS = 256
NEAREST, QUERY_STEP = 10, 100
ROWS = "file int, part int, is_query boolean, vec_id bigint, vector binary, posted binary"
FOUND = "query_id bigint, vec_id bigint, score double"


@dataclass
class Index:
    pivots: np.ndarray
    prefix: int
    files: int
    radius: int

    def orders(self, x: np.ndarray) -> np.ndarray:
        """The nearest pivots of each vector, nearest first (ties to the smaller pivot)."""
        d = (self.pivots**2).sum(1)[None] - 2 * (x @ self.pivots.T)
        return np.argsort(d, axis=1, kind="stable").astype(np.uint8)

    def positions(self, orders: np.ndarray) -> np.ndarray:
        """Place of each pivot in each order; `prefix` beyond the prefix."""
        out = np.full((len(orders), len(self.pivots)), self.prefix, np.int16)
        np.put_along_axis(out, orders[:, : self.prefix].astype(np.int64), np.arange(self.prefix, dtype=np.int16)[None], axis=1)
        return out

    def footrule(self, query: np.ndarray, postings: np.ndarray) -> np.ndarray:
        """Distance of a query's order to each row's, over the query's pivots. postings: a row for each pivot, the vectors' places in it."""
        total = np.zeros(postings.shape[1], np.int32)
        for place, pivot in enumerate(query[: self.prefix].tolist()):
            total += np.abs(postings[pivot] - np.int16(place))
        return total


def fit(x: np.ndarray, seed: int = 5) -> Index:
    """Pivots from the sample, and files and radius that keep the neighbours that its queries have in it."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n = len(x)
    pivots = x[np.sort(rng.choice(n, min(PIVOTS, n), replace=False))]
    index = Index(pivots, min(PREFIX, len(pivots)), len(pivots), 1 << 30)
    if n <= NEAREST + 1:
        return index
    orders = index.orders(x)
    postings = np.ascontiguousarray(index.positions(orders).T)
    files, radii = [], []
    for q in rng.choice(n, min(SAMPLE_QUERIES, n), replace=False).tolist():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        near = np.argsort(d, kind="stable")[:NEAREST]
        place = np.empty(len(pivots), np.int64)
        place[orders[q]] = np.arange(len(pivots))
        files.append(place[orders[near, 0]])
        radii.append(index.footrule(orders[q], postings[:, near]))
    index.files = int(np.quantile(np.concatenate(files), KEEP, method="higher")) + 1
    index.radius = int(np.quantile(np.concatenate(radii), KEEP, method="higher"))
    return index


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("vector")
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(batch.num_rows, -1)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _file_kernel(index):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for batch in batches:
            if batch.num_rows:
                first = ix.orders(_matrix(batch.column("vector"), batch.num_rows))[:, 0]
                f, n = np.unique(first, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(n, pa.int64())], names=["file", "n"])

    return kernel


def _post_kernel(index, parts: np.ndarray, step: int, everything: bool):
    """Each vector in its file, and each query in the files (all parts) that it reads."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"), batch.num_rows)
            ids = batch.column("vec_id").to_numpy()
            orders = ix.orders(x)
            rows = [x[i].tobytes() for i in range(len(x))]
            posted = [orders[i].tobytes() for i in range(len(x))]
            of = list(range(len(x)))
            files = orders[:, 0].astype(np.int64).tolist()
            salt = (ids % parts[orders[:, 0]]).tolist()
            asks = [False] * len(of)
            wanted = batch.column("asks").to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(wanted).tolist():
                for f in orders[i, : len(ix.pivots) if everything else ix.files].tolist():
                    for p in range(int(parts[f])):
                        of.append(i)
                        files.append(f)
                        salt.append(p)
                        asks.append(True)
            columns = [pa.array(files, pa.int32()), pa.array(salt, pa.int32()), pa.array(asks), pa.array(ids[of], pa.int64()), pa.array([rows[i] for i in of], pa.binary()), pa.array([posted[i] for i in of], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "part", "is_query", "vec_id", "vector", "posted"])

    return kernel


def _search_kernel(index, nearest: int, everything: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for _, rows in by_key(batches, ["file", "part"]):
            asks = rows.column("is_query").to_numpy()
            x = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.float64).reshape(len(asks), -1)
            orders = np.frombuffer(b"".join(rows.column("posted").to_pylist()), np.uint8).reshape(len(asks), -1)
            ids = rows.column("vec_id").to_numpy()
            here = np.flatnonzero(~asks)
            here = here[np.argsort(ids[here], kind="stable")]
            data, own = x[here], ids[here]
            postings = np.ascontiguousarray(ix.positions(orders[here]).T)
            out: list[tuple] = []
            for q in np.flatnonzero(asks).tolist():
                near = np.flatnonzero((own != ids[q]) if everything else (own != ids[q]) & (ix.footrule(orders[q], postings) <= ix.radius))
                d = np.sqrt(((data[near] - x[q]) ** 2).sum(1))
                best = np.lexsort((own[near], d))[:nearest]
                out.append((np.full(len(best), ids[q]), own[near][best], d[best]))
            if out:
                q, v, d = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(d)], names=["query_id", "vec_id", "score"])

    return kernel


def nearest_neighbours(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", step: int = QUERY_STEP, nearest: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by `step`, its nearest other rows by Euclidean distance.

    Vectors that are null, zero, of another length than most, or that hold a null
    or a component that is not finite take no part; nor do rows with a null key.
    Repeated rows are one. Rows that share a key with the query are its own. A
    query that the index gives fewer than `nearest` rows is searched exactly, so
    it has all candidates if there are fewer. Ties go to the smaller key. An
    empty table gives an empty table. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null and size(vector) > 0")
    rows = rows.where(~F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("vector", lambda c: c != 0))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not sizes:
        return empty
    dimensions, total = sizes[0]
    rows = rows.where(F.size("vector") == dimensions).dropDuplicates(["vec_id", "vector"])
    share = min(1.0, SAMPLE / total)
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * share)).collect()
    if not sample:
        sample = rows.orderBy("vec_id").limit(SAMPLE).collect()
    sample.sort(key=lambda r: (r[0], r[1]))
    index = spark.sparkContext.broadcast(fit(np.array([r[1] for r in sample], np.float64)))
    sizes_ = dict(rows.mapInArrow(_file_kernel(index), "file int, n bigint").groupBy("file").agg(F.sum("n")).collect())
    parts = np.array([max(1, -(-sizes_.get(f, 0) // FILE_ROWS)) for f in range(len(index.value.pivots))])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(parts.sum()))

    def search(rows: DataFrame, everything: bool) -> DataFrame:
        posted = rows.mapInArrow(_post_kernel(index, parts, step, everything), ROWS)
        return posted.repartition(tasks, "file", "part").sortWithinPartitions("file", "part").mapInArrow(_search_kernel(index, nearest, everything), FOUND)

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")

    asking = rows.withColumn("asks", F.col("vec_id") % step == 0)
    got = settled(ranked(search(asking, False)))
    short = asking.where("asks").select("vec_id").distinct().join(got.groupBy(F.col("query_id").alias("vec_id")).count(), "vec_id", "left").where(F.coalesce("count", F.lit(0)) < nearest).select("vec_id", F.lit(True).alias("short"))
    lacking = [r[0] for r in short.limit(1).collect()]
    if not lacking:
        return got
    again = rows.join(short, "vec_id", "left").select("vec_id", "vector", F.coalesce("short", F.lit(False)).alias("asks"))
    exact = ranked(search(again, True))
    return got.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").unionByName(exact)


def op9_permutation_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
