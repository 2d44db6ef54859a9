"""Operator 4: URL filters by rules and, where no rule fits, by a character language-model ratio.

Two variable-order Markov models of characters, one of the URLs that rules allow
and one of those that rules block, are smoothed from order to order (Witten-Bell).
Short contexts are counted in one table that every task holds. Longer ones grow
with the data: every context that ruled URLs bring LEAST times, up to the whole
URL. URLs lie in groups; in each round a group sends its contexts of some more
orders, each once, to buckets by hash, which count them and send back the counts
of those seen often enough. Only positions whose longest context came back go on.
A URL's score is the difference of its log-likelihoods for each character; the
limit below which it is blocked is calibrated on URLs that the models scored have
not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .cluster import by_key, exchanged, settled, table
from .textarrays import U64, Rolling, binaries, mix, pack, text_buffer, unpack

#: Fixed by the contract of the query: verdict, host and path of each rule.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SCHEMA = "page_id bigint, host string, path string, rule string, verdict string, score double"

#: Symbols: 0 begins, 1 ends; then one for every byte.
SYMBOLS = 2 + 256
SYMBOL = np.arange(2, SYMBOLS)
#: Characters of the longest context that every task holds counts of, SYMBOLS ** (ORDER + 1) at most; longer contexts grow.
ORDER = 1
#: Times that ruled URLs bring a longer context at least.
LEAST = 4
#: Orders that the first round grows to; each round after it doubles them.
FIRST_ROUND = 7
#: Bytes of URLs in a group, and those that one bucket of contexts is meant to come from.
GROUP_TEXT = 1 << 20
BINS, SPAN = 4001, 8.0
#: Parts of a model's counts in an exchange.
PARTS = 16
ANSWER = "group int, deep boolean, blob binary"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = None
    for verdict, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def contexts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each position's symbol with the ORDER symbols before it, as one number; the URL of each; and their numbers of positions (end included)."""
    data, offs = text_buffer(column)
    n = np.diff(offs)
    size = n + ORDER + 1
    begin = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), np.int64)
    of = np.repeat(np.arange(len(n)), n)
    flat[np.arange(len(data)) - offs[of] + begin[of] + ORDER] = SYMBOL[data]
    flat[begin + size - 1] = 1
    gram = np.zeros(len(flat), np.int64)
    for back in range(ORDER, -1, -1):
        gram[ORDER:] = gram[ORDER:] * SYMBOLS + flat[ORDER - back : len(flat) - back]
    place = np.arange(len(flat)) - np.repeat(begin, size)
    keep = place >= ORDER
    return gram[keep], np.repeat(np.arange(len(n)), size)[keep], n + 1


def _count_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by (fold, class), sparse, in PARTS."""
    total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        gram, of, _ = contexts(batch.column("url"))
        for k in range(4):
            g, c = np.unique(gram[kind[of] == k], return_counts=True)
            if k in total:
                g, at = np.unique(np.concatenate([total[k][0], g]), return_inverse=True)
                c = np.bincount(at, np.concatenate([total[k][1], c])).astype(np.int64)
            total[k] = g, c
    keys, blobs = [], []
    for k, (g, c) in total.items():
        for p in range(PARTS):
            mine = g % PARTS == p
            if mine.any():
                keys.append(k * PARTS + p)
                blobs.append(pack(g[mine], c[mine]))
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), binaries(blobs)], names=["bucket", "blob"])


def _sum_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (bucket,), rows in by_key(batches, ["bucket"]):
        g, c = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for blob in rows.column("blob").to_pylist():
            g2, c2 = unpack(blob)
            g, at = np.unique(np.concatenate([g, g2]), return_inverse=True)
            c = np.bincount(at, np.concatenate([c, c2])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), binaries([pack(g, c)])], names=["bucket", "blob"])


class Markov:
    """Witten-Bell interpolation from order ORDER down to a uniform choice; orders without counts drop out by themselves."""

    def __init__(self, gram: np.ndarray, count: np.ndarray):
        self.tables = []
        for order in range(ORDER + 1):
            g, at = np.unique(gram % SYMBOLS ** (order + 1), return_inverse=True)
            c = np.bincount(at, count, len(g)).astype(np.float64)
            context, at = np.unique(g // SYMBOLS, return_inverse=True)
            self.tables.append((g, c, context, np.bincount(at, c, len(context)), np.bincount(at, minlength=len(context)).astype(np.float64)))

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)

    def log_p(self, gram: np.ndarray) -> np.ndarray:
        p = np.full(len(gram), 1.0 / SYMBOLS)
        for order, (g, c, context, total, kinds) in enumerate(self.tables):
            mine = gram % SYMBOLS ** (order + 1)
            n, t = self._find(context, total, mine // SYMBOLS), self._find(context, kinds, mine // SYMBOLS)
            seen = n > 0
            p = np.where(seen, (self._find(g, c, mine) + t * p) / np.where(seen, n + t, 1), p)
        return np.log(p)


class Group:
    """The distinct URLs of a group as symbols, with a place for each symbol to foretell."""

    def __init__(self, rows: pa.Table):
        found = rows.column("url").combine_chunks().fill_null("").dictionary_encode()
        found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
        self.urls, self.row = found.dictionary, found.indices.to_numpy(zero_copy_only=False)
        kind = rows.column("kind").to_numpy()
        told = kind >= 0
        #: Rows of each URL by (fold, class).
        self.weight = np.bincount(self.row[told] * 4 + kind[told], minlength=4 * len(self.urls)).reshape(-1, 4)
        data, offs = text_buffer(self.urls)
        n = np.diff(offs)
        size = n + 2
        begin = np.cumsum(size) - size
        self.flat = np.zeros(int(size.sum()), np.int64)
        self.flat[np.arange(len(data)) + np.repeat(begin - offs[:-1] + 1, n)] = SYMBOL[data]
        self.flat[begin + size - 1] = 1
        self.of = np.repeat(np.arange(len(n)), n + 1)
        self.at = np.arange(len(self.of)) + self.of + 1
        #: Symbols before each place, the beginning included: the longest context.
        self.before = self.at - begin[self.of]
        self.sizes = n + 1
        self.rolling = Rolling(mix(np.arange(1, SYMBOLS + 1, dtype=U64))[self.flat] | U64(1))

    def context(self, x: np.ndarray, order: int) -> np.ndarray:
        return mix(self.rolling.of(self.at[x] - order, self.at[x]) + U64(order))

    def symbol(self, x: np.ndarray) -> np.ndarray:
        return self.flat[self.at[x]]


def gram_key(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return mix(context + (symbol.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of `wanted` are among the sorted keys, and where."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def _grow_kernel(low: int, high: int, n: int):
    """The contexts of orders low to high of a group, by bucket: each with its next symbol once, and how many ruled rows bring it."""

    def kernel(rows: pa.Table, answers: pa.Table) -> pa.Table:
        g = Group(rows)
        x = np.arange(len(g.at))
        if low > ORDER + 1:
            last = [a[0] for a in (unpack(b) for b in answers.column("blob").to_pylist())]
            keys = np.sort(np.concatenate(last)) if last else np.zeros(0, U64)
            x = x[g.before >= low - 1]
            x = x[_places(keys, gram_key(g.context(x, low - 1), g.symbol(x)))[0]]
        parts = []
        for order in range(low, high + 1):
            x = x[g.before[x] >= order]
            if not len(x):
                break
            context, symbol = g.context(x, order), g.symbol(x)
            by = np.lexsort((symbol, context))
            context, symbol = context[by], symbol[by]
            new = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (symbol[1:] != symbol[:-1])))
            count = np.add.reduceat(g.weight[g.of[x[by]]], new, axis=0)
            parts.append((context[new], symbol[new], np.full(len(new), order), count))
        buckets, blobs = [], []
        if parts:
            context, symbol, order, count = (np.concatenate(c) for c in zip(*parts, strict=True))
            bucket = (context >> U64(40)) % U64(n)
            by = np.argsort(bucket, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(bucket[by])) + 1).tolist(), len(by)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                b = by[i:j]
                buckets.append(int(bucket[b[0]]))
                blobs.append(pack(context[b], symbol[b].astype(np.uint16), order[b].astype(np.uint32), count[b].ravel()))
        group = rows.column("group")[0].as_py() if len(rows) else 0
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "group": pa.array([group] * len(blobs), pa.int32()), "blob": binaries(blobs)})

    return kernel


def _answer_kernel(high: int):
    """For each group the counts of its contexts that are seen LEAST times: symbol, context and kinds of symbol, by fold and class."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, ["bucket"]):
            groups = rows.column("group").to_pylist()
            parts = [unpack(b) for b in rows.column("blob").to_pylist()]
            asked = np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts])
            context, symbol, order, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            count = count.reshape(-1, 4)
            distinct, at = np.unique(context, return_inverse=True)
            total = _sums(at, count, len(distinct))
            keep = total.sum(1)[at] >= LEAST
            context, symbol, order, count, at, asked = (x[keep] for x in (context, symbol.astype(np.int64), order, count, at, asked))
            gram, of = np.unique(at * SYMBOLS + symbol, return_inverse=True)
            seen = _sums(of, count, len(gram))
            kinds = _sums(gram // SYMBOLS, (_folds(seen) > 0).astype(np.int64), len(distinct))
            cuts = np.searchsorted(asked, np.arange(len(parts) + 1))
            out = []
            for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if j > i:
                    blob = pack(gram_key(context[i:j], symbol[i:j]), seen[of[i:j]].ravel(), total[at[i:j]].ravel(), kinds[at[i:j]].ravel())
                    out.append((groups[k], bool((order[i:j] == high).any()), blob))
            columns = [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.bool_()), binaries([x[2] for x in out])]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "deep", "blob"])

    return kernel


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, values[:, k], n).astype(np.int64) for k in range(values.shape[1])], axis=1)


def _folds(counts: np.ndarray) -> np.ndarray:
    """Counts of the four models of a fold and class, and of the two of both folds."""
    return np.concatenate([counts, counts[:, :2] + counts[:, 2:]], axis=1)


def _score_kernel(base):
    """Each row of a group with its score under the models of both folds, and, where a rule told its class, the bin of its score under the other fold's."""

    def kernel(rows: pa.Table, answers: pa.Table) -> pa.Table:
        g = Group(rows)
        gram, _, _ = contexts(g.urls)
        distinct, at = np.unique(gram, return_inverse=True)
        p = np.stack([np.exp(Markov(*x).log_p(distinct)) for x in base.value], axis=1)[at]
        parts = [unpack(b) for b in answers.column("blob").to_pylist()]
        if parts:
            keys, seen, total, kinds = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.argsort(keys)
            keys, seen, total, kinds = keys[by], seen.reshape(-1, 4)[by], total.reshape(-1, 4)[by], kinds.reshape(-1, 6)[by]
            x, order = np.arange(len(g.at)), ORDER + 1
            while len(x):
                x = x[g.before[x] >= order]
                found, where = _places(keys, gram_key(g.context(x, order), g.symbol(x)))
                x, where = x[found], where[found]
                c, n, t = _folds(seen[where]), _folds(total[where]), kinds[where]
                p[x] = np.where(n > 0, (c + t * p[x]) / np.maximum(n + t, 1), p[x])
                order += 1
        logs = np.log(p)
        score = [np.bincount(g.of, logs[:, a] - logs[:, a + 1], len(g.sizes)) / g.sizes for a in (0, 2, 4)]
        kind = rows.column("kind").to_numpy()
        other = np.where(kind // 2 == 0, score[1][g.row], score[0][g.row])
        bins = np.clip(((other + SPAN) * (BINS - 1) / (2 * SPAN)).round(), 0, BINS - 1).astype(np.int32)
        out = {c: rows.column(c) for c in ("page_id", "host", "path", "rule", "told")}
        return pa.table(out | {"score": pa.array(score[2][g.row]), "kind": rows.column("kind"), "b": pa.array(bins, pa.int32())})

    return kernel


def limit(bins: np.ndarray) -> float:
    """The score below which to block, so that the mean of the two classes' shares judged right is largest; 0 where a class is missing."""
    if not bins[0].sum() or not bins[1].sum():
        return 0.0
    blocked = np.append(0, np.cumsum(bins, axis=1)[1] / bins[1].sum())
    allowed = 1 - np.append(0, np.cumsum(bins, axis=1)[0] / bins[0].sum())
    best = np.flatnonzero(np.isclose(blocked + allowed, (blocked + allowed).max()))
    return float((best[0] + best[-1]) / 2 - 0.5) * (2 * SPAN) / (BINS - 1) - SPAN


def _together(rows: DataFrame, answers: DataFrame, kernel, schema: str) -> DataFrame:
    return rows.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(kernel, schema)


def url_filter(pages: DataFrame, url: str = "url", key: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each page.

    The longest fitting rule decides; without one, the language models do: block
    below the calibrated limit. A null URL, or one without ://, has an empty host
    and path, fits no rule and is judged as its text (null: the empty text). With
    no ruled URLs of one class the limit is 0. Repeated rows are judged each by
    itself and counted each. An empty table gives an empty table. Other columns
    are ignored.
    """
    ship(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", ruled(F.col("host"), F.col("path"))).select("page_id", "url", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("told"))
    # Equal URLs are in one fold, as contexts may be whole URLs.
    fold = F.pmod(F.xxhash64("url"), F.lit(2))
    kind = F.when(F.col("told").isNull(), -1).otherwise(fold * 2 + F.when(F.col("told") == "block", 1).otherwise(0)).cast("int")
    size = rows.agg(F.sum(F.octet_length("url"))).head()[0] or 0
    n = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size // GROUP_TEXT) + 1)
    group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    rows = settled(rows.select("*", kind.alias("kind"), group.alias("group")))
    known = rows.where("kind >= 0").select("url", "kind")
    summed = exchanged(known.mapInArrow(_count_kernel, "bucket int, blob binary"), PARTS).mapInArrow(_sum_kernel, "bucket int, blob binary").collect()
    by_kind: list[list] = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] for _ in range(4)]
    for bucket, blob in sorted(summed, key=lambda r: r[0]):
        by_kind[bucket // PARTS].append(tuple(unpack(blob)))
    counts = [tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for parts in by_kind]
    counts += [tuple(np.concatenate([counts[k][i], counts[k + 2][i]]) for i in (0, 1)) for k in (0, 1)]
    answers = every = pages.sparkSession.createDataFrame([], ANSWER)
    low, high, deep = ORDER + 1, FIRST_ROUND, True
    while deep:
        asked = _together(rows.select("url", "kind", "group"), answers, _grow_kernel(low, high, n), "bucket int, group int, blob binary")
        answers = settled(exchanged(asked, n).mapInArrow(_answer_kernel(high), ANSWER))
        every = every.unionByName(answers)
        deep = not answers.where("deep").isEmpty()
        low, high = high + 1, 2 * high + 1
    base = pages.sparkSession.sparkContext.broadcast(counts)
    scored = settled(_together(rows, every, _score_kernel(base), "page_id bigint, host string, path string, rule string, told string, score double, kind int, b int"))
    bins = np.zeros((2, BINS), np.int64)
    for k, b, m in scored.where("kind >= 0").groupBy(F.col("kind") % 2, "b").count().collect():
        bins[k, b] = m
    judged = F.when(F.col("score") < limit(bins), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("told", judged).alias("verdict"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))
