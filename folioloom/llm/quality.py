"""Operator 7: a byte-level convolutional quality classifier in numpy.

A text's bytes are embedded, learnt filters slide over them, and each filter's
largest response in every chunk of 512 bytes (chunks overlap by half and cover the
whole text) is kept. Means and maxima of these over a document's chunks go through
a small hidden layer to one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import table, with_text
from .textarrays import pieces, release, text_buffer
from .toxicity import labelled, remainder

#: Bytes from one filter position to the next; a filter sees two steps.
STEP = 4
DIMENSIONS, FILTERS, HIDDEN = 6, 32, 16
#: Half a chunk, in bytes.
HALF = 256
#: Labelled documents that the network is trained on, at most, and how often it sees each.
TRAIN_ROWS, EPOCHS, BATCH, RATE = 3000, 10, 32, 0.004
THRESHOLD = 0.3
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


@dataclass
class Network:
    embed: np.ndarray
    near: np.ndarray
    far: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.Generator(np.random.PCG64(seed))
        wide = STEP * DIMENSIONS

        def draw(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        return cls(draw(256, DIMENSIONS, scale=0.5), draw(wide, FILTERS, scale=wide**-0.5), draw(wide, FILTERS, scale=wide**-0.5), np.zeros(FILTERS, np.float32), draw(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5), np.zeros(HIDDEN, np.float32), draw(HIDDEN, scale=HIDDEN**-0.5), np.zeros(1, np.float32))


def padded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents end to end, each with zeros up to half chunks (one step of them at least); first half chunk of each, and their number."""
    n = np.diff(offs)
    halves = (n + STEP + HALF - 1) // HALF
    first = np.append(0, np.cumsum(halves))
    out = np.zeros(int(first[-1]) * HALF + STEP, np.uint8)
    of = np.repeat(np.arange(len(n)), n)
    out[np.arange(len(data)) - offs[of] + first[of] * HALF] = data
    return out, first


def last_steps(first: np.ndarray) -> np.ndarray:
    return first[1:] * (HALF // STEP) - 1


def half_maxima(net: Network, text: np.ndarray, first: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Largest response of each filter in each half chunk, and the position of it. Behind a document's last step a filter sees zeros, not the next document."""
    x = net.embed[text].reshape(-1, STEP * DIMENSIONS)
    r = x[:-1] @ net.near
    r += x[1:] @ net.far
    last = last_steps(first)
    r[last] = x[last] @ net.near + np.tile(net.embed[0], STEP) @ net.far
    r = r.reshape(-1, HALF // STEP, FILTERS)
    at = r.argmax(1) if where else None
    return r.max(1) + net.bias, at


def pooled(half: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk values (rectified), whether the second half gave each, and the chunk's document."""
    halves = np.diff(first)
    chunks = np.maximum(halves - 1, 1)
    start = np.repeat(first[:-1] - (np.cumsum(chunks) - chunks), chunks) + np.arange(chunks.sum())
    doc = np.repeat(np.arange(len(halves)), chunks)
    second = np.minimum(start + 1, first[1:][doc] - 1)
    a, b = half[start], half[second]
    return np.maximum(np.maximum(a, b), 0), np.where(b > a, second[:, None], start[:, None]), doc


def combine(net: Network, chunk: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    begin = np.searchsorted(doc, np.arange(n))
    size = np.bincount(doc, minlength=n).astype(np.float32)
    mean = np.add.reduceat(chunk, begin, axis=0) / size[:, None]
    top = np.maximum.reduceat(chunk, begin, axis=0)
    v = np.concatenate([mean, top], 1)
    h = np.tanh(v @ net.hidden + net.hidden_bias)
    return v, h, h @ net.out + net.out_bias[0], begin, size


def scores(net: Network, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    if len(offs) < 2:
        return np.zeros(0)
    text, first = padded(data, offs)
    half, _ = half_maxima(net, text, first)
    chunk, _, doc = pooled(half, first)
    z = combine(net, chunk, doc, len(offs) - 1)[2].astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradients(net: Network, data: np.ndarray, offs: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    n = len(y)
    text, first = padded(data, offs)
    half, at = half_maxima(net, text, first, True)
    chunk, source, doc = pooled(half, first)
    v, h, z, begin, size = combine(net, chunk, doc, n)
    dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n).astype(np.float32)
    dh = dz[:, None] * net.out * (1 - h * h)
    dv = dh @ net.hidden.T
    dchunk = (dv[:, :FILTERS] / size[:, None])[doc]
    top = v[:, FILTERS:]
    is_top = chunk == top[doc]
    ties = np.add.reduceat(is_top.astype(np.float32), begin, axis=0)
    dchunk = dchunk + is_top * (dv[:, FILTERS:] / np.maximum(ties, 1))[doc]
    dchunk *= chunk > 0
    # Each chunk value comes from one position of one half chunk.
    c, f = np.nonzero(dchunk)
    g = dchunk[c, f]
    hb = source[c, f]
    place = (hb * (HALF // STEP) + at[hb, f]) * STEP
    seen = text[place[:, None] + np.arange(2 * STEP)]
    seen[np.isin(place // STEP, last_steps(first)), STEP:] = 0
    x = net.embed[seen].reshape(len(c), 2, STEP * DIMENSIONS)
    dnear, dfar = np.zeros_like(net.near), np.zeros_like(net.far)
    dbias = np.bincount(f, g, FILTERS).astype(np.float32)
    dembed = np.zeros_like(net.embed)
    for k in range(FILTERS):
        mine = f == k
        if mine.any():
            dnear[:, k], dfar[:, k] = g[mine] @ x[mine, 0], g[mine] @ x[mine, 1]
    dx = (g[:, None] * np.concatenate([net.near.T, net.far.T], 1)[f]).reshape(-1, DIMENSIONS)
    flat = seen.ravel()
    for d in range(DIMENSIONS):
        dembed[:, d] = np.bincount(flat, dx[:, d], 256)
    return {"embed": dembed, "near": dnear, "far": dfar, "bias": dbias, "hidden": v.T @ dh, "hidden_bias": dh.sum(0), "out": h.T @ dz, "out_bias": dz.sum(keepdims=True)}


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network:
    """Adam over shuffled batches; the same rows in the same order give the same network."""
    net = Network.fresh(seed)
    if not texts or len(set(labels)) < 2:
        base = np.log((sum(labels) + 1) / (len(labels) - sum(labels) + 1))
        net.out[:], net.out_bias[:] = 0, base
        return net
    y = np.array(labels, np.float32)
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    names = list(vars(net))
    first, second = ({k: np.zeros_like(v) for k, v in vars(net).items()} for _ in range(2))
    step = 0
    bodies = [t.encode() for t in texts]
    total = EPOCHS * -(-len(y) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            data = np.frombuffer(b"".join(bodies[i] for i in rows), np.uint8)
            offs = np.append(0, np.cumsum([len(bodies[i]) for i in rows]))
            grads = gradients(net, data, offs, y[rows])
            step += 1
            rate = RATE * min(1, 2 * (1 - step / (total + 1)))
            for k in names:
                first[k] += 0.1 * (grads[k] - first[k])
                second[k] += 0.005 * (grads[k] ** 2 - second[k])
                p = getattr(net, k)
                p -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.995**step)) + 1e-8)
    return net


def _score_kernel(model):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            data, offs = text_buffer(batch.column("text"))
            got = [scores(net, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in pieces(offs)]
            s = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        release()

    return kernel


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", rows_to_learn: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document.

    Labels of rows with crc32(key as text) mod 5 = 0 are never read; of the
    others, `rows_to_learn` at most, chosen by a hash of the key, train the
    network on their whole texts. A null or empty text is one chunk of padding
    and scored like any other. A null key counts as not held out. Repeated rows
    get equal scores. Without labels of both classes every score is the share of
    label 1. An empty table gives an empty table. Other columns are ignored.
    """
    rows = with_text(docs, text, key)
    known, n = labelled(rows, labels, "quality", remainder(F.col("doc_id"), 5) != 0)
    share = min(1.0, rows_to_learn / max(1, n))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * share)).select("doc_id", "text", "y").collect()
    chosen.sort(key=lambda r: (r[0], r[1] or ""))
    net = train([r[1] or "" for r in chosen], [r[2] for r in chosen])
    model = docs.sparkSession.sparkContext.broadcast(net)
    return rows.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))).mapInArrow(_score_kernel(model), SCHEMA)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
