"""Operator 2: toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer turns words into classes: insult (with a weight learnt from
the labels, by whole word or by stem), threat, target, negation, report,
determiner, other. A cascade of transducers reads the classes of a clause:

* left to right, an insult behind a determiner or another insult is an epithet;
* right to left, a threat with a target among the next words is a menace, and an
  insult or epithet before a target is aimed; a threat without a target is nothing;
* left to right, matches behind a negation are denied, those behind a verb of
  speech quoted, and insults behind a target aimed.

Machines of one direction are composed to one. A document's matches, by kind, give
its score through a logistic curve learnt from the labels; an insult in none of
these patterns is a kind of its own, which counts only as far as the labels say,
and not at all without labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import by_key, exchanged, record, schema_of, table, with_text
from .textarrays import LOWER, U64, Words, binaries, pack, pieces, release, span_hashes, text_buffer, unpack
from .transducers import Transducer, compose

#: Words of the closed classes, in the languages of the corpus.
THREATS = "kill murder hurt destroy burn shoot stab beat attack hang töten umbringen schlagen tuer frapper détruire brûler matar golpear destruir quemar".split()
TARGETS = "you your he she they him her them we it this that du ihr er sie dich euch wir vous tu il elle ils nous toi tú él ella ellos usted ustedes was were is are".split()
NEGATIONS = "not no never none nobody neither nor without nicht kein keine nie niemals ohne pas jamais aucun sans ni nunca jamás sin".split()
REPORTS = "said says say told called calls wrote writes quoted reported claimed sagte sagt nannte schrieb dit disait appelle écrit dijo dice llamó escribió".split()
#: Insults known beforehand, and their weight; the labels add to them.
INSULTS = "idiot idiots moron morons stupid imbecile trash garbage scum loser losers pathetic worthless disgusting clown clowns dumb filth vermin idiota estúpido imbécil basura crétin stupide minable ordure dumm dummkopf abschaum trottel".split()
SEED_WEIGHT = 3.0
DETERMINERS = "the a an these those such what all every some any der die das den dem ein eine einen dieser diese le la les un une des ce cet cette el los las una unos este esta".split()
CLASSES = {"threat": THREATS, "target": TARGETS, "negation": NEGATIONS, "report": REPORTS, "determiner": DETERMINERS}
ALPHABET = ["other", "insult", *CLASSES]
#: Words that a negation reaches, and within which a threat needs its target.
REACH = 3
STEMS = (5, 6, 7, 8, 9, 10)
#: Share of the toxic documents that an insult is in at least; it bounds the lexicon.
SHARE = 0.004
LEAST_ODDS, LEAST_G = 2.0, 16.0
#: Labelled rows that the curve is fitted on, about, unless the caller says otherwise.
CURVE_ROWS = 20_000
#: Rows of the label table up to which it is broadcast; beyond, the join shuffles.
SMALL_LABELS = 500_000
THRESHOLD = 0.7
#: Matches of the grammar, and what negation and reported speech make of them.
MATCHES = ("insult", "epithet", "aimed", "menace")
KINDS = ["aimed", "epithet", "insult", "menace", "denied", "quoted"]
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"

#: Letters: a-z and bytes beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?\n|"]] = True


def epithets() -> Transducer:
    """Left to right: an insult behind a determiner or an insult is an epithet."""
    arcs = {(s, "determiner"): (1, "other", 1.0) for s in (0, 1)}
    return Transducer(0, {**arcs, (0, "insult"): (1, "insult", 1.0), (1, "insult"): (1, "epithet", 1.0)}, {1: 0})


def aims() -> Transducer:
    """Right to left: threats need a target among the REACH words behind them, and a target behind them aims insults and epithets."""
    menace = Transducer(0, {}, {n: max(0, n - 1) for n in range(REACH + 1)})
    for n in range(REACH + 1):
        menace.arcs[(n, "target")] = (REACH, "target", 1.0)
        menace.arcs[(n, "threat")] = (max(0, n - 1), "menace" if n else "other", 1.0)
    return compose(menace, _aimed("target"), ALPHABET + ["epithet", "menace"])


def _aimed(target_out: str) -> Transducer:
    out = Transducer(0, {(s, "target"): (1, target_out, 1.0) for s in (0, 1)})
    for m in ("insult", "epithet"):
        out.arcs[(1, m)] = (1, "aimed", 1.0)
    return out


def grammar() -> Transducer:
    """Left to right: negation, then reported speech, then targets, as one transducer."""
    negation = Transducer(0, {}, {n: max(0, n - 1) for n in range(REACH + 1)})
    for n in range(REACH + 1):
        negation.arcs[(n, "negation")] = (REACH, "other", 1.0)
        if n:
            for m in MATCHES:
                negation.arcs[(n, m)] = (n - 1, "denied", 1.0)
    report = Transducer(0, {(0, "report"): (1, "other", 1.0), (1, "report"): (1, "other", 1.0)})
    for m in (*MATCHES, "denied"):
        report.arcs[(1, m)] = (1, "quoted", 1.0)
    alphabet = [*ALPHABET, "epithet", "aimed", "menace", "denied", "quoted"]
    return compose(compose(negation, report, alphabet), _aimed("other"), alphabet)


class Cascade:
    """The three machines, one after the other over a clause."""

    def __init__(self) -> None:
        self.first, self.back, self.last = epithets(), aims(), grammar()

    def run(self, symbols: list[str]) -> list[str]:
        """What each symbol of a clause comes to."""
        there = [o for o, _ in self.first.run(symbols)]
        back = [o for o, _ in self.back.run(there[::-1])][::-1]
        return [o for o, _ in self.last.run(back)]


def features(data: np.ndarray, words: Words) -> list[np.ndarray]:
    """Hash of each whole word, and of each of its stems; 0 where the word is too short."""
    out = [span_hashes(data, words.start, words.end, 12)]
    size = words.end - words.start
    for p in STEMS:
        h = np.zeros(len(size), U64)
        long = size > p
        h[long] = span_hashes(data, words.start[long], words.start[long] + p, 13)
        out.append(h)
    return out


class Lookup:
    """Values of a few hashes among many: a bit table first, then a search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        by = np.argsort(keys)
        self.keys, self.values = keys[by], values[by]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> U64(44)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of h that are known, and the index of each among the keys."""
        at = np.flatnonzero(self.maybe[(h >> U64(44)).astype(np.int64)])
        if not len(self.keys):
            return at[:0], at[:0]
        i = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        good = self.keys[i] == h[at]
        return at[good], i[good]


def _word_hash(words: list[str]) -> np.ndarray:
    data, offs = text_buffer(pa.array(words, pa.string()))
    return span_hashes(data, offs[:-1], offs[1:], 12)


def doc_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs."""
    data = LOWER[data]
    words = Words(data, offs, LETTERS)
    got = features(data, words)
    doc = np.concatenate([words.doc] * len(got))
    h = np.concatenate(got)
    doc, h = doc[h > 0], h[h > 0]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])) if len(doc) else np.zeros(0, bool)
    return doc[new], h[new]


def _positive_kernel(n_buckets: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffer(batch.column("text"))
            for a, b in pieces(offs, 16 << 20):
                _, h = doc_features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                h, n = np.unique(h, return_counts=True)
                bucket = (h >> U64(30)) % U64(n_buckets)
                parts = [np.flatnonzero(bucket == k) for k in range(n_buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(range(n_buckets), pa.int32()), binaries([pack(h[x], n[x].astype(np.uint32)) for x in parts])], names=["bucket", "blob"])

    return kernel


def _frequent_kernel(least: float):
    """Features in at least so many documents, bucket by bucket."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, ["bucket"]):
            h, n = np.zeros(0, U64), np.zeros(0, np.int64)
            for blob in rows.column("blob").to_pylist():
                h2, n2 = unpack(blob)
                h, at = np.unique(np.concatenate([h, h2]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, n2])).astype(np.int64)
            keep = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64), pa.int64()), pa.array(n[keep], pa.int64())], names=["h", "n"])

    return kernel


def _negative_kernel(keys):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lookup(keys.value, keys.value)
        n = np.zeros(len(known.keys), np.int64)
        for batch in batches:
            data, offs = text_buffer(batch.column("text"))
            for a, b in pieces(offs):
                piece = LOWER[data[offs[a] : offs[b]]]
                words = Words(piece, offs[a : b + 1] - offs[a], LETTERS)
                pairs = [np.zeros(0, np.int64)]
                for h in features(piece, words):
                    at, i = known(h)
                    pairs.append(words.doc[at] * len(known.keys) + i)
                n += np.bincount(np.unique(np.concatenate(pairs)) % max(1, len(known.keys)), minlength=len(n))[: len(n)]
        cuts = np.array_split(n, 16)
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), binaries([pack(c) for c in cuts])], names=["bucket", "blob"])

    return kernel


def _add_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (bucket,), rows in by_key(batches, ["bucket"]):
        total = sum(unpack(b)[0] for b in rows.column("blob").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), binaries([total.tobytes()])], names=["bucket", "blob"])


def clause_matches(data: np.ndarray, offs: np.ndarray, insults: Lookup, closed: Lookup, machine: Cascade) -> np.ndarray:
    """For each document: sums of weights by kind, the largest weight of an insult neither denied nor quoted, and the logarithm of its words."""
    data = LOWER[data]
    words = Words(data, offs, LETTERS)
    out = np.zeros((len(offs) - 1, len(KINDS) + 2))
    out[:, -1] = np.log1p(words.counts)
    if not len(words.start):
        return out
    got = features(data, words)
    weight = np.zeros(len(words.start))
    for h in got:
        at, i = insults(h)
        weight[at] = np.maximum(weight[at], insults.values[i])
    at, i = closed(got[0])
    symbol = np.zeros(len(words.start), np.int8)
    symbol[at] = closed.values[i]
    symbol[weight > 0] = 1
    stops = np.append(0, np.cumsum(_STOP[data]))
    fresh = np.append(True, (stops[words.start[1:]] > stops[words.end[:-1]]) | (words.doc[1:] != words.doc[:-1]))
    clause = np.cumsum(fresh) - 1
    hit = np.unique(clause[(symbol == 1) | (symbol == 2)])
    first = np.append(np.flatnonzero(fresh), len(fresh))
    kind_of = {k: j for j, k in enumerate(KINDS)}
    for a, b in zip(first[hit].tolist(), first[hit + 1].tolist(), strict=True):
        doc = words.doc[a]
        for j, o in zip(range(a, b), machine.run([ALPHABET[x] for x in symbol[a:b].tolist()]), strict=True):
            k = kind_of.get(o)
            if k is not None:
                w = weight[j] or 1.0
                out[doc, k] += w
                if k < 3:
                    out[doc, -2] = max(out[doc, -2], w)
    return out


def design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.log1p(x[:, : len(KINDS)]), x[:, len(KINDS)], x[:, -1] / 10])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    if len(y):
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
            beta += step
            if np.abs(step).max() < 1e-8:
                break
    return beta


def _match_kernel(model, scored: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, beta = model.value
        insults = Lookup(keys, weights)
        names = list(CLASSES)
        closed = Lookup(np.concatenate([_word_hash(CLASSES[c]) for c in names]), np.concatenate([np.full(len(CLASSES[c]), 2 + j, np.int8) for j, c in enumerate(names)]))
        machine = Cascade()
        for batch in batches:
            data, offs = text_buffer(batch.column("text"))
            parts = [clause_matches(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], insults, closed, machine) for a, b in pieces(offs)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(KINDS) + 2))
            if not scored:
                yield pa.RecordBatch.from_arrays([batch.column("y"), binaries([r.tobytes() for r in x])], names=["y", "x"])
                continue
            score = 1 / (1 + np.exp(-np.clip(design(x) @ beta, -30, 30)))
            yield record(batch, ["doc_id", "held_out", "score", "predicted", *(["text"] if "row" in batch.schema.names else [])], [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), *([batch.column("text")] if "row" in batch.schema.names else [])])
        release()

    return kernel


def remainder(key: Column, by: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(by))


def labelled(rows: DataFrame, labels: DataFrame, label: str, usable: Column) -> tuple[DataFrame, int]:
    """(text, doc_id, y) of usable labelled rows and how many labels there are. Of several labels of one id the largest holds. The labels are broadcast only up to SMALL_LABELS rows."""
    told = labels.where(usable & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    n = told.count()
    return rows.join(F.broadcast(told) if n <= SMALL_LABELS else told, "doc_id"), n


def surprise(pos: np.ndarray, positive: int, neg: np.ndarray, negative: int) -> np.ndarray:
    """Log-likelihood ratio statistic of a feature's share among toxic and other documents being the same."""
    total = positive + negative

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.where(seen > 0, seen, 1) / np.maximum(expected, 1e-12))

    share = (pos + neg) / max(1, total)
    return 2 * (part(pos, positive * share) + part(positive - pos, positive * (1 - share)) + part(neg, negative * share) + part(negative - neg, negative * (1 - share)))


def train(rows: DataFrame, labels: DataFrame, rows_to_fit: int = CURVE_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of insults, their weights, and the curve."""
    context = rows.sparkSession.sparkContext
    known, n = labelled(rows, labels, "toxic", remainder(F.col("doc_id"), 3) != 1)
    y = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    positive, negative = y.get(1, 0), y.get(0, 0)
    counted = known.where("y = 1").select("text").mapInArrow(_positive_kernel(16), "bucket int, blob binary")
    frequent = exchanged(counted, 16).mapInArrow(_frequent_kernel(max(3.0, SHARE * positive)), "h bigint, n bigint").orderBy("h").collect()
    keys = np.array([r[0] for r in frequent], np.int64).view(U64)
    pos = np.array([r[1] for r in frequent], np.float64)
    by = np.argsort(keys)
    keys, pos = keys[by], pos[by]
    counted = known.where("y = 0").select("text").mapInArrow(_negative_kernel(context.broadcast(keys)), "bucket int, blob binary")
    parts = dict(exchanged(counted, 16).mapInArrow(_add_kernel, "bucket int, blob binary").collect()) if len(keys) else {}
    neg = np.concatenate([np.frombuffer(parts[k], np.int64) for k in sorted(parts)]) if parts else np.zeros(len(keys))
    odds = np.log((pos + 0.5) / (positive + 1)) - np.log((neg + 0.5) / (negative + 1))
    good = (odds >= LEAST_ODDS) & (surprise(pos, positive, neg, negative) >= LEAST_G)
    keys, weights = keys[good], odds[good]
    seeds = _word_hash(INSULTS)
    fresh = ~np.isin(seeds, keys)
    keys, weights = np.append(keys, seeds[fresh]), np.append(weights, np.full(fresh.sum(), SEED_WEIGHT))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, rows_to_fit / max(1, n)))).select("y", "text")
    model = context.broadcast((keys, weights, None))
    got = chosen.mapInArrow(_match_kernel(model, False), "y int, x binary").collect()
    if not got or len({r[0] for r in got}) < 2:
        # Without labels of both classes: the seed words and a fixed curve, under which a text without matches scores below the threshold.
        return keys, weights, np.array([-3.0, 3.0, 2.0, 0.0, 6.0, -1.0, -1.0, 0.0, 0.0])
    x = np.array([np.frombuffer(r[1]) for r in got]).reshape(len(got), -1)
    order = np.lexsort(x.T)
    return keys, weights, fit_logistic(design(x[order]), np.array([r[0] for r in got], np.float64)[order])


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", carry: bool = False, rows_to_fit: int = CURVE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document; with `carry`, text and the other columns as `row`, too.

    Labels of rows with crc32(key as text) mod 3 = 1 are never read. A null or
    empty text has no clause and gets the score of no match. A null key is
    scored like any other and counts as not held out. Repeated rows get equal
    scores. Conflicting labels of one key count as toxic. Without usable labels of
    both classes, the lexicon is the words known beforehand and the curve a fixed
    one; an empty table gives an empty table. Other columns are ignored. The
    curve is fitted on `rows_to_fit` labelled rows, about; the lexicon on all.
    """
    rows = with_text(docs, text, key, carry)
    model = docs.sparkSession.sparkContext.broadcast(train(rows.select("doc_id", "text"), labels, rows_to_fit))
    return rows.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))).mapInArrow(_match_kernel(model, True), schema_of(SCHEMA + (", text string" if carry else ""), rows))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
