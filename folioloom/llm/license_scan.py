"""Operator 8: license scans. One Aho-Corasick pass finds notice phrases and tags; tagged expressions are parsed by shunting yard."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .cluster import table, with_text
from .textarrays import ALNUM, LOWER, Words, expand, pieces, text_buffer

SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, expressions array<string>, permissive boolean"

#: Fixed by the contract of the query.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: The method's own notice phrases.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
#: What an expression may follow, in words.
TAGS = ("spdx license identifier", "licensed under", "released under", "license expression")
#: Beginnings of identifiers in expressions, longest first, and their labels.
IDENTIFIERS = {"apache": "apache", "mit": "mit", "lgpl": "lgpl", "agpl": "agpl", "gpl": "gpl", "mpl": "mpl", "epl": "epl", "bsd": "bsd", "isc": "isc", "bsl": "bsl", "cc-by-sa": "cc-by-sa", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "cc-by": "cc-by", "cc0": "cc0", "unlicense": "unlicense"}
#: Labels that ask for attribution at most.
PERMISSIVE = frozenset(["apache", "mit", "bsd", "isc", "bsl", "cc-by", "cc0", "unlicense"])
#: How sure one piece of evidence makes: a contract phrase, a notice phrase, an identifier in an expression.
SURE = {"base": 0.9, "notice": 0.8, "tag": 0.95}

_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+-]*")
#: White space, line breaks with the comment mark of the next line included.
_GAP = re.compile(r"(?:\n[^\S\n]*(?://+|\*+(?!/)|#+|;+|--+|%+)|\s)*")
#: What may stand between a tag and its expression.
_OPEN = re.compile(rf"{_GAP.pattern}:?{_GAP.pattern}(?:the\b(?![.+-]))?")
_RANK = {"or": 1, "and": 2, "with": 3}


class ExpressionError(ValueError):
    pass


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting yard: with binds closest, then and, then or; all associate to the left."""
    out: list[str] = []
    stack: list[str] = []
    operand = True
    for t in tokens:
        if t in _RANK:
            if operand:
                raise ExpressionError(t)
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        elif t == "(":
            if not operand:
                raise ExpressionError(t)
            stack.append(t)
        elif t == ")":
            if operand:
                raise ExpressionError(t)
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ExpressionError(t)
            stack.pop()
        else:
            if not operand:
                raise ExpressionError(t)
            out.append(t)
            operand = False
    if operand:
        raise ExpressionError("end")
    while stack:
        if stack[-1] == "(":
            raise ExpressionError("(")
        out.append(stack.pop())
    return out


def alternatives(postfix: list[str]) -> Iterator[frozenset[str]]:
    """The alternatives that an expression grants, one at a time: sets of identifiers to comply with together. Their number may be exponential."""
    # An operand is a set of identifiers, an "or" or "and" a list of what it joins; chains of one operator are one list.
    stack: list = []
    for t in postfix:
        if t in ("or", "and"):
            b, a = stack.pop(), stack.pop()
            stack.append((t, [*(a[1] if a[0] == t else [a]), *(b[1] if b[0] == t else [b])]))
        elif t == "with":
            (_, b), a = stack.pop(), stack.pop()
            if a[0] != "is" or not isinstance(b, str):
                raise ExpressionError(t)
            stack.append(("is", f"{a[1]} with {b}"))
        else:
            stack.append(("is", t))

    def each(node: tuple) -> Iterator[frozenset[str]]:
        kind, of = node
        if kind == "is":
            yield frozenset([of])
        elif kind == "or":
            for x in of:
                yield from each(x)
        elif len(of) == 1:
            yield from each(of[0])
        else:
            half = len(of) // 2
            for x in each(("and", of[:half])):
                for y in each(("and", of[half:])):
                    yield x | y

    seen = set()
    for x in each(stack[0]):
        if x not in seen:
            seen.add(x)
            yield x


def granted(postfix: list[str], labels: frozenset[str]) -> bool:
    """Whether an expression can be met with licences of these labels alone, in one pass."""
    stack: list[bool] = []
    for t in postfix:
        if t == "or":
            stack[-2:] = [stack[-2] or stack[-1]]
        elif t == "and":
            stack[-2:] = [stack[-2] and stack[-1]]
        elif t == "with":
            stack.pop()
        else:
            stack.append(label_of(t) in labels)
    return stack[0]


def label_of(identifier: str) -> str | None:
    name = identifier.split(" with ")[0]
    return next((label for begin, label in sorted(IDENTIFIERS.items(), key=lambda x: -len(x[0])) if re.fullmatch(re.escape(begin) + r"(?:[-+.0-9].*)?", name)), None)


def expression(text: str, at: int = 0) -> list[str]:
    """Tokens of the longest expression at a place of a (lower-case) text whose identifiers are all known; it may go on over line breaks."""
    tokens: list[str] = []
    best, depth, operand, end = 0, 0, True, at
    while m := _TOKEN.match(text, _GAP.match(text, end).end()):
        t = m[0].rstrip(".") or m[0]
        exception = bool(tokens) and tokens[-1] == "with"
        if t in _RANK:
            if operand:
                break
            operand = True
        elif t == "(":
            if not operand or exception:
                break
            depth += 1
        elif t == ")":
            if operand or not depth:
                break
            depth -= 1
        else:
            if not operand or (not exception and label_of(t) is None):
                break
            operand = False
        tokens.append(t)
        if not operand and not depth:
            best = len(tokens)
        if t != m[0]:
            break
        end = m.start() + len(t)
    return tokens[:best]


def parse(text: str) -> tuple[str, Iterator[frozenset[str]]] | None:
    """The expression at the beginning of a (lower-case) text, and its alternatives."""
    tokens = expression(text)
    return (" ".join(tokens), alternatives(to_postfix(tokens))) if tokens else None


def labels_of(postfix: list[str]) -> set[str]:
    """Labels of the operands; an exception, which comes just before its with, has none."""
    after = [*postfix[1:], ""]
    return {label_of(t) for t, then in zip(postfix, after, strict=True) if t not in _RANK and then != "with"} - {None}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    kinds: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
        for p, label in phrases.items():
            kinds.setdefault(p, []).append((kind, label))
    for p, found in kinds.items():
        a.add_word(f" {p} ", (len(p) + 2, found))
    a.make_automaton()
    return a


def spaced(data: np.ndarray, words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Each document as its words with a space before each; the offsets of documents, and of words in all."""
    size = words.end - words.start + 1
    padded = np.append(data, np.uint8(32))
    body = padded[expand(words.start - 1, size)] if len(size) else padded[:0]
    begin = np.cumsum(size) - size
    body[begin] = 32
    at = np.append(0, np.cumsum(size))[words.first]
    return body.tobytes(), at, begin


def scan(lower: bytes, ends: np.ndarray, body: str, begin: np.ndarray, automaton: ahocorasick.Automaton) -> tuple:
    """(starts of contract phrases, their labels, all labels, score, expressions, whether permissive licences meet them) of one document.

    body has its words, a byte for a character, at the places `begin`; they end at `ends` in the text.
    """
    places, base, labels, doubt, tagged = [], set(), set(), 1.0, []
    seen = set()
    for end, (size, found) in automaton.iter(body):
        for kind, label in found:
            if kind == "tag":
                tagged.append(end)
                continue
            if kind == "base":
                places.append(end - size + 1)
                base.add(label)
            labels.add(label)
            if (kind, label) not in seen:
                seen.add((kind, label))
                doubt *= 1 - SURE[kind]
    starts = np.searchsorted(begin, places).tolist()
    tags = ends[np.searchsorted(begin, tagged) - 1].tolist() if tagged else []
    permissive = None
    expressions = []
    if tags:
        text, at, byte = lower.decode(), 0, 0
        for tag in tags:
            at, byte = at + len(lower[byte:tag].decode()), tag
            tokens = expression(text, _OPEN.match(text, at).end())
            if tokens:
                expressions.append(" ".join(tokens))
                postfix = to_postfix(tokens)
                permissive = granted(postfix, PERMISSIVE) and permissive is not False
                new = labels_of(postfix)
                for label in sorted(new):
                    if ("tag", label) not in seen:
                        seen.add(("tag", label))
                        doubt *= 1 - SURE["tag"]
                labels |= new
    return starts, base, labels, 1 - doubt, expressions, permissive


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permissive"]
    for batch in batches:
        data, offs = text_buffer(batch.column("text"))
        counts, rows = [], []
        for a, b in pieces(offs):
            piece, o = LOWER[data[offs[a] : offs[b]]], offs[a : b + 1] - offs[a]
            words = Words(piece, o, ALNUM)
            counts.append(words.counts)
            body, at, begin = spaced(piece, words)
            whole = piece.tobytes()
            for i in range(b - a):
                own = slice(words.first[i], words.first[i + 1])
                mine = (body[at[i] : at[i + 1]] + b" ").decode("latin-1")
                rows.append(scan(whole[o[i] : o[i + 1]], words.end[own] - o[i], mine, begin[own] - at[i], automaton))
        starts = [r[0] for r in rows]
        columns = [
            batch.column("doc_id"),
            pa.array(np.concatenate(counts) if counts else [], pa.int64()),
            pa.array([len(s) for s in starts], pa.int64()),
            pa.array([min(s, default=None) for s in starts], pa.int64()),
            pa.array([max(s, default=None) for s in starts], pa.int64()),
            pa.array([",".join(sorted(r[1])) for r in rows], pa.string()),
            pa.array([",".join(sorted(r[2])) for r in rows], pa.string()),
            pa.array([r[3] for r in rows], pa.float64()),
            pa.array([r[4] for r in rows], pa.list_(pa.string())),
            pa.array([r[5] for r in rows], pa.bool_()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def license_scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Licence evidence of each document: places of the contract's phrases, labels, a score and the expressions parsed.

    Words are runs of letters, digits and bytes beyond ASCII, A-Z lower-cased.
    n_base counts every place of every contract phrase, overlapping ones too;
    first_word and last_word are null where there is none. Label lists are
    distinct, sorted, comma-joined, and empty without a label; the score is then
    0. A null or empty text has no words. Rows are independent, so repeated rows
    and keys give repeated results; an empty table gives an empty table. An
    expression is looked for after every tag, over line breaks too; a malformed
    one adds the part that parses; `permissive` says whether all of them can be met
    with permissive licences, and is null without one. Other columns are ignored.
    """
    return with_text(docs, text, key).mapInArrow(_kernel, SCHEMA)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("expressions", "permissive")
