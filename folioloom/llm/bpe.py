"""Operator 6: exact BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is one token that its encoding ends with. It is
found among the tokens that are suffixes of the prefix (which an automaton with
suffix links reports while it reads the word) as the one that may stand after the
last token of the shorter prefix before it. Two tokens may stand together when
merging their bytes gives them again, which is decided by undoing their merges
from the boundary outwards. Back-pointers then give the ids, last token first.

Numpy reads many words together, a byte of each at a time; words beyond
LONG_WORD bytes are read alone. Each word of a run of texts is encoded once, and
remembered.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .cluster import table, with_text
from .textarrays import U64, pieces, release, text_buffer

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids string, decoded string"
#: Words whose encoding a Python worker remembers before a newer generation begins; the one before it is kept.
REMEMBERED = 150_000
#: Bytes of a word that is not read alone, words that are read together, and bytes of text whose words are looked up together.
LONG_WORD = 64
BLOCK_WORDS = 1 << 15
TEXT_BYTES = 1 << 20
#: White space of Unicode, and the same without the space itself.
SPACE = "[\t-\r \x85\xa0  -     　]"
ODD_SPACE = SPACE.replace(" ", "", 1)
END = "\n"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class _Lookup:
    """Numbers by key, neither negative, in open addressing; keys are distinct."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = (4 * len(keys)).bit_length()
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot, live = spread(keys, self.shift), np.arange(len(keys))
        while len(live):
            at = slot[live]
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[live[free]]
            here = self.keys[at] == keys[live]
            self.values[at[here]] = values[live[here]]
            live = live[~here]
            slot[live] = slot[live] + 1 & self.mask

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        slot = spread(keys, self.shift)
        held = self.keys[slot]
        same = held == keys
        out = np.where(same, self.values[slot], -1)
        live = np.flatnonzero(~same & (held >= 0))
        while len(live):
            slot[live] = at = slot[live] + 1 & self.mask
            held = self.keys[at]
            same = held == keys[live]
            out[live[same]] = self.values[at[same]]
            live = live[~same & (held >= 0)]
        return out


def spread(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
    return (keys.astype(U64) * U64(0x9E3779B97F4A7C15) >> shift).astype(np.int64)


class _Prefixes:
    """Last tokens of the prefixes of many words at a time.

    `tokens` has the bytes of each token that merges make, whether it ends a word,
    and its rank; `parts` the ranks that a rank is merged from, `joined` the rank
    that a pair is merged to, and ranks below `base` are letters.
    """

    #: Symbols of the automaton: bytes, and the end of a word.
    SYMBOLS = 257

    def __init__(self, tokens: list[tuple[bytes, bool, int]], parts: list[tuple[int, int]], joined: dict[tuple[int, int], int], base: int):
        self.parts, self.base, self.ranks = np.array(parts, np.int64).reshape(-1, 2), base, len(parts)
        pairs = np.array(list(joined), np.int64).reshape(-1, 2)
        self.joined = _Lookup(pairs[:, 0] * self.ranks + pairs[:, 1], np.array(list(joined.values()), np.int64))
        #: Verdicts on pairs, as key * 2 + verdict; a newer one takes the place of an older.
        self.told = np.full(1 << 18, -1, np.int64)
        self._automaton(tokens)

    def _automaton(self, tokens: list[tuple[bytes, bool, int]]) -> None:
        rank = np.array([r for _, _, r in tokens], np.int64)
        length = np.array([len(t) for t, _, _ in tokens], np.int64)
        self.size = np.zeros(self.ranks, np.int64)
        self.size[rank] = length
        depth = length + np.array([whole for _, whole, _ in tokens], np.int64)
        symbols = np.full((int(depth.max()), len(tokens)), self.SYMBOLS - 1, np.int64)
        for i, (text, _, _) in enumerate(tokens):
            symbols[: len(text), i] = np.frombuffer(text, np.uint8)
        # States by depth; the root is 0.
        state, n, levels, live = np.zeros(len(tokens), np.int64), 1, [], np.arange(len(tokens))
        for d in range(len(symbols)):
            live = live[depth[live] > d]
            keys, which = np.unique(state[live] * self.SYMBOLS + symbols[d, live], return_inverse=True)
            state[live] = n + which
            levels.append((keys, np.arange(n, n + len(keys))))
            n += len(keys)
        self.edges = _Lookup(np.concatenate([k for k, _ in levels]), np.concatenate([v for _, v in levels]))
        self.token = np.full(n, -1, np.int64)
        self.token[state] = rank
        # The longest proper suffix that is a state, the longest suffix that is a token, and the longest proper one; 0: none.
        self.link, self.best, self.shorter = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for d, (keys, states) in enumerate(levels):
            if d:
                self.link[states] = self.step(self.link[keys // self.SYMBOLS], keys % self.SYMBOLS)
            self.shorter[states] = self.best[self.link[states]]
            self.best[states] = np.where(self.token[states] >= 0, states, self.shorter[states])

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The state after one more symbol, by suffix links where there is no edge."""
        at = state.copy()
        out = self.edges.of(at * self.SYMBOLS + symbol).astype(np.int64)
        live = np.flatnonzero(out < 0)
        while len(live):
            out[live[at[live] == 0]] = 0
            live = live[at[live] > 0]
            at[live] = up = self.link[at[live]]
            out[live] = self.edges.of(up * self.SYMBOLS + symbol[live])
            live = live[out[live] < 0]
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """`Tokenizer._compatible` for each pair."""
        out, live = np.ones(len(left), bool), np.arange(len(left))
        while len(live):
            across = self.joined.of(left * self.ranks + right)
            bad = (across >= 0) & (across < limit)
            out[live[bad]] = False
            undo = left > right
            on = ~bad & (np.maximum(left, right) >= self.base)
            live, left, right, undo = live[on], left[on], right[on], undo[on]
            limit = np.where(undo, left, right + 1)
            left, right = np.where(undo, self.parts[left, 1], left), np.where(undo, right, self.parts[right, 0])
        return out

    def together(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.ranks + right
        slot = spread(key, U64(64 - 18))
        held = self.told[slot]
        out = held & 1 == 1
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            out[new] = self.compatible(left[new], right[new], np.full(len(new), 1 << 60))
            self.told[slot[new]] = key[new] * 2 + out[new]
        return out

    def of(self, words: list[bytes]) -> list[list[int]]:
        """Ranks of the tokens of each word; no word is empty."""
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        data, size = np.frombuffer(b"".join(words), np.uint8), sizes[order]
        begin, n, most = (np.cumsum(sizes) - sizes)[order], len(words), int(size[0])
        at_least = np.searchsorted(-size, -np.arange(most + 2), "right").tolist()
        last = np.full((most + 1, n), -1, np.int32)
        state = np.zeros(n, np.int64)
        for end in range(1, most + 1):
            a, b = at_least[end], at_least[end + 1]
            state = self.step(state[:a], data[begin[:a] + (end - 1)].astype(np.int64))
            at = self.best[np.append(state[:b], self.step(state[b:], np.full(a - b, self.SYMBOLS - 1)))]
            live = np.flatnonzero(at)
            while len(live):
                token = self.token[at[live]]
                start = end - self.size[token]
                before = last[start, live].astype(np.int64)
                good = start == 0
                ask = np.flatnonzero(before >= 0)
                good[ask] = self.together(before[ask], token[ask])
                last[end, live[good]] = token[good]
                live = live[~good]
                at[live] = self.shorter[at[live]]
                live = live[at[live] > 0]
        steps, left, live = [], size.copy(), np.arange(n)
        while len(live):
            token = last[left[live], live]
            if (token < 0).any():
                raise ValueError(f"no encoding of {words[order[live[token < 0][0]]]!r}")
            steps.append((live, token))
            left[live] -= self.size[token]
            live = live[left[live] > 0]
        counts = np.zeros(n, np.int64)
        for live, _ in steps:
            counts[live] += 1
        ends = np.cumsum(counts)
        flat = np.zeros(int(ends[-1]), np.int64)
        for i, (live, token) in enumerate(steps):
            flat[ends[live] - 1 - i] = token
        ranks, out = flat.tolist(), [[]] * n
        for i, a, b in zip(order.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
            out[i] = ranks[a:b]
        return out


class Tokenizer:
    """A word-level BPE vocabulary file with word ends, lower case and byte letters."""

    def __init__(self, definition: str):
        told = json.loads(definition)
        model = told["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        pattern = next(p["pattern"]["Regex"] for p in told["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(pattern.replace(r"\s", SPACE[1:-1]))
        self.space = regex.compile(f" {SPACE}+|{ODD_SPACE}{SPACE}*")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        # Tokens by rank: those of one letter, then one for each merge.
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        merged = {a + b for a, b in pairs}
        self.ids = [i for t, i in vocab.items() if t not in merged] + [vocab[a + b] for a, b in pairs]
        rank = {self.names[i]: r for r, i in enumerate(self.ids)}
        self.base = base = len(self.ids) - len(pairs)
        self.parts = [(r, r) for r in range(base)]
        self.joined: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(pairs, base):
            self.parts.append((rank[a], rank[b]))
            self.joined.setdefault((rank[a], rank[b]), r)
        self._together: dict[tuple[int, int], bool] = {}
        self.id_texts = [str(i) for i in self.ids]
        self.token_texts = [self.names[i] for i in self.ids]
        made = [True] * base
        for r in range(base, len(self.ids)):
            a, b = self.parts[r]
            made.append(made[a] and made[b] and self._compatible(a, b, r))
        self.made = [(text[: -len(self.suffix)], True, r) if self.suffix and text.endswith(self.suffix) else (text, False, r) for text, r in rank.items() if made[r]]
        byte = {c: b for b, c in enumerate(self.letters)}
        self.prefixes = _Prefixes([(bytes([byte[c] for c in t]), whole, r) for t, whole, r in self.made if t and set(t) <= byte.keys()], self.parts, self.joined, base)
        self.memo: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for text, whole, r in self.made:
            out.add_word(text + END if whole else text, (len(text), r))
        out.make_automaton()
        return out

    def _compatible(self, left: int, right: int, limit: int) -> bool:
        """Whether the merges of `left` and `right` are all done before any merge across their boundary of a rank below `limit`."""
        joined, parts, base = self.joined, self.parts, self.base
        while True:
            across = joined.get((left, right))
            if across is not None and across < limit:
                return False
            # Undo the later merge; of two equal ones, the right one was made later.
            if left > right:
                if left < base:
                    return True
                limit, left = left, parts[left][1]
            else:
                if right < base:
                    return True
                limit, right = right + 1, parts[right][0]

    def together(self, left: int, right: int) -> bool:
        key = (left, right)
        got = self._together.get(key)
        if got is None:
            if len(self._together) > 1_000_000:
                self._together.clear()
            got = self._together[key] = self._compatible(left, right, 1 << 60)
        return got

    def ranks(self, letters: str) -> list[int]:
        """Ranks of the tokens of a word given in byte letters."""
        n = len(letters)
        last, before = [-1] * (n + 1), [0] * (n + 1)
        for at, (size, token) in self.automaton.iter(letters + END):
            end = at + 1 if at < n else n
            if at == n - 1 or last[end] >= 0:
                continue
            start = end - size
            if start == 0 or (last[start] >= 0 and self.together(last[start], token)):
                last[end], before[end] = token, start
        if last[n] < 0:
            raise ValueError(f"no encoding of {letters!r}")
        out, at = [], n
        while at:
            out.append(last[at])
            at = before[at]
        return out[::-1]

    def words(self, words: list[str]) -> list[tuple[str, str]]:
        """Decimal ids joined by spaces, and the decoded text, of each word."""
        raw = [w.encode() for w in words]
        short = [w for w in raw if len(w) <= LONG_WORD and w[0] != ord(END)]
        read = chain.from_iterable(self.prefixes.of(short[a : a + BLOCK_WORDS]) for a in range(0, len(short), BLOCK_WORDS))
        ids, names, out = self.id_texts, self.token_texts, []
        for word, w in zip(words, raw, strict=True):
            if word[0] == END:
                out.append((str(self.special[word[1:]]), word[1:]))
                continue
            ranks = next(read) if len(w) <= LONG_WORD else self.ranks("".join([self.letters[b] for b in w]))
            out.append((" ".join([ids[r] for r in ranks]), " ".join([names[r] for r in ranks])))
        return out

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by spaces, as a vocabulary without a decoder gives them."""
        return " ".join([self.names[i] for i in ids])

    def found(self, text: str) -> list[str]:
        """The words of a text; special tokens among them have a line end before them, which no word has."""
        out: list[str] = []
        for i, piece in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                out.append(END + piece)
                continue
            plain = piece if piece.isascii() else unicodedata.normalize("NFC", piece)
            out += self.word.findall(self.space.sub(" ", plain).replace("Σ", "σ").lower())
        return out

    def _encoded(self, wanted: set[str]) -> dict[str, tuple[str, str]]:
        """Each word with its ids and decoded text; the older generation goes when the newer is full.

        More words than a generation holds, those of a very long text, are not remembered.
        """
        out = {w: self.memo.get(w) or self.old.get(w) for w in wanted}
        new = [w for w, got in out.items() if got is None]
        out |= zip(new, self.words(new), strict=True)
        if len(out) <= REMEMBERED:
            self.memo |= out
        if len(self.memo) >= REMEMBERED:
            self.old, self.memo = self.memo, {}
        return out

    def all(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Decimal ids joined by spaces, and the decoded text, of each text."""
        rows = [self.found(t) for t in texts]
        told = self._encoded(set().union(*rows))
        for row in rows:
            got = [told[w] for w in row]
            yield " ".join([g[0] for g in got]), " ".join([g[1] for g in got])

    def both(self, text: str) -> tuple[str, str]:
        return next(self.all([text]))

    def encode(self, text: str) -> list[int]:
        ids = self.both(text)[0]
        return [int(i) for i in ids.split(" ")] if ids else []


#: The tokenizer of the partition that a worker is at; it takes half a second to make and is given up at the end.
_built: dict[str, Tokenizer] = {}


def tokenizer(definition: str) -> Tokenizer:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _built:
        _built[key] = Tokenizer(definition)
    return _built[key]


def _kernel(definition, full: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(definition.value)
        for batch in batches:
            for a, b in pieces(text_buffer(batch.column("text"))[1], TEXT_BYTES):
                part = batch.slice(a, b - a)
                counts, ids, decoded, sha_i, sha_d = [], [], [], [], []
                for i, d in t.all([text or "" for text in part.column("text").to_pylist()]):
                    counts.append(i.count(" ") + 1 if i else 0)
                    sha_i.append(hashlib.sha256(i.encode()).hexdigest())
                    sha_d.append(hashlib.sha256(d.encode()).hexdigest())
                    ids.append(i if full else None)
                    decoded.append(d if full else None)
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), *(pa.array(x, pa.string()) for x in (sha_i, sha_d, ids, decoded))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])
        _built.clear()
        del t
        release()

    return kernel


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_encode(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", full: bool = True) -> DataFrame:
    """Ids of each text under the vocabulary file at `path`, and the text that they decode to.

    Gives doc_id, n_tokens, ids_sha256, decoded_sha256 and, unless `full` is
    false, ids (decimal, joined by spaces) and decoded. A null or empty text, or
    one of white space, has no ids and decodes to the empty string. Rows are
    independent: repeated rows and keys give repeated results. An empty table
    gives an empty table. Other columns are ignored. The file (a fixed
    vocabulary, a few megabytes) is broadcast to the executors.
    """
    rows = with_text(docs, text, key)
    definition = docs.sparkSession.sparkContext.broadcast(Path(path or vocabulary_path()).read_text(encoding="utf-8"))
    return rows.mapInArrow(_kernel(definition, full), SCHEMA)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), full=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
