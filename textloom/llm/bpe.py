"""Byte-level BPE encoding and decoding with the vocabulary of a public tokenizer.

A text is cut into pieces (a letter, digit or symbol run with the space before it, an English
clitic, white space); each piece is merged by its own: the symbols form a doubly linked list,
a priority queue holds the adjacent pairs that have a merge rank, and the pair of least rank,
leftmost first, is merged until the queue is empty. Entries that a merge made stale are skipped
when they come up. Cutting is done in numpy over whole batches, and each distinct piece is merged once.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udf

from . import kernels as K
from .common import dealt_table, list_array, ranges

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SCHEMA = "tokens array<int>, n_tokens int, round_trip boolean"
#: Pieces whose tokens a worker remembers.
REMEMBERED = 600_000
_LETTER, _DIGIT, _SPACE, _OTHER = 0, 1, 2, 3


class Vocabulary:
    """Ranks from lines of base64 token and rank; the rank is the id, and the order in which pairs merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        strings = [b""] * size
        for s, i in self.ranks.items():
            strings[i] = s
        self.at = np.zeros(size + 1, np.int64)
        np.cumsum([len(s) for s in strings], out=self.at[1:])
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"{path} has no token for the bytes {missing}")
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        #: left * 2**24 + right -> the token of both, for every two tokens whose strings make up a token
        self.pairs: dict[int, int] = {}
        for s, i in self.ranks.items():
            for k in range(1, len(s)):
                if (x := self.ranks.get(s[:k])) is not None and (y := self.ranks.get(s[k:])) is not None:
                    self.pairs[x << 24 | y] = i
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Tokens of one piece."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, single, pair = len(piece), self.single, self.pairs.get
        symbol = [single[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # an entry is the rank and, in its low bits, the place of the left symbol
        shift = max(12, n.bit_length())
        low = (1 << shift) - 1
        queue = []
        left = symbol[0]
        for i in range(1, n):
            right = symbol[i]
            if (r := pair(left << 24 | right)) is not None:
                queue.append(r << shift | i - 1)
            left = right
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i, rank = entry & low, entry >> shift
            left = symbol[i]
            if left < 0 or (j := after[i]) >= n or pair(left << 24 | symbol[j]) != rank:
                continue  # stale: one of the two has been merged since
            symbol[i], symbol[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := pair(rank << 24 | symbol[k])) is not None:
                    push(queue, r << shift | i)
            h = before[i]
            if h >= 0 and (r := pair(symbol[h] << 24 | rank)) is not None:
                push(queue, r << shift | h)
        return [s for s in symbol if s >= 0]

    def tokens(self, piece: str) -> bytes:
        """Tokens of one piece as 32-bit integers in a row."""
        out = self.known.get(piece)
        if out is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            out = array("i", self.merge(piece.encode())).tobytes()
            if len(piece) <= 64:
                self.known[piece] = out
        return out


@functools.lru_cache(maxsize=4)
def _loaded(path: str, changed: float) -> Vocabulary:
    return Vocabulary(path)


def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    return _loaded(path, os.path.getmtime(path))


def _kinds_of(chars: str) -> np.ndarray:
    out = np.full(len(chars), _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_DIGIT, r"\p{N}"), (_SPACE, r"\s")):
        out[[m.start() for m in regex.finditer(pattern, chars)]] = kind
    return out


@functools.cache
def _plane() -> np.ndarray:
    return _kinds_of("".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x10000))))


def _kinds(cp: np.ndarray) -> np.ndarray:
    out = _plane()[np.minimum(cp, 0xFFFF)]
    if len(cp) and cp.max() > 0xFFFF:
        far = np.flatnonzero(cp > 0xFFFF)
        kinds, inverse = np.unique(cp[far], return_inverse=True)
        out[far] = _kinds_of("".join(map(chr, kinds.tolist())))[inverse]
    return out


def piece_starts(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where each piece starts; a text's pieces are its own."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kinds(cp)
    head = np.zeros(n + 1, bool)
    head[at] = True  # a text's start, and the end of all
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last of a run of white space before something else is a piece of its own, or goes with what follows if it is a plain space
    space = kind == _SPACE
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~head[1:n]
    start |= last
    joined = last & (cp == 32)
    start[1:] &= ~joined[:-1]
    # a clitic: an apostrophe alone, not after a plain space, with s, t, m, d, re, ve or ll behind it
    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        c = [np.where((quote + k < n) & ~np.logical_or.reduce([head[np.minimum(quote + j, n)] for j in range(1, k + 1)]), cp[np.minimum(quote + k, n - 1)], 0) for k in (1, 2)]
        one = np.isin(c[0], [ord(x) for x in "stmd"])
        two = (np.isin(c[0], [ord("r"), ord("v")]) & (c[1] == ord("e"))) | ((c[0] == ord("l")) & (c[1] == ord("l")))
        for q, size in zip(quote[one | two], np.where(one, 2, 3)[one | two], strict=True):
            start[q + 1 : q + size] = False
            # what is left of the letters starts a piece, if any is left
            if q + size < n and not head[q + size] and kind[q + size] == _LETTER:
                start[q + size] = True
    return np.flatnonzero(start)


def encode(texts: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(all token ids, offsets by text)."""
    every, counts = [], []
    for a, b in K.slices(texts):
        part = pc.fill_null(texts.slice(a, b - a), "")
        cp, at = K.code_points(part)
        s = piece_starts(cp, at)
        if not len(s):
            counts.append(np.zeros(b - a, np.int64))
            continue
        e = np.append(s[1:], len(cp))
        h = K.span_hash(K.prefix(K.values(cp, fold=False)), s, e)
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        text = cp.tobytes().decode("utf-32-le")
        pieces = [vocab.tokens(text[x:y]) for x, y in zip(s[first].tolist(), e[first].tolist(), strict=True)]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        flat = np.frombuffer(b"".join(pieces), np.int32)
        each = sizes[inverse]
        every.append(flat[np.repeat((np.cumsum(sizes) - sizes)[inverse], each) + ranges(each)])
        done = np.concatenate([[0], np.cumsum(each)])
        counts.append(np.diff(done[np.searchsorted(s, at)]))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else np.zeros(0, np.int64))])
    return (np.concatenate(every) if every else np.zeros(0, np.int32)), offsets


def decode_bytes(tokens: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets by text): the vocabulary's strings one after another."""
    size = np.diff(vocab.at)[tokens]
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(ends[-1], np.uint8)
    for a in range(0, len(tokens), 1 << 20):
        part = size[a : a + (1 << 20)]
        out[ends[a] : ends[min(a + (1 << 20), len(tokens))]] = vocab.bytes[np.repeat(vocab.at[tokens[a : a + (1 << 20)]], part) + ranges(part)]
    return out, ends[offsets]


def encoded(texts: pa.Array, vocab: Vocabulary) -> pa.StructArray:
    tokens, offsets = encode(texts, vocab)
    raw, at = decode_bytes(tokens, offsets, vocab)
    given = pc.fill_null(texts, "").cast(pa.binary())
    back = raw.tobytes()
    same = [back[x:y] == g.as_py() for x, y, g in zip(at[:-1].tolist(), at[1:].tolist(), given, strict=True)]
    return pa.StructArray.from_arrays([list_array(pa.array(tokens), offsets), pa.array(np.diff(offsets), pa.int32()), pa.array(same, pa.bool_())], ["tokens", "n_tokens", "round_trip"])


def encode_text(docs: DataFrame, path: str = VOCABULARY, text: str = "text"):
    """Column expression over docs: struct tokens, n_tokens, round_trip.

    round_trip says whether decoding gives the very bytes back. Null and empty texts have no tokens.
    Special tokens' strings are ordinary text. The vocabulary is read from path on every worker."""

    @arrow_udf(SCHEMA)
    def f(t: pa.Array) -> pa.Array:
        return encoded(t, vocabulary(path))

    return f.asNondeterministic()(docs[text])


def decode_tokens(df: DataFrame, path: str = VOCABULARY, tokens: str = "tokens"):
    """Column expression over df: the text of each row's tokens; null for null. Bytes that aren't UTF-8 become replacement characters; ids outside the vocabulary are an error."""

    @arrow_udf("string")
    def f(t: pa.Array) -> pa.Array:
        vocab = vocabulary(path)
        given = pc.fill_null(t, pa.scalar([], t.type))
        offsets = given.offsets.to_numpy() - given.offsets[0].as_py() if len(given) else np.zeros(1, np.int64)
        raw, at = decode_bytes(given.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets.astype(np.int64), vocab)
        whole = raw.tobytes()
        return pa.array([whole[x:y].decode("utf-8", "replace") if ok else None for x, y, ok in zip(at[:-1].tolist(), at[1:].tolist(), t.is_valid().to_pylist(), strict=True)], pa.string())

    return f(df[tokens])


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they decode to its very text."""
    docs = dealt_table(spark, sf_dir, "documents")
    return docs.select("doc_id", encode_text(docs).alias("v")).select("doc_id", "v.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their tokens: the columns of documents, tokens, n_tokens, round_trip; other columns go."""
    kept = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return kept.withColumn("v", encode_text(kept)).select(*kept.columns, "v.*")
