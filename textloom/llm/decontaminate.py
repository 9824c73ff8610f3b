"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of letters and digits, lower-case. The automaton holds every stretch of words of
every item. A document's words are streamed through it, and the longest stretch that ends at each
word is tracked; from each of its states the suffix links lead to the shorter stretches and to the items that hold
only those. A common stretch of a document and an item has `shortest` words or more; an item of fewer words has to be there as a
whole. What is removed are the longest stretches that aren't inside another, if they are long, or if an item in them
is covered enough by the document.

Before that, a table of the items' runs of `shortest` words says where in a document a match of that length can
stand at all; elsewhere the automaton needn't run.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from . import kernels as K
from .common import cut, dealt_table, durable, joined, shipped, table, texts_of

SPAN = "start int, end int, n_words int, coverage float, items array<long>"
FOUND = f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in SPAN.split(', '))}>>"
PIECES = "array<struct<s:int,e:int,start:int,end:int,number:int,item:long,at:int,size:int>>"


@dataclass(frozen=True)
class Limits:
    #: Common stretches of fewer words don't count, but for whole items that have fewer.
    shortest: int = 6
    #: A stretch of so many words is removed,
    length: int = 13
    #: and so is one in which an item stands of which the document covers this share of words or more.
    coverage: float = 0.5
    #: Words of test items in one automaton, which takes some 60 bytes a word. More items than that are looked for in several rounds, an automaton each; the result is the same.
    shard_words: int = 2_000_000


class Piece(NamedTuple):
    """A common stretch of a document and an item that can't be carried on at either end: words [s, e) of the document, from word `at` of the item on."""

    s: int
    e: int
    start: int  # in code points
    end: int
    number: int  # of the item among all items
    item: int | None  # its id
    at: int
    size: int  # words of the item


class Automaton:
    """Suffix automaton of several word sequences; no stretch runs from one into the next.

    Most states have one edge, which stands in two arrays; the edges of the others are sorted by state and word."""

    def __init__(self, items: list[tuple[int, int | None, np.ndarray]], shortest: int):
        """items: numbers, ids and word hashes."""
        self.shortest = shortest
        self.numbers, self.ids = [n for n, _, _ in items], [i for _, i, _ in items]
        self.sizes = [len(h) for _, _, h in items]
        self.vocabulary: dict[int, int] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.word, self.to = array("i", [-1]), array("i", [-1])
        self._more: dict[int, dict[int, int]] = {}
        #: Of each word of the long items, the state of what ends there.
        state_of = array("i")
        self.item_of, self.end_of = array("i"), array("i")
        for k, (_, _, hashes) in enumerate(items):
            if len(hashes) < shortest:
                continue
            last = 0
            for p, w in enumerate(hashes.tolist()):
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                state_of.append(last)
                self.item_of.append(k)
                self.end_of.append(p + 1)
        self._order(state_of)
        flat = sorted((s << 32 | w, t) for s, edges in self._more.items() for w, t in edges.items())
        self.keys, self.targets = array("q", [k for k, _ in flat]), array("i", [t for _, t in flat])
        del self._more
        self.runs = _Runs([(h, k) for k, (_, _, h) in enumerate(items) if len(h) >= shortest], shortest)
        short: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for k, (_, _, h) in enumerate(items):
            if 0 < len(h) < shortest:
                short[len(h)].append((h, k))
        self.short = [_Runs(x, n) for n, x in sorted(short.items())]

    def _next(self, v: int, w: int) -> int:
        if self.word[v] == w:
            return self.to[v]
        return self._more[v].get(w, -1) if v in self._more else -1

    def _set(self, v: int, w: int, t: int) -> None:
        if self.word[v] in (-1, w):
            self.word[v], self.to[v] = w, t
        else:
            self._more.setdefault(v, {})[w] = t

    def _extend(self, last: int, w: int) -> int:
        there = self._next(last, w)
        if there >= 0:
            return there if self.length[there] == self.length[last] + 1 else self._clone(last, w, there)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and self._next(p, w) < 0:
            self._set(p, w, new)
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self._next(p, w)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, length: int) -> int:
        for a, x in ((self.link, 0), (self.length, length), (self.word, -1), (self.to, -1)):
            a.append(x)
        return len(self.link) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.length[p] + 1)
        self.word[c], self.to[c], self.link[c] = self.word[q], self.to[q], self.link[q]
        if q in self._more:
            self._more[c] = dict(self._more[q])
        self.link[q] = c
        while p >= 0 and self._next(p, w) == q:
            self._set(p, w, c)
            p = self.link[p]
        return c

    def _order(self, state_of: array) -> None:
        """Where the stretches of a state end: a run of `places`, as those of the states that link to it stand one after another."""
        n = len(self.link)
        many = np.bincount(np.frombuffer(state_of, np.int32), minlength=n).tolist() if len(state_of) else [0] * n
        by_length = np.argsort(np.frombuffer(self.length, np.int32), kind="stable").tolist()
        link = self.link
        own = list(many)
        for v in reversed(by_length[1:]):
            many[link[v]] += many[v]
        first = [0] * n
        free = list(own)
        for v in by_length[1:]:
            u = link[v]
            first[v] = first[u] + free[u]
            free[u] += many[v]
        at = array("i", first)
        places = array("i", [0]) * len(state_of)
        for p, v in enumerate(state_of):
            places[at[v]] = p
            at[v] += 1
        self.places, self.first, self.many = places, array("i", first), array("i", many)

    def step(self, v: int, w: int) -> int:
        """The state after a word, or -1."""
        if self.word[v] == w:
            return self.to[v]
        k = v << 32 | w
        i = bisect_left(self.keys, k)
        return self.targets[i] if i < len(self.keys) and self.keys[i] == k else -1

    def matched(self, words: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """(end there, item, end in the item, words) of common stretches: at each word, the longest that ends there, for each place in the items."""
        v = size = 0
        for n, w in enumerate((self.vocabulary.get(w, -1) for w in words), 1):
            while v and (w < 0 or self.step(v, w) < 0):
                v = self.link[v]
                size = self.length[v]
            t = self.step(v, w) if w >= 0 else -1
            v, size = (t, size + 1) if t >= 0 else (0, 0)
            u, m = v, size
            seen: set[int] = set()
            while u > 0 and m >= self.shortest:
                # a shorter stretch is wherever the longer one is, and in other places
                for p in self.places[self.first[u] : self.first[u] + self.many[u]]:
                    if p not in seen:
                        seen.add(p)
                        yield n, self.item_of[p], self.end_of[p], m
                u = self.link[u]
                m = self.length[u]


class _Runs:
    """Runs of n words of some items, to be found in texts."""

    def __init__(self, items: list[tuple[np.ndarray, int]], n: int):
        self.n = n
        runs = [K.span_hash(K.prefix(h), np.arange(len(h) - n + 1), np.arange(n, len(h) + 1)) for h, _ in items]
        self.hash = np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)
        self.bits = max(16, int(len(self.hash)).bit_length() + 3)
        self.may = np.zeros(1 << self.bits, bool)
        self.may[self.hash >> np.uint64(64 - self.bits)] = True
        #: Items that are one such run, by it.
        self.items: dict[int, list[int]] = defaultdict(list)
        for (h, k), run in zip(items, runs, strict=True):
            if len(h) == n:
                self.items[int(run[0])].append(k)

    def found(self, prefix: K.Prefix, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of the runs in texts that are among these, each inside one text."""
        a = np.arange(max(0, len(prefix.wide) - self.n))
        if not len(a) or not len(self.hash):
            return a[:0], self.hash[:0]
        run = K.span_hash(prefix, a, a + self.n)
        at = np.flatnonzero(self.may[run >> np.uint64(64 - self.bits)])
        at = at[self.hash[np.minimum(np.searchsorted(self.hash, run[at]), len(self.hash) - 1)] == run[at]]
        at = at[np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + self.n - 1, "right")]
        return at, run[at]


def pieces(texts: pa.Array, automaton: Automaton) -> list[list[Piece]]:
    """For each text, what it has in common with the items."""
    out: list[list[Piece]] = [[] for _ in range(len(texts))]
    for a, b in K.slices(texts):
        w = K.words(texts.slice(a, b - a))
        prefix = K.prefix(w.hash)

        def add(row: int, s: int, e: int, k: int, at: int) -> None:
            out[a + row].append(Piece(s - int(w.offsets[row]), e - int(w.offsets[row]), int(w.start[s] - w.at[row]), int(w.end[e - 1] - w.at[row]), automaton.numbers[k], automaton.ids[k], at, automaton.sizes[k]))

        at, _ = automaton.runs.found(prefix, w.offsets)
        if len(at):
            # runs that follow on one another are one stretch, if they are of the same text
            text = np.searchsorted(w.offsets, at, "right")
            for x in np.split(at, np.flatnonzero((np.diff(at) != 1) | (np.diff(text) != 0)) + 1):
                first = int(x[0])
                grown: dict[tuple[int, int], tuple[int, int]] = {}
                row = int(w.row[first])
                for n, k, end, size in automaton.matched(w.hash[first : int(x[-1]) + automaton.shortest].tolist()):
                    # what goes on word by word in text and item is one piece
                    s, e = grown.get((k, end - n), (0, -1))
                    if e == n - 1:
                        grown[k, end - n] = min(s, n - size), n
                    else:
                        if e >= 0:
                            add(row, first + s, first + e, k, s + end - n)
                        grown[k, end - n] = n - size, n
                for (k, shift), (s, e) in grown.items():
                    add(row, first + s, first + e, k, s + shift)
        for runs in automaton.short:
            for s, h in zip(*(x.tolist() for x in runs.found(prefix, w.offsets)), strict=True):
                for k in runs.items[h]:
                    add(int(w.row[s]), s, s + runs.n, k, 0)
    return out


def decided(found: list[Piece], limits: Limits) -> list[dict]:
    """What is to be removed of a text: spans, by place."""
    covered: dict[int, set[int]] = defaultdict(set)
    by_item: dict[int, list[Piece]] = defaultdict(list)
    for p in found:
        covered[p.number].update(range(p.at, p.at + p.e - p.s))
        by_item[p.number].append(p)
    share = {k: len(c) / by_item[k][0].size for k, c in covered.items()}
    much = [p for p in found if share[p.number] >= limits.coverage]
    whole: dict[tuple[int, int], list[Piece]] = defaultdict(list)
    for p in found:
        whole[p.s, p.e].append(p)
    out, reached = [], -1
    for s, e in sorted(whole, key=lambda x: (x[0], -x[1])):
        if e <= reached:
            continue  # inside another one
        reached = e
        items = {p.number: p for p in whole[s, e]}
        items |= {p.number: p for p in much if min(e, p.e) - max(s, p.s) >= min(limits.shortest, p.size)}
        most = max(share[k] for k in items)
        if e - s >= limits.length or most >= limits.coverage:
            p = whole[s, e][0]
            out.append({"start": p.start, "end": p.end, "n_words": e - s, "coverage": most, "items": [items[k].item for k in sorted(items)]})
    return out


def spans(texts: pa.Array, automata: list[Automaton], limits: Limits) -> list[list[dict]]:
    """For each text, what is to be removed of it."""
    every = [pieces(texts, a) for a in automata]
    return [decided([p for x in found for p in x], limits) for found in zip(*every, strict=True)]


def _shards(items: DataFrame, limits: Limits) -> Iterator[Automaton]:
    """Automata of the items, at most about shard_words words each; there is one at least. Items come to the driver a partition at a time."""
    held: list[tuple[int, int | None, np.ndarray]] = []
    n, any_ = 0, False
    for number, r in enumerate(items.toLocalIterator()):
        if r["text"]:
            held.append((number, r["item_id"], K.words(pa.array([r["text"]])).hash))
            n += len(held[-1][2])
        if n >= limits.shard_words:
            yield Automaton(held, limits.shortest)
            held, n, any_ = [], 0, True
    if held or not any_:
        yield Automaton(held, limits.shortest)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n_words", pa.int32()), ("coverage", pa.float32()), ("items", pa.list_(pa.int64()))]))
_PIECES = pa.list_(pa.struct([(x, pa.int64() if x == "item" else pa.int32()) for x in Piece._fields]))


def _spans_of(spark: SparkSession, text: Column, automaton: Automaton, limits: Limits) -> Column:
    held = shipped(spark, automaton)

    @arrow_udf(FOUND)
    def find(t: pa.Array) -> pa.Array:
        return pa.array(spans(t, [held.value], limits), _SPANS)

    return find.asNondeterministic()(text)


def _cleaned_of(spark: SparkSession, text: Column, automaton: Automaton, limits: Limits) -> Column:
    """struct changed, text: the text without its spans, null if it has none. It is found and cut in one go, by one Python worker."""
    held = shipped(spark, automaton)

    @arrow_udf("changed boolean, text string")
    def clean(t: pa.Array) -> pa.Array:
        found = spans(t, [held.value], limits)
        some = [bool(x) for x in found]
        left = cut(pa.array([x if f else None for x, f in zip(t.to_pylist(), some, strict=True)], pa.string()), pa.array(found, _SPANS))
        return pa.StructArray.from_arrays([pa.array(some, pa.bool_()), left], ["changed", "text"])

    return clean.asNondeterministic()(text)


def _pieces_of(spark: SparkSession, text: Column, automaton: Automaton) -> Column:
    held = shipped(spark, automaton)

    @arrow_udf(PIECES)
    def find(t: pa.Array) -> pa.Array:
        return pa.array([[p._asdict() for p in x] for x in pieces(t, held.value)], _PIECES)

    return find.asNondeterministic()(text)


def _in_rounds(own: DataFrame, first: Automaton, second: Automaton, rest: Iterator[Automaton], limits: Limits) -> DataFrame:
    """tl_doc, tl_mark (of the text), tl_spans: an automaton after another looks for its items, and what each found is decided together."""
    marked = own.withColumn("tl_mark", F.xxhash64("tl_text"))
    every = None
    for automaton in (x for some in ((first, second), rest) for x in some):
        found = durable(marked.select("tl_doc", "tl_mark", _pieces_of(own.sparkSession, F.col("tl_text"), automaton).alias("p")).where(F.size("p") > 0).distinct())
        every = found if every is None else every.union(found)

    @arrow_udf(FOUND)
    def decide(p: pa.Array) -> pa.Array:
        return pa.array([decided([Piece(**x) for x in row], limits) for row in p.to_pylist()], _SPANS)

    return every.groupBy("tl_doc", "tl_mark").agg(F.flatten(F.collect_list("p")).alias("p")).select("tl_doc", "tl_mark", decide.asNondeterministic()("p").alias("tl_spans"))


def _automata(items: DataFrame, limits: Limits, item_key: str, item_text: str) -> tuple[Automaton, Automaton | None, Iterator[Automaton]]:
    """The first automaton, the second if there is more than one, and the rest."""
    shards = _shards(items.select(items[item_key].cast("long").alias("item_id"), items[item_text].cast("string").alias("text")), limits)
    return next(shards), next(shards, None), shards


def _joined_spans(own: DataFrame, automata: tuple[Automaton, Automaton, Iterator[Automaton]], limits: Limits) -> DataFrame:
    """own (which has tl_doc and tl_text) with tl_spans, from several rounds."""
    found = durable(_in_rounds(own.select("tl_doc", "tl_text"), *automata, limits))
    # rows without a key are told by a key of their own, as nulls don't join
    keyed = lambda df: df.withColumn("tl_key", F.struct(F.coalesce("tl_doc", F.lit(0)), F.col("tl_doc").isNull(), "tl_mark"))
    return joined(keyed(own.withColumn("tl_mark", F.xxhash64("tl_text"))), keyed(found).select("tl_key", "tl_spans"), "tl_key", "left").drop("tl_key", "tl_mark")


def contaminated(docs: DataFrame, items: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id and spans (start, end in code points, n_words, coverage, items) of the documents that hold parts of test items.

    Null and empty texts hold nothing, nor do rows without a key take part; items without text are left out. An item of
    fewer words than limits.shortest is found where it stands as a whole. A span's items are those that hold all of it, and those that share a
    part of it and of which the document covers enough; coverage is the greatest of their shares. Spans of a document may overlap, but none is
    inside another. Repeated rows give repeated rows, and items that are repeated are named as often. The number of automata doesn't change the result."""
    own = texts_of(docs, key, text)
    automata = _automata(items, limits, item_key, item_text)
    found = own.withColumn("tl_spans", _spans_of(docs.sparkSession, F.col("tl_text"), automata[0], limits)) if automata[1] is None else _joined_spans(own, automata, limits)
    return found.where(F.size("tl_spans") > 0).select(F.col("tl_doc").alias("doc_id"), F.col("tl_spans").alias("spans"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, with the spans to remove."""
    found = contaminated(dealt_table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.size("spans").alias("n_spans"), F.array_max("spans.n_words").alias("longest"), F.array_max("spans.coverage").alias("coverage"), F.array_sort(F.array_distinct(F.flatten("spans.items"))).alias("item_ids"), "spans")


@arrow_udf(StringType())
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    return cut(texts, spans)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, limits: Limits = Limits()) -> DataFrame:
    """The documents without those spans; one of which no letter or digit is left goes, others stay, also with null or empty text or without a key. n_chars, if there is such a column, follows the text."""
    names = docs.columns
    own = docs.select(*[docs[c].alias(f"tl_c{k}") for k, c in enumerate(names)], docs["doc_id"].cast("long").alias("tl_doc"), F.when(docs["doc_id"].isNotNull(), docs["text"]).alias("tl_text"))
    text = f"tl_c{names.index('text')}"
    automata = _automata(table(spark, sf_dir, "benchmark"), limits, "item_id", "text")
    if automata[1] is None:
        done = own.withColumn("tl_new", _cleaned_of(spark, F.col("tl_text"), automata[0], limits))
    else:
        found = _joined_spans(own, automata, limits)
        done = found.withColumn("tl_new", F.struct(F.coalesce(F.size("tl_spans") > 0, F.lit(False)).alias("changed"), _cut.asNondeterministic()(F.col(text), F.col("tl_spans")).alias("text")))
    changed, left = F.col("tl_new.changed"), F.col("tl_new.text")
    done = done.where(~changed | left.rlike(r"[\p{L}\p{N}]"))
    new = {text: F.when(changed, left).otherwise(F.col(text))}
    if "n_chars" in names:
        n_chars = f"tl_c{names.index('n_chars')}"
        new[n_chars] = F.when(changed, F.length(left)).otherwise(F.col(n_chars))
    return done.select(*[new.get(f"tl_c{k}", F.col(f"tl_c{k}")).alias(c) for k, c in enumerate(names)])
