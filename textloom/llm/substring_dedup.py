"""Substring dedup by hashing units: lines, and stretches of words inside them.

A unit's normal form is its words, lower-case, without what stands between them. Equal digests are
brought together globally, the earliest occurrence by (doc_id, place) stays, and the rest is reported
with its place in the original text. Lines alone would miss passages that are set into the middle
of other lines, so every stretch of `window` words is a unit too: a word goes if any stretch that holds it
has stood before.

To hash every stretch of the corpus would move as many keys as there are words. But equal
stretches have the same least hash among their runs of `run` words. Those least runs, one in 13 words
or so, are brought together first, and only stretches whose least run occurs elsewhere are hashed
and compared. The result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from . import kernels as K
from .common import Scatter, block_reduce, bucket_of, cut, durable, joined, parts, starts_of, table, texts_of

SPANS = "doc_id long, unit string, start int, end int, kept_doc_id long, kept_start int"


@dataclass(frozen=True)
class Settings:
    window: int = 50  # words of a stretch
    run: int = 25  # words of the runs by which stretches are found
    #: Buckets over which the stretches of one run are spread: a passage that very many documents share has its run in as many different surroundings.
    spread: int = 16
    #: Lines of fewer words aren't units: they are repeated by chance.
    min_words: int = 5


def least_runs(w: K.Words, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each stretch, first word of its least run, that run's hash), over all texts."""
    n = len(w.hash)
    if n < s.window:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    at = np.arange(n - s.run + 1)
    run = K.span_hash(K.prefix(w.hash), at, at + s.run)
    first = np.arange(n - s.window + 1)
    row_end = w.offsets[1:][w.row[first]]
    first = first[first + s.window <= row_end]
    # sliding minimum by doubling: least[i] is the place of the least of the `size` runs from i; the leftmost of equal ones
    least, size, want = at.copy(), 1, s.window - s.run + 1
    while size < want:
        step = min(size, want - size)
        a, b = least[: len(least) - step], least[step:]
        least = np.where(run[b] < run[a], b, a)
        size += step
    least = least[first]
    return first, least, run[least]


#: key, check, doc, start, end; kept_doc, kept_start
_UNIT = ["u8", "u4", "i8", "i4", "i4", "i8", "i4"]
_LINE = np.uint64(0xA0761D6478BD642F)
#: What `end` says of a run: that it is asked whether others have it, that it occurs twice in its block, and that this is known.
_RUN, _RUN_TWICE, _RUN_KNOWN = -1, -2, -3
#: Units that are compared on the map side, before they are shuffled.
_HOLD = 1 << 19


class _Held:
    """Columns of units, until a block of them is there."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, *columns: np.ndarray) -> bool:
        if len(columns[0]):
            self.parts.append(columns)
            self.n += len(columns[0])
        return self.n >= _HOLD

    def take(self) -> tuple[np.ndarray, ...]:
        out = tuple(np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.n = [], 0
        return out


def _of_first(key, check, doc, start) -> tuple[np.ndarray, np.ndarray]:
    """(index of each sorted row's first, which rows stand elsewhere than it)."""
    first = starts_of(key, check)
    of = np.repeat(first, np.diff(np.append(first, len(key))))
    return of, (doc != doc[of]) | (start != start[of])


def _units(buckets: int, s: Settings):
    """Lines: key, doc, start, end; least runs: key, doc, first word, -1.

    Of equal units in a block only the first goes to the key's bucket, so that a unit that very many documents have
    is a row a block there. What becomes of the others is known; they go to their documents' buckets, lines with the first's place."""

    def combined(out: Scatter, key, check, doc, start, end) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((start, doc, check, key))
        key, check, doc, start, end = (c[order] for c in (key, check, doc, start, end))
        of, later = _of_first(key, check, doc, start)
        first = np.flatnonzero(of == np.arange(len(of)))
        twice = np.maximum.reduceat(later, first)
        ask = end[first].copy()
        ask[(ask == _RUN) & twice] = _RUN_TWICE
        # by place again: neighbours side by side compress well
        by = np.lexsort((start[first], doc[first]))
        at, ask = first[by], ask[by]
        yield from out.add(bucket_of(key[at], buckets), key[at], check[at], doc[at], start[at], ask, np.zeros(len(at)), np.full(len(at), -1))
        line = np.flatnonzero(later & (end >= 0))
        run = np.flatnonzero((end == _RUN) & np.repeat(twice, np.diff(np.append(first, len(key)))))
        for at, how, kept in ((line, end[line], start[of[line]]), (run, np.full(len(run), _RUN_KNOWN), np.full(len(run), -1))):
            yield from out.add(bucket_of(K.mix(doc[at]), buckets), np.zeros(len(at)), np.zeros(len(at)), doc[at], start[at], how, doc[of[at]], kept)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = Scatter(buckets, _UNIT, 1 << 19), _Held()
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for a, b in K.slices(texts):
                w = K.words(texts.slice(a, b - a))
                if not len(w.hash):
                    continue
                x = K.lines(w.cp, w.at)
                first, last = np.searchsorted(w.start, x.start), np.searchsorted(w.start, x.end)
                line = np.flatnonzero(last - first >= s.min_words)
                h = K.prefix(w.hash)
                key = K.mix(K.span_hash(h, first[line], last[line]) ^ _LINE)
                row = x.row[line]
                held.add(key, K.span_check(h, first[line], last[line]), ids[a:b][row], x.start[line] - w.at[row], x.end[line] - w.at[row])
                _, least, key = least_runs(w, s)
                if len(least):
                    new = np.concatenate([[True], least[1:] != least[:-1]])
                    least, key = least[new], key[new]
                    row = w.row[least]
                    held.add(key, K.span_check(h, least, least + s.run), ids[a:b][row], least - w.offsets[row], np.full(len(least), _RUN))
                if held.n >= _HOLD:
                    yield from combined(out, *held.take())
        if held.n:
            yield from combined(out, *held.take())
        yield from out.flush()

    return rows


def _repeats(key, check, doc, start, end, kept_doc, kept_start):
    """Lines that have stood before, and runs that occur twice. Lines that an earlier one of their block stood for say so in tl_local."""
    known = np.flatnonzero((kept_start >= 0) | (end == _RUN_KNOWN))
    order = np.flatnonzero((kept_start < 0) & (end != _RUN_KNOWN))
    order = order[np.lexsort((start[order], doc[order], check[order], key[order]))]
    # a document's row that is repeated has the same places
    order = order[starts_of(key[order], check[order], doc[order], start[order])]
    of, later = _of_first(key[order], check[order], doc[order], start[order])
    first = np.flatnonzero(of == np.arange(len(of)))
    twice = np.maximum.reduceat(later | (end[order] == _RUN_TWICE), first) if len(first) else np.zeros(0, bool)
    line = later & (end[order] >= 0)
    at, to = order[line], order[of[line]]
    local = known[end[known] >= 0]
    run = np.concatenate([order[np.repeat(twice, np.diff(np.append(first, len(order)))) & (end[order] < 0)], known[end[known] < 0]])
    gone = np.concatenate([at, local])
    yield pa.RecordBatch.from_pydict({"doc_id": doc[gone], "unit": pa.array(["line"] * len(gone), pa.string()), "start": start[gone], "end": end[gone], "kept_doc_id": np.concatenate([doc[to], kept_doc[local]]), "kept_start": np.concatenate([start[to], kept_start[local]]), "tl_run": pa.nulls(len(gone), pa.int32()), "tl_local": np.arange(len(gone)) >= len(at)})
    nulls = {n: pa.nulls(len(run), t) for n, t in (("unit", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("kept_doc_id", pa.int64()), ("kept_start", pa.int32()))}
    yield pa.RecordBatch.from_pydict({"doc_id": doc[run], **nulls, "tl_run": start[run], "tl_local": pa.nulls(len(run), pa.bool_())})


def _overlapping(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first, end) of each run of spans that overlap; spans are sorted by doc and start."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)])) << 32
    reached = np.maximum.accumulate(index + end)
    first = np.flatnonzero(np.concatenate([[True], (index + start)[1:] > reached[:-1]]))
    last = np.append(first[1:], len(doc)) - 1
    return first, reached[last] - index[last]


#: key, check, doc, start, end; kept_doc, kept_start
_STRETCH = ["u8", "u4", "i8", "i4", "i4", "i8", "i4"]


def _stretches(buckets: int, s: Settings):
    """Stretches whose least run occurs elsewhere; they go to one of the run's buckets, by what they hold, so that neighbours stay together and no passage is one bucket's work.

    Of equal stretches in a block only the first goes there. The others are decided: they are put together to spans, with the place of the first."""

    def combined(out: Scatter, key, check, doc, start, end, run) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((start, doc, check, key))
        of, later = _of_first(*(c[order] for c in (key, check, doc, start)))
        at = order[of == np.arange(len(of))]
        # by place again: neighbours side by side compress well
        at = at[np.lexsort((start[at], doc[at]))]
        yield from out.add(bucket_of(K.mix(run[at] + key[at] % np.uint64(s.spread)), buckets), key[at], check[at], doc[at], start[at], end[at], np.zeros(len(at)), np.full(len(at), -1))
        at, to = order[later], order[of[later]]
        by = np.lexsort((start[at], doc[at]))
        at, to = at[by], to[by]
        one, reached = _overlapping(doc[at], start[at].astype(np.int64), end[at].astype(np.int64))
        at, to = at[one], to[one]
        yield from out.add(bucket_of(K.mix(doc[at]), buckets), np.zeros(len(at)), np.zeros(len(at)), doc[at], start[at], reached, doc[to], start[to])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = Scatter(buckets, _STRETCH, 1 << 18), _Held()
        for batch in batches:
            ids, texts, runs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), batch.column(2)
            for a, b in K.slices(texts):
                w = K.words(texts.slice(a, b - a))
                first, least, run = least_runs(w, s)
                if not len(first):
                    continue
                part = runs.slice(a, b - a)
                row = np.repeat(np.arange(b - a), part.value_lengths().to_numpy(zero_copy_only=False))
                word = w.offsets[row] + part.flatten().to_numpy(zero_copy_only=False)
                # a repeated doc_id with another text may not have this word
                known = np.zeros(len(w.hash), bool)
                known[word[word < w.offsets[1:][row]]] = True
                take = known[least]
                first, run = first[take], run[take]
                if not len(first):
                    continue
                h = K.prefix(w.hash)
                row = w.row[first]
                if held.add(K.span_hash(h, first, first + s.window), K.span_check(h, first, first + s.window), ids[a:b][row], (w.start[first] - w.at[row]).astype(np.int32), (w.end[first + s.window - 1] - w.at[row]).astype(np.int32), run):
                    yield from combined(out, *held.take())
        if held.n:
            yield from combined(out, *held.take())
        yield from out.flush()

    return rows


def _passages(key, check, doc, start, end, kept_doc, kept_start):
    """Stretches that have stood before, those that overlap made into one."""
    decided = np.flatnonzero(kept_start >= 0)
    order = np.flatnonzero(kept_start < 0)
    order = order[np.lexsort((start[order], doc[order], check[order], key[order]))]
    of, later = _of_first(*(c[order] for c in (key, check, doc, start)))
    gone = np.concatenate([decided, order[later]])
    kept_doc = np.concatenate([kept_doc[decided], doc[order[of[later]]]])
    kept = np.concatenate([kept_start[decided], start[order[of[later]]]])
    by = np.lexsort((start[gone], doc[gone]))
    gone, kept_doc, kept = gone[by], kept_doc[by], kept[by]
    if not len(gone):
        return
    first, reached = _overlapping(doc[gone], start[gone].astype(np.int64), end[gone].astype(np.int64))
    yield pa.RecordBatch.from_pydict({"doc_id": doc[gone[first]], "start": start[gone[first]], "end": reached.astype(np.int32), "kept_doc_id": kept_doc[first], "kept_start": kept[first].astype(np.int32)})


def repeated_spans(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans (doc_id, unit, start, end in code points) that have stood before, and where: kept_doc_id, kept_start.

    unit is "line" for whole lines (what newlines separate) or "passage" for words inside them; passages don't overlap
    one another. A line's kept place is the first of all; for a passage, one is named where its first stretch has stood before, which needn't be the
    first of all. Units of equal digests (64 bits and 31 more, of independent sums) are taken as equal. Null and empty texts have no units; rows without a key take no part; rows with the same key count as one document: units at the same place in
    them don't remove each other."""
    s = settings
    n = parts(docs.sparkSession)
    own = texts_of(docs, key, text)
    units = own.mapInArrow(_units(n, s), Scatter(n, _UNIT).schema)
    first = durable(block_reduce(units, n, _UNIT, _repeats, f"{SPANS}, tl_run int, tl_local boolean"))
    lines = _named(first.where("unit is not null"))
    runs = durable(first.where("unit is null").groupBy(F.col("doc_id").alias("tl_doc")).agg(F.collect_set("tl_run").alias("tl_runs")))
    stretches = joined(own, runs, "tl_doc").select("tl_doc", "tl_text", "tl_runs").mapInArrow(_stretches(n, s), Scatter(n, _STRETCH).schema)
    found = block_reduce(stretches, n, _STRETCH, _passages, "doc_id long, start int, end int, kept_doc_id long, kept_start int")
    w = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "kept_doc_id", "kept_start")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    passages = (
        found.withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1))
        .withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "k")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "kept_doc_id", "kept_start")).alias("kept"))
        .select("doc_id", F.lit("passage").alias("unit"), "start", "end", "kept.kept_doc_id", "kept.kept_start")
    )
    return lines.union(passages)


def _named(lines: DataFrame) -> DataFrame:
    """The lines, each with the place of the first of all: an earlier one of the same block may have one before it in turn."""
    columns = [c.split()[0] for c in SPANS.split(", ")]
    first = lines.where("not tl_local").select(*columns)
    of = first.select(F.col("doc_id").alias("kept_doc_id"), F.col("start").alias("kept_start"), F.col("kept_doc_id").alias("tl_doc"), F.col("kept_start").alias("tl_start")).distinct()
    local = lines.where("tl_local").join(of, ["kept_doc_id", "kept_start"], "left")
    local = local.withColumn("kept_doc_id", F.coalesce("tl_doc", "kept_doc_id")).withColumn("kept_start", F.coalesce("tl_start", "kept_start"))
    return first.union(local.select(*columns)).distinct()


@arrow_udf(StringType())
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    return cut(texts, spans)


def without_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs (doc_id, text and any others) with the repeated spans cut out of text; the line breaks stay."""
    spans = durable(repeated_spans(docs, settings).groupBy(F.col("doc_id").alias("tl_doc")).agg(F.collect_set(F.struct("start", "end")).alias("tl_spans")))
    names = docs.columns
    own = docs.select(*[docs[c].alias(f"tl_c{k}") for k, c in enumerate(names)], docs["doc_id"].cast("long").alias("tl_doc"))
    text = f"tl_c{names.index('text')}"
    done = joined(own, spans, "tl_doc", "left").withColumn(text, F.when(F.col("tl_spans").isNull(), F.col(text)).otherwise(_cut(F.col(text), F.col("tl_spans"))))
    return done.select(*[F.col(f"tl_c{k}").alias(c) for k, c in enumerate(names)])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents that have stood before."""
    return repeated_spans(table(spark, sf_dir, "documents"))
