"""Line dedup by a deletion-neighbourhood join, for lines within one edit of each other.

Two lines are within one edit exactly if one is the other without a character, or both are the
same without the character at the same place: so each line emits its variants, the line and the
line without each of its characters, as hashed keys, equal keys are joined, and the edit distance
of what meets is verified. All variants of all lines would be as many keys as there are characters.
So that only variants that can meet are emitted, a first join asks which lines agree with
another one in all but one of SEGMENTS pieces: whatever is within one edit does. Only the lines
and pieces that it finds emit variants. Nothing is lost by that, and it costs 2 * SEGMENTS keys a line.

Lines are compared lower-case (code point by code point), without white space at the ends. Of
equal or near lines the earliest stays, by (doc_id, line number). A line goes if any earlier one
is within the bound, even if that one goes too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from . import kernels as K
from .common import Scatter, block_reduce, bucket_of, durable, joined, parts, starts, starts_of, table, texts_of

SEGMENTS = 4
#: Lines with fewer characters aren't compared: they say too little to be copies.
MIN_CHARS = 16
REMOVED = "doc_id long, line int, start int, end int, kept_doc_id long, kept_line int, distance int"


def _raw(h: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (h[end] - h[start]) * inverse[start]


def _segment_keys(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """lines x 2 * SEGMENTS: keys of the line without each piece, as one of its own length, then as one that has a character more."""
    inverse = K.powers(len(h))[1]
    out = []
    for longer in (0, 1):
        size = e - s - longer
        for j in range(SEGMENTS):
            a, b = size * j // SEGMENTS, size * (j + 1) // SEGMENTS
            key = K.mix(_raw(h, inverse, s, s + a)) * np.uint64(0x9E3779B97F4A7C15) + K.mix(_raw(h, inverse, s + b + longer, e))
            out.append(K.mix(key + (size * SEGMENTS + j).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    return np.stack(out, axis=1) if len(s) else np.zeros((0, 2 * SEGMENTS), np.uint64)


#: key, check, doc, line, start, end; kept_doc, kept_line; keys of the pieces
_LINE = ["u8", "u4", "i8", "i4", "i4", "i4", "i8", "i4"] + ["u8"] * (2 * SEGMENTS)
#: Lines that are compared on the map side, before they are shuffled.
_HOLD = 1 << 18


def _line_rows(buckets: int, min_chars: int):
    """Of equal lines in a block only the first goes to the key's bucket, so that a line that very many documents have is a row a block there. The others are known to go; they go to their documents' buckets, with the first's place."""

    def combined(out: Scatter, key, check, doc, line, start, end, segments) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((line, doc, check, key))
        first = starts_of(key[order], check[order])
        of = np.repeat(order[first], np.diff(np.append(first, len(order))))
        later = (doc[order] != doc[of]) | (line[order] != line[of])
        at = np.sort(order[first])
        yield from out.add(bucket_of(key[at], buckets), key[at], check[at], doc[at], line[at], start[at], end[at], np.zeros(len(at)), np.full(len(at), -1), *segments[at].T)
        at, to = order[later], of[later]
        none = np.zeros(len(at))
        yield from out.add(bucket_of(K.mix(doc[at]), buckets), none, none, doc[at], line[at], start[at], end[at], doc[to], line[to], *[none] * (2 * SEGMENTS))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Scatter(buckets, _LINE, 1 << 18)
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for a, b in K.slices(texts):
                cp, at = K.code_points(texts.slice(a, b - a))
                x = K.lines(cp, at)
                long = np.flatnonzero(x.last - x.first >= min_chars)
                s, e, row = x.first[long], x.last[long], x.row[long]
                h = K.prefix(K.values(cp))
                held.append((K.span_hash(h, s, e), K.span_check(h, s, e), ids[a:b][row], x.number[long], x.start[long] - at[row], x.end[long] - at[row], _segment_keys(h.wide, s, e)))
                if sum(len(h[0]) for h in held) >= _HOLD:
                    yield from combined(out, *(np.concatenate(c) for c in zip(*held, strict=True)))
                    held = []
        if held:
            yield from combined(out, *(np.concatenate(c) for c in zip(*held, strict=True)))
        yield from out.flush()

    return rows


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _exact(buckets: int, scatter: Scatter):
    """Lines by equality: the later ones of equal lines, and the segment keys of the earliest, in one table."""

    def reduce(key, check, doc, line, start, end, kept_doc, kept_line, *segments):
        local = np.flatnonzero(kept_line >= 0)
        order = np.flatnonzero(kept_line < 0)
        order = order[np.lexsort((line[order], doc[order], check[order], key[order]))]
        # a document's row that is repeated has the same lines
        order = order[starts_of(key[order], check[order], doc[order], line[order])]
        first = starts_of(key[order], check[order])
        of = np.repeat(order[first], np.diff(np.append(first, len(order))))
        later = (doc[order] != doc[of]) | (line[order] != line[of])
        gone, of = np.concatenate([order[later], local]), of[later]
        none = {f"c{k}": pa.nulls(len(gone), pa.binary()) for k in range(3)}
        yield _batch(doc_id=doc[gone], line=line[gone], start=start[gone], end=end[gone], kept_doc_id=np.concatenate([doc[of], kept_doc[local]]), kept_line=np.concatenate([line[of], kept_line[local]]), distance=np.zeros(len(gone), np.int32), tl_local=np.arange(len(gone)) >= len(of), bucket=pa.nulls(len(gone), pa.int32()), **none)
        out = Scatter(buckets, ["u8", "i8", "i4"], 1 << 19)
        one = order[first]
        for j, segment in enumerate(segments):
            k = segment[one]
            # the low bits of the line's number say which of its pieces this is
            for batch in [*out.add(bucket_of(k, buckets), k, doc[one], line[one] * (2 * SEGMENTS) + j), *(out.flush() if j == 2 * SEGMENTS - 1 else ())]:
                nulls = {n: pa.nulls(len(batch), t) for n, t in (("doc_id", pa.int64()), ("line", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("kept_doc_id", pa.int64()), ("kept_line", pa.int32()), ("distance", pa.int32()), ("tl_local", pa.bool_()))}
                yield _batch(**nulls, **{n: batch.column(n) for n in ("bucket", "c0", "c1", "c2")})

    return reduce


def _named(gone: DataFrame) -> DataFrame:
    """The lines that are gone, each with the earliest of all: an earlier one of the same block may have one before it in turn."""
    columns = [c.split()[0] for c in REMOVED.split(", ")]
    first = gone.where("not tl_local").select(*columns)
    of = first.select(F.col("doc_id").alias("kept_doc_id"), F.col("line").alias("kept_line"), F.col("kept_doc_id").alias("tl_doc"), F.col("kept_line").alias("tl_line")).distinct()
    local = gone.where("tl_local").join(of, ["kept_doc_id", "kept_line"], "left")
    local = local.withColumn("kept_doc_id", F.coalesce("tl_doc", "kept_doc_id")).withColumn("kept_line", F.coalesce("tl_line", "kept_line"))
    return first.union(local.select(*columns)).distinct()


def _alike(key, doc, piece):
    """Pieces whose key another line has too."""
    order = np.lexsort((piece, doc, key))
    key, doc, piece = key[order], doc[order], piece[order]
    first = starts(key)
    size = np.diff(np.append(first, len(key)))
    line = piece // (2 * SEGMENTS)
    of = np.repeat(first, size)
    other = np.maximum.reduceat((doc != doc[of]) | (line != line[of]), first)
    keep = np.repeat(other, size)
    yield _batch(tl_doc=doc[keep], piece=piece[keep])


_VARIANT = ["u8", "i8", "i4", "i4", "i4", "i4"]


FORM = "tl_doc long, line int, form string"


def _variants(buckets: int):
    """Variants of the pieces: key, line, and the place of the missing character (-1: none; from -2 down: it makes a longer line into a shorter one).

    In the same table, rows with the normal forms of the lines: they are what is compared, and the texts needn't be gone through again for them."""
    no_form = (("tl_doc", pa.int64()), ("line", pa.int32()), ("form", pa.string()))

    def scattered(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            yield _batch(**{n: batch.column(n) for n in batch.schema.names}, **{n: pa.nulls(len(batch), t) for n, t in no_form})

    def forms(ids, row, line, first, last, cp) -> pa.RecordBatch:
        _, one = np.unique(np.stack([row, line]), axis=1, return_index=True)
        text = [K.lowered(cp[a:b]).tobytes().decode("utf-32-le") for a, b in zip(first[one].tolist(), last[one].tolist(), strict=True)]
        empty = {"bucket": pa.nulls(len(one), pa.int32())} | {f"c{k}": pa.nulls(len(one), pa.binary()) for k in range(len(_VARIANT))}
        return _batch(**empty, tl_doc=pa.array(ids[row[one]], pa.int64()), line=pa.array(line[one], pa.int32()), form=pa.array(text, pa.string()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Scatter(buckets, _VARIANT)
        for batch in batches:
            ids, texts, pieces = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), batch.column(2)
            for a, b in K.slices(texts):
                cp, at = K.code_points(texts.slice(a, b - a))
                x = K.lines(cp, at)
                h = K.prefix(K.values(cp)).wide
                inverse = K.powers(len(h))[1]
                part = pieces.slice(a, b - a)
                row = np.repeat(np.arange(b - a), part.value_lengths().to_numpy(zero_copy_only=False))
                code = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                line, role, j = code // (2 * SEGMENTS), code // SEGMENTS % 2, code % SEGMENTS
                at_line = np.searchsorted(x.row, row) + line
                # a repeated doc_id with another text may not have this line
                ok = (at_line < len(x.row)) & (x.row[np.minimum(at_line, len(x.row) - 1)] == row) if len(x.row) else np.zeros(len(row), bool)
                row, line, role, j, at_line = (c[ok] for c in (row, line, role, j, at_line))
                s, e = x.first[at_line], x.last[at_line]
                size = e - s - role
                low, high = size * j // SEGMENTS, size * (j + 1) // SEGMENTS + role
                many = np.where(e > s, np.minimum(high, e - s) - low, 0).clip(0)
                of = np.repeat(np.arange(len(s)), many)
                place = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                i = s[of] + place
                variant = K.mix(_raw(h, inverse, s[of], i) + (h[e[of]] - h[i + 1]) * inverse[s[of] + 1])
                yield from scattered(out.add(bucket_of(variant, buckets), variant, ids[a:b][row[of]], line[of], np.where(role[of] == 1, -2 - place, place), x.start[at_line[of]] - at[row[of]], x.end[at_line[of]] - at[row[of]]))
                whole = np.flatnonzero((role == 0) & (e > s))
                _, one = np.unique(np.stack([row[whole], line[whole]]), axis=1, return_index=True)
                whole = whole[one]
                key = K.mix(_raw(h, inverse, s[whole], e[whole]))
                yield from scattered(out.add(bucket_of(key, buckets), key, ids[a:b][row[whole]], line[whole], np.full(len(whole), -1), x.start[at_line[whole]] - at[row[whole]], x.end[at_line[whole]] - at[row[whole]]))
                if len(row):
                    yield forms(ids[a:b], row, line, s, e, cp)
        yield from scattered(out.flush())

    return rows


def _meet(key, doc, line, place, start, end):
    """Each line with an earlier one that shares a variant: without a character at the same place, or one as a whole with the other without a character."""
    kind = np.where(place >= 0, place, -1)
    order = np.lexsort((line, doc, kind, key))
    key, doc, line, place, start, end, kind = (c[order] for c in (key, doc, line, place, start, end, kind))
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])]))
    size = np.diff(np.append(first, len(key)))
    of = np.repeat(first, size)
    # whole lines and longer lines that come down to them: a pair is one of either
    whole = np.where(place == -1, np.arange(len(key)), len(key))
    longer = np.where(place < -1, np.arange(len(key)), len(key))
    w, g = np.minimum.reduceat(whole, first), np.minimum.reduceat(longer, first)
    partner = np.where(place >= 0, of, np.where(place == -1, np.repeat(g, size), np.repeat(w, size)))
    at = np.flatnonzero(partner < len(key))
    p = partner[at]
    at, p = (c[(doc[p] < doc[at]) | ((doc[p] == doc[at]) & (line[p] < line[at]))] for c in (at, p))
    yield _batch(doc_id=doc[at], line=line[at], start=start[at], end=end[at], kept_doc_id=doc[p], kept_line=line[p])


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Lines to remove: doc_id, line, start, end (code points), the earlier line that stays for it, and their edit distance, 0 or 1.

    Lines are what newlines separate. Null and empty texts have none; rows without a key take no part; lines of fewer than
    min_chars characters are left alone. Rows with the same key count as one document: lines at the same number in them
    don't remove each other. Of several earlier lines within the bound, the earliest is named. Lines of equal digests (64 bits and 31 more,
    of independent sums) are taken as equal; near ones are compared letter by letter."""
    spark = docs.sparkSession
    n = parts(spark)
    own = texts_of(docs, key, text)
    lines = own.mapInArrow(_line_rows(n, min_chars), Scatter(n, _LINE).schema)
    scatter = Scatter(n, ["u8", "i8", "i4"])
    first = durable(block_reduce(lines, n, _LINE, _exact(n, scatter), f"{REMOVED}, tl_local boolean, {scatter.schema}"))
    exact = _named(first.where("bucket is null").drop("bucket", "c0", "c1", "c2"))
    alike = block_reduce(first.where("bucket is not null").select("bucket", "c0", "c1", "c2"), n, ["u8", "i8", "i4"], _alike, "tl_doc long, piece int")
    pieces = durable(alike.groupBy("tl_doc").agg(F.collect_set("piece").alias("pieces")))
    scatter = Scatter(n, _VARIANT)
    second = durable(joined(own, pieces, "tl_doc").select("tl_doc", "tl_text", "pieces").mapInArrow(_variants(n), f"{scatter.schema}, {FORM}"))
    variants = second.where("bucket is not null").drop("tl_doc", "line", "form")
    met = block_reduce(variants, n, _VARIANT, _meet, "doc_id long, line int, start int, end int, kept_doc_id long, kept_line int")
    pairs = durable(met.distinct())
    forms = second.where("bucket is null").select(F.col("tl_doc").alias("doc_id"), "line", "form").distinct()
    a, b = forms, forms.select(F.col("doc_id").alias("kept_doc_id"), F.col("line").alias("kept_line"), F.col("form").alias("kept_form"))
    near = (
        pairs.join(a, ["doc_id", "line"])
        .join(b, ["kept_doc_id", "kept_line"])
        .where(F.levenshtein("form", "kept_form", 1) == 1)
        .groupBy("doc_id", "line")
        .agg(F.min(F.struct("kept_doc_id", "kept_line", "start", "end")).alias("k"))
        .select("doc_id", "line", "k.start", "k.end", "k.kept_doc_id", "k.kept_line", F.lit(1).alias("distance"))
    )
    return exact.union(near)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that an earlier line stands for."""
    return removed_lines(table(spark, sf_dir, "documents"))


@arrow_udf(StringType())
def _without_lines(texts: pa.Array, lines: pa.Array) -> pa.Array:
    """The texts without the lines; null where nothing but white space is left."""
    out = []
    for t, gone in zip(texts.to_pylist(), lines.to_pylist(), strict=True):
        if t is not None and gone:
            drop = set(gone)
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop)
            t = t if t.strip() else None
        out.append(t)
    return pa.array(out, pa.string())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without those lines; a document of which nothing is left goes, others stay, also with null or empty text. n_chars, if there is such a column, follows the text."""
    gone = durable(removed_lines(docs).groupBy(F.col("doc_id").alias("tl_doc")).agg(F.collect_set("line").alias("tl_lines")))
    names = docs.columns
    own = docs.select(*[docs[c].alias(f"tl_c{k}") for k, c in enumerate(names)], docs["doc_id"].cast("long").alias("tl_doc"))
    text = f"tl_c{names.index('text')}"
    cut = joined(own, gone, "tl_doc", "left").withColumn("tl_text", _without_lines.asNondeterministic()(F.col(text), F.col("tl_lines")))
    cut = cut.where("tl_lines is null or tl_text is not null")
    changed = F.col("tl_lines").isNotNull()
    new = {text: F.when(changed, F.col("tl_text")).otherwise(F.col(text))}
    if "n_chars" in names:
        n_chars = f"tl_c{names.index('n_chars')}"
        new[n_chars] = F.when(changed, F.length("tl_text")).otherwise(F.col(n_chars))
    return cut.select(*[new.get(f"tl_c{k}", F.col(f"tl_c{k}")).alias(c) for k, c in enumerate(names)])
