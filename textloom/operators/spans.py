"""What can be asked of chunks' spans: statistics, overlap of neighbours, which chunks cover a position."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.gather import gathered


def chunk_stats(chunks: DataFrame, by: list[str], content: str = "content") -> DataFrame:
    """Number of chunks and letters for each group of by."""
    return chunks.groupBy(*by).agg(F.count("*").alias("chunk_count"), F.sum(F.length(content)).alias("text_length"), F.max(F.length(content)).alias("longest_chunk"))


def places(text: Column, parts: Column) -> Column:
    """Array of structs start, length, in code points: the first place of each of an array's parts in text, -1 if it isn't in it.

    A text's bytes are searched for all its parts where they lie. To explode the parts first makes a copy of the text for each."""

    @arrow_udf("array<struct<start:int,length:int>>")
    def f(t: pa.Array, p: pa.Array) -> pa.Array:
        flat = p.flatten()
        found = np.full(len(flat), -1, np.int32)
        raw, at = flat.cast(pa.binary()), 0
        for whole, n in zip(t.cast(pa.binary()), p.value_lengths().fill_null(0).to_pylist(), strict=True):
            if n and whole.is_valid:
                found[at : at + n] = _first_places(whole.as_py(), raw.slice(at, n).to_pylist())
            at += n
        lengths = pc.utf8_length(flat).cast(pa.int32())
        rows = pa.array(np.concatenate([[0], np.cumsum(p.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]), pa.int32())
        return pa.ListArray.from_arrays(rows, pa.StructArray.from_arrays([pa.array(found), lengths], ["start", "length"]), mask=p.is_null())

    return f.asNondeterministic()(text, parts)


def _first_places(text: bytes, parts: list[bytes]) -> np.ndarray:
    """Where each part first is in a text of UTF-8, in code points, or -1."""
    at = np.array([text.find(x) for x in parts], np.int64)
    if not text.isascii():
        # how many characters begin before each byte
        begun = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        at = np.where(at < 0, -1, begun[at])
    return at


def overlaps(chunks: DataFrame, key: str = "doc_id", number: str = "chunk_num", start: str = "start", end: str = "end") -> DataFrame:
    """key, number, overlap_start, overlap_end where a chunk's span runs into the next one's; chunks that weren't found (-1) have no part in it."""
    w = Window.partitionBy(key).orderBy(start, end, number)
    found = chunks.where(F.col(start) >= 0).select(key, number, start, end, F.lead(start).over(w).alias("tl_start"), F.lead(end).over(w).alias("tl_end"))
    both = found.where("tl_start is not null").select(key, number, F.greatest(start, "tl_start").alias("overlap_start"), F.least(end, "tl_end").alias("overlap_end"))
    return both.where("overlap_start < overlap_end")


def cover(chunks: DataFrame, key: str = "doc_id", number: str = "chunk_num", start: str = "start", end: str = "end", most: int = 2) -> DataFrame:
    """key, start, end, chunks: stretches of a text that the same chunks cover, with the first `most` of these.

    Stretches stand for their positions, so that the result grows with the chunks, not with the letters. A text's chunks
    are gone through once, in order, with those held that haven't ended yet: no chunk is compared with all others.
    Chunks that weren't found (-1) or are empty cover nothing."""
    kind = dict(chunks.dtypes)
    chunk = F.struct(F.col(start).cast("long").alias("a"), F.col(number).cast("long").alias("n"), F.col(end).cast("long").alias("b"))
    found = chunks.where((F.col(start) >= 0) & (F.col(end) > F.col(start))).groupBy(key).agg(F.sort_array(F.collect_list(chunk)).alias("tl_c"))

    @arrow_udf("array<struct<start:long,end:long,chunks:array<long>>>")
    def sweep(c: pa.Array) -> pa.Array:
        flat = c.flatten()
        a, n, b = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("a", "n", "b"))

        def rows() -> Iterator[list[dict]]:
            at = 0
            for size in c.value_lengths().to_pylist():
                yield _covered(a[at : at + size], n[at : at + size].tolist(), b[at : at + size], most)
                at += size

        return gathered(rows(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chunks", pa.list_(pa.int64()))])), lambda r: 100 * len(r))

    each = found.select(key, F.inline(sweep.asNondeterministic()("tl_c")))
    return each.select(key, F.col("start").cast(kind[start]).alias("start"), F.col("end").cast(kind[end]).alias("end"), F.col("chunks").cast(f"array<{kind[number]}>").alias("chunks"))


def _covered(a: np.ndarray, n: list[int], b: np.ndarray, most: int) -> list[dict]:
    """Stretches of one text; its chunks are in order of start and number."""
    edges = np.unique(np.concatenate([a, b]))
    begin = np.searchsorted(a, edges, "right").tolist()
    ending = np.argsort(b, kind="stable")
    over = np.searchsorted(b[ending], edges, "right").tolist()
    ending, edges = ending.tolist(), edges.tolist()
    held: list[int] = []  # chunks under way, in order
    begun = ended = 0
    out = []
    for k in range(len(edges) - 1):
        held.extend(range(begun, begin[k]))
        begun = begin[k]
        for i in ending[ended : over[k]]:
            del held[bisect_left(held, i)]
        ended = over[k]
        if held:
            out.append({"start": edges[k], "end": edges[k + 1], "chunks": [n[i] for i in held[:most]]})
    return out
