"""Quality rules by compression: bands of zstandard ratios for whole documents and fixed chunks.

The ratio is UTF-8 bytes over compressed bytes. Repetitive text compresses too well, random text
(keys, base64) hardly at all; hexadecimal digits compress as well as prose and aren't told from it. What is usual depends on the length, as short texts compress less.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udf

from .common import dealt_table

SCHEMA = "n_bytes long, ratio double, n_chunks int, repetitive_chunks int, random_chunks int, reason string, keep boolean"


@dataclass(frozen=True)
class Bands:
    level: int = 3
    #: (length in bytes from which it holds, least ratio, greatest ratio); below the first length nothing is rejected.
    #: The least ratios stand between those of base64 and random characters at a band's end and those of prose at its start.
    documents: tuple[tuple[int, float, float], ...] = (
        (100, 0.935, 3.0), (110, 0.97, 3.0), (120, 0.985, 3.0), (130, 1.0, 3.0), (140, 1.02, 3.0), (150, 1.04, 3.0), (175, 1.08, 3.0), (200, 1.13, 3.0), (250, 1.17, 3.0),
        (300, 1.22, 4.0), (400, 1.27, 4.0), (500, 1.31, 4.0), (700, 1.38, 4.0), (1000, 1.45, 5.0), (3000, 1.5, 6.0), (10000, 1.6, 8.0),
    )
    chunk: int = 1024  # bytes
    #: A last chunk shorter than this isn't looked at, unless it is the only one.
    least_chunk: int = 512
    chunk_least: float = 1.35
    chunk_greatest: float = 4.0
    #: A document is rejected when more than this share of its chunks is outside the limits.
    chunk_share: float = 0.5


def judge(data: bytes, compress, bands: Bands) -> tuple[float, int, int, int, str | None]:
    """(ratio, chunks, repetitive, random, reason or None) of one text; an empty one has ratio 0 and is kept."""
    n = len(data)
    if not n:
        return 0.0, 0, 0, 0, None
    ratio = n / len(compress(data))
    reason = None
    for least, low, high in reversed(bands.documents):
        if n >= least:
            reason = "repetitive" if ratio > high else "incompressible" if ratio < low else None
            break
    chunks = repetitive = random = 0
    if n >= bands.least_chunk:
        view = memoryview(data)
        for a in range(0, n, bands.chunk):
            size = min(bands.chunk, n - a)
            if size < bands.least_chunk and a:
                break
            r = size / len(compress(view[a : a + size]))
            chunks += 1
            repetitive += r > bands.chunk_greatest
            random += r < bands.chunk_least
    if reason is None and chunks:
        if repetitive > bands.chunk_share * chunks:
            reason = "repetitive chunks"
        elif random > bands.chunk_share * chunks:
            reason = "incompressible chunks"
    return ratio, chunks, repetitive, random, reason


def judged(texts: pa.Array, bands: Bands) -> pa.StructArray:
    compress = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False).compress
    null = texts.is_null().to_numpy(zero_copy_only=False)
    data = pc.fill_null(texts, "").cast(pa.binary())
    rows = [judge(v.as_buffer().to_pybytes(), compress, bands) for v in data]
    ratio, chunks, repetitive, random, reason = zip(*rows, strict=True) if rows else ((),) * 5
    n = np.array([len(x) for x in data.to_pylist()], np.int64) if rows else np.zeros(0, np.int64)
    return pa.StructArray.from_arrays(
        [pa.array(n), pa.array(ratio, pa.float64()), pa.array(chunks, pa.int32()), pa.array(repetitive, pa.int32()), pa.array(random, pa.int32()), pa.array(reason, pa.string()), pa.array([r is None for r in reason], pa.bool_())],
        ["n_bytes", "ratio", "n_chunks", "repetitive_chunks", "random_chunks", "reason", "keep"],
        mask=None if not null.any() else pa.array(np.zeros(len(null), bool)),
    )


def compression_bands(docs: DataFrame, bands: Bands = Bands(), text: str = "text"):
    """Column expression over docs: struct n_bytes, ratio, n_chunks, repetitive_chunks, random_chunks, reason, keep.

    Null and empty texts have ratio 0, no chunks, and are kept, as are texts shorter than the first
    band; equal texts get equal answers. Long texts are compressed whole and chunk by chunk."""

    @arrow_udf(SCHEMA)
    def f(t: pa.Array) -> pa.Array:
        return judged(t, bands)

    return f.asNondeterministic()(docs[text])


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every document."""
    docs = dealt_table(spark, sf_dir, "documents")
    return docs.select("doc_id", compression_bands(docs).alias("v")).select("doc_id", "v.*")
