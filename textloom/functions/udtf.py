"""Chunking as table functions, for use in SQL: SELECT ... FROM t, LATERAL chunk_text(t.text, 3, 20)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.code import CodeLimits, pack_code
from ..operators.packing import Finder, Limits, pack
from .plain import plain_sentences


@udtf(returnType="chunk_num int, content string, span_start int, span_end int")
class ChunkText:
    """Chunks of a text by sentences, with an overlap in per cent."""

    def eval(self, text: str, max_sentences: int, overlap_percent: int):
        if text:
            limits, find = Limits(max_sentences=max_sentences, overlap_percent=overlap_percent), Finder(text).find
            for k, c in enumerate(pack(plain_sentences(text), limits), 1):
                yield k, c.strip(), *find(c.removeprefix(limits.marker))


@udtf(returnType="chunk_num int, content string, tree string, start_line int, end_line int")
class ChunkCode:
    """Chunks of source code by lines; blocks that are too long are cut."""

    def eval(self, code: str, max_lines: int):
        if code:
            for k, c in enumerate(pack_code(code, CodeLimits(max_lines=max_lines, strict=False)), 1):
                yield k, c["content"], c["tree"], c["start_line"], c["end_line"]


def register(spark: SparkSession) -> None:
    """Makes chunk_text and chunk_code known to a session's SQL."""
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("chunk_code", ChunkCode)
