"""Files as DataFrames: Spark lists and reads them, and executors take them apart.

A file is one row all through, so nothing is regrouped and nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from ..errors import InvalidInputError
from ..operators.code import chunk_code
from ..operators.documents import chunk_documents
from ..operators.registry import processors
from ..operators.sentences import split_sentences
from . import readers as R

_SECTIONS = "source string, section_num int, section_count int, text string, metadata map<string,string>, error string"
_ARROW = pa.schema([("source", pa.string()), ("section_num", pa.int32()), ("section_count", pa.int32()), ("text", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("error", pa.string())])


def scan_files(spark: SparkSession, *paths: str, pattern: str | None = None) -> DataFrame:
    """path and content of files and of all files below folders."""
    if not paths:
        raise InvalidInputError("Give at least one path")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(list(paths)).select("path", "content")


def _sections(own: dict[str, tuple[str, Callable]], skip: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out: list[dict[str, Any]] = []
                try:
                    texts, meta = R.read(path.removeprefix("file:"), content or b"", own)
                    meta = {str(k): str(v) for k, v in meta.items() if v is not None}
                    out = [{"source": path, "section_num": k, "section_count": len(texts), "text": t, "metadata": list(meta.items()), "error": None} for k, t in enumerate(texts, 1)]
                except Exception as e:
                    if not skip:
                        raise
                    out = [{"source": path, "section_num": 0, "section_count": 0, "text": None, "metadata": [], "error": f"{type(e).__name__}: {e}"}]
                if out:
                    yield pa.RecordBatch.from_pylist(out, _ARROW)

    return rows


def read_sections(files: DataFrame, on_errors: str = "raise") -> DataFrame:
    """source, section_num (from 1), section_count, text, metadata, error of files (path, content).

    Processors that users have registered for an extension come first. on_errors: "raise" lets the job fail, "skip" gives a row with
    error and section_num 0 for a file that can't be read, "break" keeps the files whose path comes before the first of those."""
    if on_errors not in ("raise", "skip", "break"):
        raise InvalidInputError(f"on_errors is raise, skip or break, not {on_errors!r}")
    made = files.select("path", "content").mapInArrow(_sections(processors.snapshot(), on_errors != "raise"), _SECTIONS)
    if on_errors == "break":
        first = made.where("error is not null").agg(F.min("source").alias("tl_first"))
        made = made.crossJoin(F.broadcast(first)).where(F.col("tl_first").isNull() | (F.col("source") < F.col("tl_first"))).drop("tl_first")
    return made


def chunk_files(spark: SparkSession, *paths: str, on_errors: str = "raise", **limits: Any) -> DataFrame:
    """Chunks of files: source, section_num, section_count, metadata and what chunk_documents gives; its arguments are taken too.

    With on_errors="skip", files and sections that failed are rows with error and without content."""
    sections = read_sections(scan_files(spark, *paths), on_errors)
    if on_errors == "raise":
        return chunk_documents(sections.drop("error"), key="source", **limits)
    kept = chunk_documents(sections.where("error is null").drop("error"), key="source", on_errors=on_errors, **limits)
    if on_errors == "break":
        return kept
    failed = sections.where("error is not null").drop("text")
    return kept.unionByName(failed, allowMissingColumns=True)


@arrow_udf(StringType())
def _decoded(paths: pa.Array, contents: pa.Array) -> pa.Array:
    return pa.array([R.decoded(c.as_py() or b"", p.as_py()) for p, c in zip(paths, contents, strict=True)], pa.string())


def chunk_code_files(spark: SparkSession, *paths: str, **limits: Any) -> DataFrame:
    """Chunks of source files with their path as source; chunk_code's arguments are taken."""
    code = scan_files(spark, *paths).select(F.col("path").alias("source"), _decoded.asNondeterministic()("path", "content").alias("code"))
    return chunk_code(code, path="source", **limits)


def sentence_files(spark: SparkSession, *paths: str, lang: str = "fallback") -> DataFrame:
    """Sentences of files, section by section."""
    return split_sentences(read_sections(scan_files(spark, *paths)).select("source", "section_num", "text"), lang=lang)
