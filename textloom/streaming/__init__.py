"""Chunks of documents and files as they come in.

Chunking has no state beyond a document, so a stream goes through the same plan as a table, and late rows need no watermark.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..errors import InvalidInputError
from ..operators.documents import chunk_documents
from ..sources.files import read_sections


def stream_files(spark: SparkSession, folder: str, pattern: str | None = None, per_batch: int | None = None) -> DataFrame:
    """path and content of files that turn up in a folder."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(folder).select("path", "content")


def stream_chunks(documents: DataFrame, **limits: Any) -> DataFrame:
    """chunk_documents over a stream. on_errors="break" needs an order that a stream hasn't got."""
    if limits.get("on_errors") == "break":
        raise InvalidInputError('on_errors="break" needs all rows; use "skip" on a stream')
    return chunk_documents(documents, **limits)


def stream_file_chunks(spark: SparkSession, folder: str, on_errors: str = "skip", **limits: Any) -> DataFrame:
    """Chunks of the files that turn up; files that can't be read are left out with "skip"."""
    if on_errors == "break":
        raise InvalidInputError('on_errors="break" needs all rows; use "skip" on a stream')
    sections = read_sections(stream_files(spark, folder), on_errors).where("error is null").drop("error")
    return chunk_documents(sections, key="source", on_errors=on_errors, **limits)


def write_chunks(chunks: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends chunks to a Parquet table, each exactly once; once takes what is there and stops."""
    writer = chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
