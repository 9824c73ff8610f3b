"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat
from .bpe import op9_bpe
from .decontaminate import op6_decontaminate
from .language_id import op5_language_id
from .line_dedup import op7_line_dedup
from .ngram_join import op4_ngram_join
from .quality import op3_compression_bands
from .secrets import op10_secret_scan
from .substring_dedup import op1_substring_dedup
from .warc import op2_warc_assembly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_warc_assembly": op2_warc_assembly,
    "op3_compression_bands": op3_compression_bands,
    "op4_ngram_join": op4_ngram_join,
    "op5_language_id": op5_language_id,
    "op6_decontaminate": op6_decontaminate,
    "op7_line_dedup": op7_line_dedup,
    "op8_chat_format": chat.op8_chat_format,
    "op9_bpe": op9_bpe,
    "op10_secret_scan": op10_secret_scan,
}

SQL: dict[str, str] = {"op8_chat_format": chat.SQL}
