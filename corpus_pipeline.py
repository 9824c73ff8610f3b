"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination and BPE encoding, each stage on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, decontaminate, language_id, line_dedup, ngram_join
from textloom.llm.common import dropped, written

STAGES = [
    ("language_id", language_id.stage),
    ("line_dedup", line_dedup.stage),
    ("ngram_join", ngram_join.stage),
    ("decontaminate", decontaminate.stage),
    ("bpe", bpe.stage),
]

#: The stages are statistics, hashes and merges that SQL can't express; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents; what each keeps is written to the shared checkpoint folder before the next reads it, and deleted when the one after that has been written.

    Rows with nulls in any column, without a key, or with empty texts pass through all stages; repeated rows are kept or go alike; an empty table gives
    an empty result; further columns, whatever their names, are carried along up to the last stage, which returns the columns of documents and those of the tokens."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = written(docs)
            if before is not None:
                dropped(spark, before)
            before = path
    return docs
