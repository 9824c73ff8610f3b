"""Splitting of text columns into sentences."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from .detect import detect, route
from .registry import call_splitter, splitters


def sentence_column(text: Column, lang: str | Column = "fallback") -> Column:
    """Array of cleaned sentences of text.

    lang: a code, a column of codes, or "auto" to detect it. Splitters that users have registered for a language
    come first, but not where detection is too unsure; all other languages go to the universal splitter, which knows the
    commonest abbreviations of some languages, and of others the terminators that need no white space."""
    code = lang
    if isinstance(lang, str):
        if lang == "auto":
            found = detect(text)
            code = route(found["code"], found["confidence"])
        else:
            code = F.lit(lang)
    own = splitters.snapshot()
    if isinstance(lang, str) and lang != "auto":
        own = {k: v for k, v in own.items() if k == lang}
    own.pop("fallback", None)
    out = T.sentences(text, lang if isinstance(lang, str) and lang != "auto" else code)
    for k, (label, f) in own.items():
        out = F.when(code == k, T.clean_sentences(_called(label, f)(text))).otherwise(out)
    return out


def _called(label: str, f: Callable[[str], list[str]]):
    """A user's splitter over columns, a batch at a time."""

    @arrow_udf(ArrayType(StringType()))
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else call_splitter(label, f, t) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return split.asNondeterministic()


def split_sentences(df: DataFrame, text: str = "text", lang: str | Column = "fallback") -> DataFrame:
    """A row per sentence: df's columns without the text, sent_num (from 1), sentence, is_section_break, n_clauses, n_tokens (words)."""
    rest = [c for c in df.columns if c != text]
    s = df.select(*rest, F.posexplode(sentence_column(df[text], lang)).alias("sent_num", "sentence"))
    return s.select(*rest, (F.col("sent_num") + 1).alias("sent_num"), "sentence", T.is_section_break(F.col("sentence")).alias("is_section_break"), F.size(T.clauses(F.col("sentence"))).alias("n_clauses"), T.word_tokens(F.col("sentence")).alias("n_tokens"))
