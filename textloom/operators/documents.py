"""Chunking of documents: sentences packed under limits on tokens, sentences and section breaks.

Without overlap and token limits a chunk is a slice of the sentence array, and the whole plan is one
stage of Catalyst expressions. With them packing is a left-to-right procedure whose state is text,
and runs in an Arrow UDF, a document at a time. Neither shuffles: parallelism is across documents.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..errors import InvalidInputError, MissingTokenCounterError
from ..functions import text as T
from ..functions.gather import gathered
from .packing import Finder, Limits, pack
from .sentences import sentence_column

CHUNK = "array<struct<content:string,start:int,end:int,n_sentences:int,n_tokens:int,error:string>>"
_CHUNK = pa.list_(pa.struct([("content", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("n_sentences", pa.int32()), ("n_tokens", pa.int32()), ("error", pa.string())]))


def words(text: str) -> int:
    """The token counter that is built in: words between white space."""
    return len(text.split())


def check_limits(max_tokens: int | None, max_sentences: int | None, max_section_breaks: int | None, overlap_percent: float, offset: int, token_counter: Callable | None) -> None:
    """Raises on the driver, when the plan is made."""
    for name, value, least in (("max_tokens", max_tokens, 12), ("max_sentences", max_sentences, 1), ("max_section_breaks", max_section_breaks, 1), ("offset", offset, 0)):
        if value is not None and (not isinstance(value, int) or isinstance(value, bool) or value < least):
            raise InvalidInputError(f"{name} is an integer of at least {least}, not {value!r}")
    if not isinstance(overlap_percent, (int, float)) or not 0 <= overlap_percent <= 75:
        raise InvalidInputError(f"overlap_percent is from 0 to 75, not {overlap_percent!r}")
    if max_tokens is None and max_sentences is None and max_section_breaks is None:
        raise InvalidInputError("Give at least one of max_tokens, max_sentences and max_section_breaks")
    if max_tokens is not None and token_counter is None:
        raise MissingTokenCounterError()


def _marked(sentences: Column) -> Column:
    """Sentences with whether each is a heading: array of structs s, head. It is asked once for all that hangs on it."""
    return F.transform(sentences, lambda x: F.struct(x.alias("s"), T.is_section_break(x).alias("head")))


def _slices(marked: Column, max_sentences: int | None, max_section_breaks: int | None) -> Column:
    """Arrays of marked sentences by limits on sentences or sections alone, without overlap."""

    def by_sentences(m: Column) -> Column:
        n = max_sentences
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / n).cast("int")), lambda k: F.slice(m, k * n + 1, F.lit(n)))

    def by_sections(m: Column) -> Column:
        heads = F.filter(F.transform(m, lambda x, i: F.when(x["head"], i)), lambda i: i.isNotNull())
        # a chunk starts at the text's start and at every max_section_breaks-th heading after the first
        first = F.filter(F.transform(heads, lambda i, k: F.when((k > 0) & (k % max_section_breaks == 0), i)), lambda i: i.isNotNull())
        return T.let(first, lambda f: F.zip_with(F.concat(F.array(F.lit(0)), f), F.concat(f, F.array(F.size(m))), lambda a, b: F.slice(m, a + 1, b - a)))

    cut = by_sentences if max_section_breaks is None else by_sections
    # none for a null text, none for one without sentences
    return T.let(marked, lambda m: F.when(F.size(m) > 0, cut(m)))


def _joined(marked: Column) -> Column:
    return T.strip(F.array_join(F.transform(marked, lambda x: F.when(x["head"], F.concat(F.lit("\n"), x["s"])).otherwise(x["s"])), "\n"))


def chunk_column(text: Column, sentences: Column, limits: Limits, token_counter: Callable | None = None, skip_errors: bool = False) -> Column:
    """Array of structs content, start, end, n_sentences, n_tokens, error for one document."""
    counter = token_counter

    @arrow_udf(CHUNK)
    def f(t: pa.Array, s: pa.Array) -> pa.Array:
        # a document's values are Python's only while it is gone through, and its chunks until there are some of them
        pairs = zip((x.as_py() for x in t), (x.as_py() for x in s), strict=True)
        return gathered((chunks_of(*p) for p in pairs), _CHUNK, lambda rows: sum(100 + len(r["content"] or "") for r in rows))

    def chunks_of(whole: str | None, parts: list[str] | None) -> list[dict]:
        if whole is None or not parts:
            return []
        try:
            chunks = pack(parts, limits, counter)
        except Exception as e:
            if not skip_errors:
                raise
            return [{"content": None, "start": -1, "end": -1, "n_sentences": 0, "n_tokens": None, "error": f"{type(e).__name__}: {e}"}]
        find = Finder(whole).find
        rows = []
        for c in chunks:
            start, end = find(c.removeprefix(limits.marker))
            content = c.strip()
            rows.append({"content": content, "start": start, "end": end, "n_sentences": c.count("\n") + 1, "n_tokens": counter(content) if counter is not None and content else None, "error": None})
        return rows

    return f.asNondeterministic()(text, sentences)


def chunk_documents(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    lang: str | Column = "fallback",
    max_tokens: int | None = None,
    max_sentences: int | None = None,
    max_section_breaks: int | None = None,
    overlap_percent: float = 20,
    offset: int = 0,
    token_counter: Callable[[str], int] | None = None,
    continuation_marker: str = "...",
    spans: bool = True,
    on_errors: str = "raise",
    compat: bool = True,
) -> DataFrame:
    """A row per chunk: df's columns without the text, chunk_num (from 1), content, span (start, end in code points, -1 if not found), n_tokens.

    Blank and null texts have no chunks. offset skips that many sentences. token_counter: a function from text to a number.
    on_errors: "raise" lets the job fail; "skip" gives a row with error and without content for each document that failed
    (see split_errors); "break" keeps the documents whose key is less than the first that failed."""
    check_limits(max_tokens, max_sentences, max_section_breaks, overlap_percent, offset, token_counter)
    if on_errors not in ("raise", "skip", "break"):
        raise InvalidInputError(f"on_errors is raise, skip or break, not {on_errors!r}")
    limits = Limits(max_tokens, max_sentences, max_section_breaks, overlap_percent, continuation_marker, compat)
    rest = [c for c in df.columns if c != text]
    sentences = sentence_column(F.col(text), lang)
    if offset:
        sentences = F.slice(sentences, offset + 1, 1 << 30)
    plain = overlap_percent == 0 and max_tokens is None and (max_sentences is None or max_section_breaks is None)
    if plain and not spans:
        chunks = df.select(*rest, F.posexplode(_slices(_marked(sentences), max_sentences, max_section_breaks)).alias("chunk_num", "tl_g"))
        return chunks.select(*rest, (F.col("chunk_num") + 1).alias("chunk_num"), _joined(F.col("tl_g")).alias("content"))
    base = df.select(*rest, F.col(text).alias("tl_t"), sentences.alias("tl_s"))
    made = base.select(*rest, F.posexplode(chunk_column(F.col("tl_t"), F.col("tl_s"), limits, token_counter, on_errors != "raise")).alias("chunk_num", "c"))
    out = made.select(*rest, (F.col("chunk_num") + 1).alias("chunk_num"), "c.content", F.struct("c.start", "c.end").alias("span"), "c.n_tokens", "c.error")
    if on_errors == "raise":
        return out.drop("error")
    if on_errors == "break":
        first = out.where("error is not null").agg(F.min(key).alias("tl_first"))
        out = out.crossJoin(F.broadcast(first)).where(F.col("tl_first").isNull() | (F.col(key) < F.col("tl_first"))).drop("tl_first", "error")
    return out


def split_errors(chunks: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(chunks, errors: key, error_class, error_message) of chunk_documents(..., on_errors="skip")."""
    bad = chunks.where("error is not null").select(key, F.regexp_extract("error", r"^(\w+):", 1).alias("error_class"), F.regexp_replace("error", r"^\w+: ", "").alias("error_message"))
    return chunks.where("error is null").drop("error"), bad
