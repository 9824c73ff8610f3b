"""Chunking of source code: blocks packed under limits on tokens, lines and functions.

A block scan is a state machine over a text's lines, so each text goes through Python by itself;
nothing is shuffled. Chunks leave Python some hundred at a time, however many a text has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..errors import InvalidInputError, MissingTokenCounterError, TokenLimitError
from . import code_structure as S
from .packing import count

CHUNK = "struct<content:string,tree:string,relations:array<struct<parent:string,child:string>>,start_line:int,end_line:int,start:int,end:int,error:string>"
_CHUNK = pa.struct(
    [("content", pa.string()), ("tree", pa.string()), ("relations", pa.list_(pa.struct([("parent", pa.string()), ("child", pa.string())])))]
    + [(n, pa.int32()) for n in ("start_line", "end_line", "start", "end")]
    + [("error", pa.string())]
)
#: Chunks, and characters of them, that are held in Python at a time.
_MOST, _MOST_CHARS = 500, 1 << 20


@dataclass(frozen=True)
class CodeLimits:
    max_tokens: int | None = None
    max_lines: int | None = None
    max_functions: int | None = None
    strict: bool = True
    comments: bool = True
    docstrings: str = "all"


def check_code_limits(limits: CodeLimits, token_counter: Callable | None) -> None:
    """Raises on the driver, when the plan is made."""
    for name, least in (("max_tokens", 12), ("max_lines", 5), ("max_functions", 1)):
        value = getattr(limits, name)
        if value is not None and (not isinstance(value, int) or isinstance(value, bool) or value < least):
            raise InvalidInputError(f"{name} is an integer of at least {least}, not {value!r}")
    if limits.max_tokens is None and limits.max_lines is None and limits.max_functions is None:
        raise InvalidInputError("Give at least one of max_tokens, max_lines and max_functions")
    if limits.docstrings not in S.DOCSTRINGS:
        raise InvalidInputError(f"docstrings is one of {', '.join(S.DOCSTRINGS)}, not {limits.docstrings!r}")
    if limits.max_tokens is not None and token_counter is None:
        raise MissingTokenCounterError()


def _over(block: S.Block, tokens: int, lines: int, limits: CodeLimits) -> str:
    """Says which limits are in force, and how a block that is too long begins."""
    parts = [f"{what}: {n} > {most}" for what, n, most in (("tokens", tokens, limits.max_tokens), ("lines", lines, limits.max_lines), ("functions", int(bool(block.function)), limits.max_functions)) if most is not None]
    return f"A block is over its limits ({', '.join(parts)}); it starts with {block.content[:100]!r}"


class _Chunks:
    def __init__(self, code: str, limits: CodeLimits, counter: Callable[[str], int] | None):
        self.limits, self.counter, self.begins = limits, counter, S.line_ends(code)

    def tokens(self, text: str) -> int:
        return count(text, self.counter) if self.limits.max_tokens is not None else 0

    def over(self, tokens: int, lines: int, functions: int = 0) -> bool:
        m = self.limits
        return any(most is not None and n > most for n, most in ((tokens, m.max_tokens), (lines, m.max_lines), (functions, m.max_functions)))

    def chunk(self, content: str, relations: list[tuple[str, str]], first: int, last: int) -> dict:
        relations = list(dict.fromkeys(relations))
        return {"content": content, "tree": S.tree(relations), "relations": [{"parent": p, "child": c} for p, c in relations], "start_line": first, "end_line": last, "start": self.begins[first - 1], "end": self.begins[last], "error": None}

    def by_lines(self, block: S.Block) -> Iterator[dict]:
        """A block too long for a chunk, cut between lines; the last part's lines are counted from the block's end."""
        held: list[str] = []
        tokens, n = 0, block.start_line
        for n, line in enumerate(S.each_line(block.content), block.start_line):
            more = self.tokens(line)
            if held and self.over(tokens + more, len(held) + 1):
                yield self.chunk("\n".join(held), block.relations, n - len(held), n - 1)
                held, tokens = [], 0
            held.append(line)
            tokens += more
        if held:
            yield self.chunk("\n".join(held), block.relations, block.end_line - len(held) + 1, block.end_line)

    def pack(self, blocks: Iterable[S.Block]) -> Iterator[dict]:
        held: list[S.Block] = []
        tokens = lines = functions = 0

        def flush() -> Iterator[dict]:
            if held:
                yield self.chunk("\n".join(b.content for b in held), [r for b in held for r in b.relations], held[0].start_line, held[-1].end_line)
                held.clear()

        for b in blocks:
            t, n, f = self.tokens(b.content), b.content.count("\n") + bool(b.content), int(bool(b.function))
            own = self.limits.max_functions if f else None
            if self.over(tokens + t, lines + n, functions + f if own is not None else 0):
                yield from flush()
                tokens = lines = functions = 0
            if self.over(t, n, f if own is not None else 0):
                if self.limits.strict:
                    raise TokenLimitError(_over(b, t, n, self.limits))
                yield from self.by_lines(b)
                continue
            held.append(b)
            tokens, lines, functions = tokens + t, lines + n, functions + f
        yield from flush()


def each_chunk(code: str, limits: CodeLimits, counter: Callable[[str], int] | None = None, path: str | None = None) -> Iterator[dict]:
    """Chunks of one text, given as they are made; blank code has none."""
    if code and not code.isspace():
        yield from _Chunks(code, limits, counter).pack(S.each_block(code, limits.comments, limits.docstrings, S.is_python(code, path)))


def pack_code(code: str, limits: CodeLimits, counter: Callable[[str], int] | None = None, path: str | None = None) -> list[dict]:
    """The same as a list."""
    return list(each_chunk(code, limits, counter, path))


def _parts(chunks: Iterable[dict]) -> Iterator[pa.StructArray]:
    """Chunks as Arrow arrays of so many that little is held in Python."""
    held, size = [], 0
    for c in chunks:
        held.append(c)
        size += len(c["content"])
        if len(held) >= _MOST or size >= _MOST_CHARS:
            yield pa.array(held, _CHUNK)
            held, size = [], 0
    if held:
        yield pa.array(held, _CHUNK)


def _chunked(names: list[str], limits: CodeLimits, counter: Callable | None, skip_errors: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: rows with code and path as the last columns become a row a chunk."""

    def parts_of(code: str | None, path: str | None) -> Iterable[pa.StructArray]:
        parts = _parts(() if code is None else each_chunk(code, limits, counter, path))
        if not skip_errors:
            return parts
        try:
            # what fails has an error alone, so nothing leaves before the end
            return list(parts)
        except Exception as e:
            return [pa.array([dict.fromkeys(n.name for n in _CHUNK) | {"error": f"{type(e).__name__}: {e}"}], _CHUNK)]

    def f(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, nums, parts, size, n = [], [], [], 0, 0

            def made() -> pa.RecordBatch:
                at = pa.array(np.concatenate(rows))
                return pa.RecordBatch.from_arrays([c.take(at) for c in batch.columns[:-2]] + [pa.array(np.concatenate(nums)), pa.concat_arrays(parts)], names)  # noqa: B023

            for i in range(batch.num_rows):
                n = 0
                for part in parts_of(batch.column(batch.num_columns - 2)[i].as_py(), batch.column(batch.num_columns - 1)[i].as_py()):
                    rows.append(np.full(len(part), i, np.int32))
                    nums.append(np.arange(n + 1, n + len(part) + 1, dtype=np.int32))
                    parts.append(part)
                    n, size = n + len(part), size + part.nbytes
                    if sum(map(len, rows)) >= _MOST or size >= _MOST_CHARS:
                        yield made()
                        rows, nums, parts, size = [], [], [], 0
            if parts:
                yield made()

    return f


def chunk_code(
    df: DataFrame,
    code: str = "code",
    path: str | None = None,
    max_tokens: int | None = None,
    max_lines: int | None = None,
    max_functions: int | None = None,
    strict: bool = True,
    include_comments: bool = True,
    docstring_mode: str = "all",
    token_counter: Callable[[str], int] | None = None,
    on_errors: str = "raise",
    key: str | None = None,
) -> DataFrame:
    """A row per chunk: df's columns without the code, chunk_num (from 1), content, tree, relations, start_line, end_line, span.

    path: the column of files' paths, by which Python is known. A block over the limits is an error if strict, and cut
    between lines otherwise. on_errors: "raise" lets the job fail, "skip" gives a row with error for each text that failed,
    "break" keeps the texts whose key (the path, if no other column is named) is less than the first that failed. Blank and null code has no chunks."""
    limits = CodeLimits(max_tokens, max_lines, max_functions, strict, include_comments, docstring_mode)
    check_code_limits(limits, token_counter)
    if on_errors not in ("raise", "skip", "break"):
        raise InvalidInputError(f"on_errors is raise, skip or break, not {on_errors!r}")
    order = key or path
    if on_errors == "break" and order is None:
        raise InvalidInputError('on_errors="break" needs a key, which says what comes before what')
    rest = [c for c in df.columns if c != code]
    given = df.select(*rest, F.col(code).alias("tl_code"), (F.col(path) if path else F.lit(None).cast("string")).alias("tl_path"))
    schema = StructType([*df.select(*rest).schema.fields, *DataType.fromDDL(f"tl_num int, tl_c {CHUNK}").fields])
    made = given.mapInArrow(_chunked(schema.names, limits, token_counter, on_errors != "raise"), schema)
    out = made.select(*rest, F.col("tl_num").alias("chunk_num"), "tl_c.content", "tl_c.tree", "tl_c.relations", "tl_c.start_line", "tl_c.end_line", F.struct("tl_c.start", "tl_c.end").alias("span"), "tl_c.error")
    if on_errors == "break":
        # one row
        first = out.where("error is not null").agg(F.min(order).alias("tl_first"))
        return out.crossJoin(F.broadcast(first)).where(F.col("tl_first").isNull() | (F.col(order) < F.col("tl_first"))).drop("tl_first", "error")
    return out.drop("error") if on_errors == "raise" else out


def declarations(code: Column) -> Column:
    """How many lines of code declare a function, counted in the JVM."""
    return F.regexp_count(code, F.lit(r"(?m)^[ \t]*(?:(?:[A-Za-z ]*?def|func|fun|fn|[fF]unction|FUNCTION|proc|procedure|PROCEDURE|sub)\b\s*[^(\s]+\s*\(|\(\s*def(?:n|un|macro|method)\b\s+[^)\s]+)"))
