"""Packing of one document's sentences into chunks: the procedure behind token limits and overlap.

`compat` keeps three habits of the packing that this one is to agree with: the clauses of a sentence
that were fitted onto a chunk appear again when the sentence starts the next one; nothing is checked
again after overlap; a sentence too long for any chunk, with no clause that fits, is kept whole with dots.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from ..errors import CallbackError
from ..functions.terminators import CLAUSE_MARKS
from ..functions.text import SECTION_BREAK

Counter = Callable[[str], int]
_CLAUSE = re.compile(rf"(?<=[{CLAUSE_MARKS}])\s")
_SECTION = re.compile(SECTION_BREAK)
#: What str.isalnum doesn't have.
_OTHER = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class Limits:
    max_tokens: int | None = None
    max_sentences: int | None = None
    max_section_breaks: int | None = None
    overlap_percent: float = 20
    marker: str = "..."
    compat: bool = True


def count(text: str, counter: Counter) -> int:
    """Tokens by a user's counter; blank text has none, and an answer that isn't a number is an error."""
    if not text.strip():
        return 0
    try:
        n = counter(text)
    except Exception as e:
        raise CallbackError(f"The token counter failed on text starting with {text[:100]!r}: {e}") from e
    if not isinstance(n, (int, float)):
        raise CallbackError(f"The token counter returned {type(n).__name__} for text starting with {text[:100]!r}")
    return int(n)


class Packer:
    """State of one pass over a document's sentences."""

    def __init__(self, limits: Limits, counter: Counter | None):
        self.limits = limits
        known: dict[str, int] = {}

        def tokens(t: str) -> int:
            if t not in known:
                known[t] = count(t, counter)
            return known[t]

        self.tokens = tokens if limits.max_tokens is not None else lambda t: 0
        self.held: list[str] = []
        self.n_tokens = self.n_sentences = self.n_headings = 0

    def carried(self) -> list[str]:
        """Clauses that the next chunk starts with."""
        parts = [c for s in self.held for c in _CLAUSE.split(s)]
        n = round(len(parts) * self.limits.overlap_percent / 100)
        if not n:
            return []
        last = parts[-n:]
        if last[0] and not last[0][0].isupper():
            last[0] = f"{self.limits.marker} {last[0]}"
        return last

    def turn_over(self) -> str:
        done = "\n".join(self.held)
        self.held = self.carried()
        lim = self.limits
        self.n_tokens = sum(map(self.tokens, self.held)) if lim.max_tokens is not None else 0
        self.n_sentences = len(self.held) if lim.max_sentences is not None else 0
        self.n_headings = sum(bool(_SECTION.match(s)) for s in self.held) if lim.max_section_breaks is not None else 0
        return done

    def fitted(self, sentence: str) -> tuple[str, str]:
        """The clauses that still fit, and the rest."""
        room, parts = self.limits.max_tokens - self.n_tokens, _CLAUSE.split(sentence)
        for i, c in enumerate(parts):
            n = self.tokens(c)
            if n > room:
                return " ".join(parts[:i]), " ".join(parts[i:])
            room -= n
        return " ".join(parts), ""

    def cut_off(self, text: str) -> str:
        kept = []
        for part in re.split(r"[ /\\]", text):
            if self.tokens(part + "...") > self.limits.max_tokens:
                break
            kept.append(part)
        return " ".join(kept) + "..."

    def pack(self, sentences: list[str]) -> list[str]:
        lim, out = self.limits, []
        work = list(reversed(sentences))
        while work:
            s = work.pop()
            heading = bool(_SECTION.match(s))
            if heading:
                s = "\n" + s
            n = self.tokens(s + "\n") if lim.max_tokens is not None else 0
            over_tokens = lim.max_tokens is not None and self.n_tokens + n > lim.max_tokens
            over_count = lim.max_sentences is not None and self.n_sentences + 1 > lim.max_sentences
            over_sections = lim.max_section_breaks is not None and heading and self.n_headings + 1 > lim.max_section_breaks
            if over_tokens or over_count or over_sections:
                if over_tokens:
                    fits, rest = self.fitted(s)
                    if not self.held and not fits and rest:
                        self.held = [self.cut_off(s)]
                        continue
                    self.held.append(fits)
                    if not lim.compat and fits:
                        if not rest:
                            # all of it went onto this chunk
                            self.n_tokens += n
                            continue
                        s, n = rest, self.tokens(rest + "\n")
                out.append(self.turn_over())
            self.held.append(s)
            self.n_tokens += n
            self.n_sentences += 1
            self.n_headings += heading
        if self.held:
            out.append("\n".join(self.held))
        return out


def pack(sentences: list[str], limits: Limits, counter: Counter | None = None) -> list[str]:
    """Chunks of the sentences, as they are before white space is stripped."""
    return Packer(limits, counter).pack(sentences)


@cache
def _alnum() -> np.ndarray:
    """Which characters are letters or digits, by code point."""
    return np.array([chr(c).isalnum() for c in range(0x110000)])


class Finder:
    """Places of chunks in a text: exact, or by letters and digits alone, where the end is then an estimate."""

    def __init__(self, text: str):
        self.text = text
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = np.flatnonzero(_alnum()[codes])
        self.clean = codes[self.at].tobytes().decode("utf-32-le", "surrogatepass")

    def find(self, chunk: str) -> tuple[int, int]:
        core = chunk.strip()
        start = self.text.find(core)
        if start >= 0:
            return start, start + len(core)
        clean = _OTHER.sub("", chunk)
        pos = self.clean.find(clean) if clean else -1
        return (int(self.at[pos]), int(self.at[pos]) + len(clean) + 1) if pos >= 0 else (-1, -1)


def packed_paragraphs(paragraphs: list[str], most: int = 4000, joiner: str = "\n") -> list[str]:
    """Paragraphs put together to sections of at most `most` characters, joiners not counted; a longer paragraph is a section."""
    out: list[list[str]] = []
    size = 0
    for p in paragraphs:
        if not out or size + len(p) > most:
            out.append([])
            size = 0
        out[-1].append(p)
        size += len(p)
    return [joiner.join(s) for s in out]


def _sections(paragraphs: pa.Array, most: int, joiner: str) -> pa.Array:
    """packed_paragraphs of each list: where sections begin is told by lengths, and texts are joined in Arrow, none of them made a string of Python's."""
    flat = paragraphs.flatten()
    if flat.null_count:
        raise TypeError("A paragraph is null")
    lengths = pc.utf8_length(flat).to_numpy(zero_copy_only=False)
    at, begins, rows = 0, [], [0]
    for n in paragraphs.value_lengths().fill_null(0).to_pylist():
        size = most + 1  # the first of a list begins a section
        for k, x in enumerate(lengths[at : at + n].tolist(), at):
            if k == at or size + x > most:
                begins.append(k)
                size = 0
            size += x
        at += n
        rows.append(len(begins))
    sections = pa.ListArray.from_arrays(pa.array([*begins, at], pa.int32()), flat)
    texts = pc.binary_join(sections, pa.scalar(joiner, flat.type)).cast(pa.string())
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), texts, mask=paragraphs.is_null())


def pack_paragraphs(paragraphs: Column, most: int = 4000, joiner: str = "\n") -> Column:
    """The same over a column of arrays."""

    @arrow_udf("array<string>")
    def f(a: pa.Array) -> pa.Array:
        return _sections(a, most, joiner)

    return f.asNondeterministic()(paragraphs)
