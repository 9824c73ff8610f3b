"""Sentences, clauses and cleaning, as Catalyst expressions.

Patterns spell out white space, as Java's classes are ASCII. Parts of a text that must not be
split are protected by moving their terminators and line breaks to private-use characters
and back again afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .languages import ABBREVIATIONS, CLOSED_UP, abbreviation_pattern, closed_up_pattern
from .terminators import CLAUSE_MARKS, TERMINATORS

WS = r"\s\x0b\x1c-\x1f\x85   -     　"
BREAKS = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]"
# ASCII first: most characters need no look at the long rest
_FAR = r"[[^\x00-\x7f]&&[" + "".join(c for c in TERMINATORS if c > "\x7f") + "]]"
TERM = r"[.!?]|" + _FAR
TERM_COLON = r"[.!?:]|" + _FAR
#: Characters that stand for protected ones, and the mark of a boundary.
BOUNDARY = ""
_SECRET_FROM = TERMINATORS + ":\n\r\x0b\f\x1c\x1d\x1e\x85   \t"
_SECRET_TO = "".join(chr(0xF100 + k) for k in range(len(_SECRET_FROM)))

_QUOTES = "«‘‛“‟‹⸂⸄⸉⸌⸜⸠'\""
#: A quotation or a bracketed run, the shortest from its opening on, across lines.
PROTECTED = "(?s)(?:" + "|".join(rf"{q}.+?[\p{{Pf}}{q}]" for q in _QUOTES) + r"|\p{Ps}.+?\p{Pe})"
LIST_MARKER = rf"[\n:][{WS}]*\p{{N}}\."
_ABBREVIATION = r"(?<!(?<![\p{L}\p{N}_])\p{Lu}\p{Ll}{1,4}\.)"
#: A letter that a sentence may begin with.
BEGINNING = r"[\p{Lo}\p{Lt}\p{Lu}]"
#: Terminators, with ASCII decided by a look into a table (single characters in a class are, ranges and the rest are tried one by one).
_COLON_CLASS = r"[.!?:" + _FAR + "]"
_ASCII_BREAK = r"\n\r\x0b\f\x1c\x1d\x1e\x85"
_FAR_BREAK = "  "
_FAR_TERMS = "".join(c for c in TERMINATORS if c > "\x7f")


def _ends(terminators: str, far: str) -> str:
    """Pattern of a sentence's or a line's last character: a terminator, not after a short capitalised word, before what may begin a sentence, with the white space between; or a line break."""
    return rf"([{terminators}{_ASCII_BREAK}{far}])(?:(?<=[{_ASCII_BREAK}{_FAR_BREAK}])|{_ABBREVIATION}(?:[{WS}]+(?={BEGINNING})|[{WS}]*\n[{WS}]*|[{WS}]*$))"


SENTENCE_END = _ends(".!?", rf"[[^\x00-\x7f]&&[{_FAR_BREAK}{_FAR_TERMS}]]")
#: For texts without terminators and line breaks beyond the first rows of the first plane. One range is told quickly; typographic marks in it are told apart only where it was met.
_NEAR_SENTENCE_END = _ends(".!?", "")
_FAR_SIGNS = (r"[^\x00-ֈ]", r"[^\x00-ֈ‐-‣‥-‧‪-※]")
#: What a text with a protected part or a list number has; others may have it too.
_OPENING = r"['\"(\[{«[^\x00-༹]]"
_NUMBERED = r"\p{N}\."

THEMATIC_BREAK = rf"[{WS}]*(?:-[{WS}]*-{{2,}}|\*[{WS}]*\*{{2,}}|_[{WS}]*_{{2,}})[{WS}]*"
SECTION_BREAK = (
    rf"(?i)^[{WS}]*(?:#{{1,6}}[{WS}]+[^\n]|(?:-[{WS}]*-{{2,}}|\*[{WS}]*\*{{2,}}|_[{WS}]*_{{2,}})[{WS}]*(?:\n|$)"
    r"|</?(?:article|details|section|summary)\b[^>]*>|<hr" + rf"[{WS}]*/?>)"
)
CLAUSE_END = rf"(?<=[{CLAUSE_MARKS}])[{WS}]"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once, however often f uses it: columns that are only named twice are also computed twice."""
    return F.transform(F.array(c), f)[0]


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def strip(c: Column) -> Column:
    """c without white space, of any script, at either end."""
    space = f"[{WS}]"
    return let(c, lambda t: F.when(F.left(t, F.lit(1)).rlike(space) | F.right(t, F.lit(1)).rlike(space), _sub(t, f"^[{WS}]+|[{WS}]+$", "")).otherwise(t))


def rstrip(c: Column) -> Column:
    return let(c, lambda t: F.when(F.right(t, F.lit(1)).rlike(f"[{WS}]"), _sub(t, f"[{WS}]+$", "")).otherwise(t))


def _moved(t: Column, pattern: str | Column, inside: Column) -> Column:
    """t with what is protected in the pattern's matches, which are given, moved out of the way."""
    return F.array_join(F.zip_with(F.split(t, pattern, -1), inside, lambda a, b: F.concat(a, F.coalesce(F.translate(b, _SECRET_FROM, _SECRET_TO), F.lit("")))), "")


def _protect(c: Column, pattern: str, sign: str) -> Column:
    """Terminators, colons and white space inside the pattern's matches, moved out of the way; sign: what a text with a match has, which is told sooner."""

    def tried(t: Column) -> Column:
        return let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda inside: F.when(F.size(inside) == 0, t).otherwise(_moved(t, pattern, inside)))

    return let(c, lambda t: F.when(t.rlike(sign), tried(t)).otherwise(t))


def _reveal(c: Column) -> Column:
    return F.translate(c, _SECRET_TO, _SECRET_FROM)


def _by_language(code: str | Column, pattern: Callable[[str, str], str | None], codes: Iterable[str]) -> Column | None:
    """The pattern for a code, as a column: null for languages that have none; None if the code is known to have none."""
    if isinstance(code, str):
        p = pattern(code, WS)
        return None if p is None else F.lit(p)
    out = F.lit(None).cast("string")
    for k in codes:
        out = F.when(code == k, F.lit(pattern(k, WS))).otherwise(out)
    return out


def _for_language(t: Column, code: str | Column) -> Column:
    """A protected text with a language's abbreviations protected too, and with line breaks where its sentences end without white space."""
    abbreviations = _by_language(code, abbreviation_pattern, ABBREVIATIONS)
    if abbreviations is not None:
        t = let(F.struct(t.alias("t"), abbreviations.alias("p")), lambda x: F.when(x["p"].isNull() | ~F.rlike(x["t"], x["p"]), x["t"]).otherwise(_moved(x["t"], x["p"], F.regexp_extract_all(x["t"], x["p"], F.lit(0)))))
    closed = _by_language(code, closed_up_pattern, CLOSED_UP)
    if closed is not None:
        t = let(F.struct(t.alias("t"), closed.alias("p")), lambda x: F.when(x["p"].isNull(), x["t"]).otherwise(F.regexp_replace(x["t"], x["p"], F.lit("$1\n"))))
    return t


def _lines(text: Column, code: str | Column = "fallback") -> Column:
    """Sentences and lines as they are cut, blank ones among them."""
    flat = let(strip(text), lambda t: F.when(t.rlike(_NUMBERED), _sub(t, rf"({_COLON_CLASS})[{WS}]+(?:\p{{N}}\.)*(\p{{N}}\.)", "$1\n $2")).otherwise(t))
    t = strip(_for_language(_protect(_protect(flat, PROTECTED, _OPENING), LIST_MARKER, _NUMBERED), code))
    at = lambda t, pattern: F.split(_sub(t, pattern, f"$1{BOUNDARY}"), BOUNDARY, -1)
    cut = lambda t: F.when(t.rlike(_FAR_SIGNS[0]) & t.rlike(_FAR_SIGNS[1]), at(t, SENTENCE_END)).otherwise(at(t, _NEAR_SENTENCE_END))
    return let(t, lambda t: F.when(t.rlike(f"[{_SECRET_TO[0]}-{_SECRET_TO[-1]}]"), F.transform(cut(t), _reveal)).otherwise(cut(t)))


def raw_sentences(text: Column) -> Column:
    """The universal splitter: array of sentences, blank ones left out; null for null.

    A flattened numbered list is put on lines of its own, quotations and brackets aren't split, list
    numbers stay with the line before, and a sentence ends at a terminator before a capital or uncased letter or a
    line's end, unless a capitalised word of two to five letters stands before the dot."""
    return F.filter(_lines(text), lambda s: s.rlike(f"[^{WS}]"))


def clean_sentences(sentences: Column) -> Column:
    """Blank sentences go; one of punctuation alone is added to the one before (its first five characters), or, in front, kept with its first two; thematic breaks stay; white space at the end goes."""
    no_word = r"^[^\p{L}\p{N}_]+$"

    def marked(s: Column, i: Column) -> Column:
        def mark(core: Column) -> Column:
            only = core.rlike(no_word) & ~core.rlike(f"^{THEMATIC_BREAK}$")
            return F.when(~only, F.concat(F.lit(BOUNDARY), rstrip(s))).when(i == 0, F.concat(F.lit(BOUNDARY), F.left(core, F.lit(2)))).otherwise(F.left(core, F.lit(5)))

        return let(strip(s), mark)

    def cleaned(kept: Column) -> Column:
        # without any, the text joined is empty, and has no boundary to split at
        joined = F.slice(F.split(F.array_join(F.transform(kept, marked), ""), BOUNDARY, -1), 2, 1 << 30)
        return F.when(F.exists(kept, lambda s: s.rlike(no_word)), joined).otherwise(F.transform(kept, rstrip))

    return let(F.filter(sentences, lambda s: s.rlike(f"[^{WS}]")), cleaned)


def sentences(text: Column, code: str | Column = "fallback") -> Column:
    """Cleaned sentences of a text by the universal splitter, with what the language of the code needs besides; an empty text has none."""
    return F.when(text.rlike(f"[^{WS}]"), clean_sentences(_lines(text, code))).when(text.isNotNull(), F.array().cast("array<string>"))


def clauses(sentence: Column) -> Column:
    """Parts of a sentence, cut at one white-space character after clause punctuation."""
    return F.split(sentence, CLAUSE_END, -1)


def is_section_break(sentence: Column) -> Column:
    """Whether a sentence is a heading, a thematic break, a sectioning tag or a horizontal rule."""
    return sentence.rlike(SECTION_BREAK)


def is_thematic_break(sentence: Column) -> Column:
    return sentence.rlike(f"^{THEMATIC_BREAK}$")


def word_tokens(text: Column) -> Column:
    """Number of words between white space; 0 for blank text."""
    return F.when(text.rlike(f"[^{WS}]"), F.size(F.split(strip(text), f"[{WS}]+", -1))).when(text.isNotNull(), F.lit(0))


def alnum(text: Column) -> Column:
    """Letters and numbers alone."""
    return _sub(text, r"[^\p{L}\p{N}]", "")


def collapse_newlines(text: Column) -> Column:
    """Three or more line breaks made two."""
    return _sub(text, "\n{3,}", "\n\n")


def long_link(longest: int) -> str:
    """Pattern of a Markdown link or image whose address is longer than that: what is before the address, and as much of it as stays."""
    return rf"(!?\[[^\]]*\])\(([^\n)]{{{longest - 3}}})[^\n)]{{4,}}\)"


def truncate_urls(text: Column, longest: int = 150) -> Column:
    """Addresses of Markdown links and images cut to `longest` characters, the last three of them dots."""
    return _sub(text, long_link(longest), r"$1($2...)")


_NUMBER = r"\p{Nd}+"
#: Patterns and what they become, in this order: blank lines collapsed, list markers joined to their lines, lines of a number alone and page labels dropped.
PAPER = (
    (rf"(?:\n[{WS}]*){{2,}}", "\n"),
    (r"(\n[\p{L}\p{N}_][)*.\-])\n", "$1 "),
    (rf"\n[{WS}]*{_NUMBER}[{WS}]*\n", ""),
    ("|".join((rf"Page {_NUMBER} of {_NUMBER}[^\n]*", rf"-[{WS}]*{_NUMBER}[{WS}]*-", rf"[{WS}]*\|[{WS}]*Page[{WS}]+{_NUMBER}[{WS}]*\|[{WS}]*")), ""),
)


def paper_cleanup(text: Column) -> Column:
    """What the pages of a paper need."""
    for pattern, to in PAPER:
        text = _sub(text, pattern, to)
    return text


def latex_cleanup(text: Column) -> Column:
    """Section signs made heading marks, line breaks in a row made two."""
    return _sub(_sub(strip(text), r"§\.?", "#"), "\n{2,}", "\n\n")


def extension(path: Column) -> Column:
    """Lower-case extension of a path with its dot, or an empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def looks_like_path(text: Column) -> Column:
    """Whether a text may be a path: no line breaks or NULs, not too long, and made of names with separators or an extension."""
    return (F.length(text) > 0) & (F.length(text) <= 4096) & ~text.rlike("[\n\r\\x00]") & text.rlike(r"^(?:[A-Za-z]:)?[\\/~.]?(?:[^<>:\"|?*\\/]+[\\/])*[^<>:\"|?*\\/]*\.[\p{L}\p{N}_]{1,10}$|^(?:[A-Za-z]:[\\/]|~?[\\/]|\.{1,2}[\\/])[^<>:\"|?*]*$")


def table_row(cells: list[Column]) -> Column:
    """One row of a Markdown table, pipes escaped; null cells print as None."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(c.cast("string"), F.lit("None")), F.lit("|"), F.lit("\\|")) for c in cells]), F.lit(" |"))
