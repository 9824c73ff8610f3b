"""The text functions once more, as DuckDB SQL, to hold the queries against.

DuckDB's patterns have no look-around: what is protected is moved to private-use characters first,
boundaries are marked, and then the text is split at the marks.
"""

from __future__ import annotations

from ..functions import text as T
from ..functions.terminators import CLAUSE_MARKS, TERMINATORS
from ..operators.detect import COMMON, SCRIPTS

_ESCAPES = {r"\x0b": r"\x0B", r"\x1c-\x1f": r"\x1C-\x1F", r"\x85": r"\x{85}"}
WS = r"\s\x0B\x1C-\x1F\x{85}" + T.WS.split(r"\x85")[1]
_ABBREVIATED = chr(0xF0FF)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {to if to.startswith('CAST') or '||' in to else lit(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^[{WS}]+|[{WS}]+$", "")


def rstrip(x: str) -> str:
    return sub(x, f"[{WS}]+$", "")


def _protect(x: str, pattern: str) -> str:
    p = lit(pattern.replace(T.WS, WS))
    inside = f"translate(regexp_extract_all(t, {p})[k], {lit(T._SECRET_FROM)}, {lit(T._SECRET_TO)})"
    return f"(SELECT list_aggregate([s || coalesce({inside}, '') FOR s, k IN regexp_split_to_array(t, {p})], 'string_agg', '') FROM (SELECT {x} AS t))"


def raw_pieces(text: str) -> str:
    """List of pieces between sentence ends, with what is protected still moved."""
    t = sub(strip(text), rf"([{TERMINATORS}:])[{WS}]+(?:\p{{N}}\.)*(\p{{N}}\.)", "\\1\n \\2")
    t = strip(_protect(_protect(t, T.PROTECTED), T.LIST_MARKER))
    t = sub(t, r"(^|[^\p{L}\p{N}_])(\p{Lu}\p{Ll}{1,4})\.", rf"\1\2{_ABBREVIATED}")
    t = sub(t, rf"([{TERMINATORS}])([{WS}]+{T.BEGINNING}|[{WS}]*\n|[{WS}]*$)", rf"\1{T.BOUNDARY}\2")
    return f"string_split({t}, {lit(T.BOUNDARY)})"


def clean(sentences: str) -> str:
    """Cleaned list of a list of sentences."""
    core = strip("s")
    thematic = T.THEMATIC_BREAK.replace(T.WS, WS)
    only = f"(regexp_full_match({core}, {lit(r'[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')}) AND NOT regexp_full_match({core}, {lit(thematic)}))"
    marked = f"CASE WHEN NOT {only} THEN {lit(T.BOUNDARY)} || {rstrip('s')} WHEN k = 1 THEN {lit(T.BOUNDARY)} || left({core}, 2) ELSE left({core}, 5) END"
    return f"(SELECT CASE WHEN len(kept) = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split(list_aggregate([{marked} FOR s, k IN kept], 'string_agg', ''), {lit(T.BOUNDARY)})[2:] END FROM (SELECT [s FOR s IN {sentences} IF regexp_matches(s, {lit('[^' + WS + ']')})] AS kept))"


def sentences(text: str) -> str:
    """Cleaned list of sentences of a text."""
    lines = f"flatten([regexp_split_to_array({strip('p')}, {lit(T.BREAKS.replace(chr(92) + 'x85', chr(92) + 'x{85}'))}) FOR p IN {raw_pieces(text)}])"
    reveal = f"[translate(s, {lit(T._SECRET_TO + _ABBREVIATED)}, {lit(T._SECRET_FROM + '.')}) FOR s IN {lines}]"
    return clean(reveal)


def section_break(s: str) -> str:
    return f"regexp_matches({s}, {lit(T.SECTION_BREAK.replace(T.WS, WS))})"


def clauses(s: str) -> str:
    return f"string_split({sub(s, rf'([{CLAUSE_MARKS}])[{WS}]', chr(92) + '1' + T.BOUNDARY)}, {lit(T.BOUNDARY)})"


def word_tokens(s: str) -> str:
    return f"CASE WHEN regexp_matches({s}, {lit('[^' + WS + ']')}) THEN len(regexp_split_to_array({strip(s)}, {lit('[' + WS + ']+')})) ELSE 0 END"


def detected(text: str) -> str:
    """doc_id, code, confidence of the documents' texts."""
    words = f"string_split(trim(lower(regexp_replace({text}, {lit('[^' + chr(92) + 'p{L}]+')}, ' ', 'g'))), ' ')"
    scores = [f"{{'s': CAST(len(list_filter(words, lambda w: w IN ({', '.join(lit(w) for w in common.split())}))) AS DOUBLE), 'k': {lit(k)}}}" for k, common in COMMON.items()]
    scores += [f"{{'s': len(regexp_extract_all(letters, {lit(p)})) / {20.0 if k == 'zh' else 2.0}, 'k': {lit(k)}}}" for k, p in SCRIPTS.items()]
    return f"""SELECT doc_id, CASE WHEN total = 0 THEN 'und' ELSE best.k END AS code, CASE WHEN total = 0 THEN 0 ELSE best.s * best.s / total END AS confidence
FROM (SELECT doc_id, list_max(every) AS best, list_sum([x.s * x.s FOR x IN every]) AS total FROM (SELECT doc_id, [{', '.join(scores)}] AS every FROM (SELECT doc_id, {words} AS words, lower({text}) AS letters FROM documents)))"""


SENTENCE_TABLE = f"""docs AS (SELECT doc_id, lang, text, {sentences('text')} AS s FROM documents),
sents AS (SELECT doc_id, lang, text, unnest(s) AS sentence, CAST(generate_subscripts(s, 1) AS INTEGER) AS sent_num FROM docs)"""
