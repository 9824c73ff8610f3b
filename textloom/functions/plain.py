"""What the column expressions do, once more in Python for single texts outside of a plan: above all the universal sentence splitter."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left

from .terminators import TERMINATORS

_TERMS = frozenset(TERMINATORS)
_SPACE = re.compile(r"\s*")
_GAP = re.compile("\n\n\n+")
_OPEN = "«‘‛“‟‹⸂⸄⸉⸌⸜⸠'\""
_MOVED = {c: chr(0xF100 + k) for k, c in enumerate(TERMINATORS + ":\n\r\x0b\f\x1c\x1d\x1e\x85   \t")}
_BACK = str.maketrans({v: k for k, v in _MOVED.items()})
_OUT = str.maketrans(_MOVED)
_FLAT = re.compile(rf"(?<=[{re.escape(TERMINATORS)}:])\s+(?:\d\.)*(\d\.)")
_MARKER = re.compile(r"[\n:]\s*\d\.")
_SHORT = re.compile(r"(?:^|[^\w])([^\W\d_]{2,5})\.$")
_RULE = re.compile(r"\s*(?:-\s*-{2,}|\*\s*\*{2,}|_\s*_{2,})\s*")


def few_breaks(text: str) -> str:
    """Three or more line breaks made two."""
    return _GAP.sub("\n\n", text)


def _protected(text: str) -> str:
    places: dict[str, list[int]] = {"Pe": [], "Pf": []}
    for k, c in enumerate(text):
        if c in _OPEN:
            places.setdefault(c, []).append(k)
        if (kind := unicodedata.category(c)) in places:
            places[kind].append(k)

    def closing(kinds: tuple[str, ...], k: int) -> int:
        """The first of what closes, from place k on, or -1."""
        found = [p[i] for p in (places.get(x, []) for x in kinds) if (i := bisect_left(p, k)) < len(p)]
        return min(found, default=-1)

    out, k = [], 0
    while k < len(text):
        c, end = text[k], -1
        if c in _OPEN:
            end = closing((c, "Pf"), k + 2)
        elif unicodedata.category(c) == "Ps":
            end = closing(("Pe",), k + 2)
        if end < 0:
            out.append(c)
            k += 1
        else:
            out.append(text[k : end + 1].translate(_OUT))
            k = end + 1
    return "".join(out)


def _ends(text: str, k: int) -> bool:
    """Whether a sentence ends before place k."""
    if k == 0 or text[k - 1] not in _TERMS:
        return False
    at = _SPACE.match(text, k).end()
    if not (at == len(text) or "\n" in text[k:at] or at > k and (text[at].isupper() or unicodedata.category(text[at]) in ("Lo", "Lt"))):
        return False
    m = _SHORT.search(text[max(0, k - 7) : k])
    return not (m and m[1][0].isupper() and m[1][1:].islower())


def plain_sentences(text: str) -> list[str]:
    """Cleaned sentences of one text."""
    t = _FLAT.sub(r"\n \1", text.strip())
    t = _MARKER.sub(lambda m: m[0].translate(_OUT), _protected(t)).strip()
    cuts = [0, *(k for k in range(1, len(t)) if t[k - 1] in _TERMS and _ends(t, k)), len(t)]
    out: list[str] = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        for line in t[a:b].strip().splitlines():
            s = line.translate(_BACK).rstrip()
            core = s.strip()
            if not core:
                continue
            if not re.fullmatch(r"\W+", core) or _RULE.fullmatch(core):
                out.append(s)
            elif out:
                out[-1] += core[:5]
            else:
                out.append(core[:2])
    return out
