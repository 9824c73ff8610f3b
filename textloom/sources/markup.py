"""Light markup to text: LaTeX, reStructuredText, RTF, and the clean-up of pages of a paper."""

from __future__ import annotations

import re

from ..functions.plain import few_breaks
from ..functions.text import PAPER

_LEVELS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
_ARGUMENT = r"\{((?:[^{}]|\{[^{}]*\})*)\}"
_SYMBOLS = {"ldots": "…", "dots": "…", "LaTeX": "LaTeX", "TeX": "TeX", "quad": " ", "qquad": "  ", "times": "×", "alpha": "α", "beta": "β", "gamma": "γ", "pi": "π", "infty": "∞", "leq": "≤", "geq": "≥", "neq": "≠", "textbackslash": "\\", "S": "§", "copyright": "©"}


def latex_text(source: str) -> str:
    """Text of a LaTeX document: sections as headings, items as list lines, unknown commands replaced by their last argument."""
    t = re.sub(r"(?<!\\)%.*", "", source)
    if m := re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|\Z)", t, re.S):
        title = re.search(rf"\\title{_ARGUMENT}", t)
        t = (f"{title[1]}\n\n" if title and "\\maketitle" in m[1] else "") + m[1]
    t = re.sub(rf"\\({'|'.join(_LEVELS)})\*?(?:\[[^\]]*\])?{_ARGUMENT}", lambda m: f"\n\n{'#' * _LEVELS[m[1]]} {m[2]}\n\n", t)
    t = re.sub(r"\\item(?:\[([^\]]*)\])?[ \t]*", lambda m: f"\n- {m[1] + ' ' if m[1] else ''}", t)
    t = re.sub(r"\\(?:begin|end)\{\w+\*?\}(?:\[[^\]]*\])?(?:\{[^}]*\})?", "\n", t)
    t = re.sub(rf"\\(?:label|ref|cite\w*|pageref|includegraphics|usepackage|documentclass|bibliography\w*|vspace|hspace)\*?(?:\[[^\]]*\])?{_ARGUMENT}", "", t)
    t = re.sub(r"\\([A-Za-z]+)(?![A-Za-z{])[ \t]?", lambda m: _SYMBOLS.get(m[1], ""), t)
    # commands in commands, from the inside out
    n = 1
    while n:
        t, n = re.subn(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"\\\\(?:\[[^\]]*\])?", "\n", t)
    t = re.sub(r"\\([#$%&_{}])", r"\1", t).replace("~", " ").replace("``", "“").replace("''", "”")
    t = re.sub(r"(?<!\\)[{}]", "", t)
    lines = "\n".join(x.rstrip(" \t") for x in t.split("\n"))
    return few_breaks(lines.replace("§.", "#").replace("§", "#")).strip()


def rst_text(source: str) -> str:
    """Markdown of reStructuredText: headings by the order in which their adornments come up, lists, literals, links, directives' text."""
    lines, out, ranks, k = source.splitlines(), [], {}, 0

    def adorns(x: str) -> bool:
        return bool(re.fullmatch(r"([=\-`:'\"~^_*+#<>.])\1{2,}\s*", x))

    def heading(text: str, style: str) -> None:
        level = ranks.setdefault(style, len(ranks) + 1)
        out.extend(["", "#" * min(level, 6) + " " + text.strip(), ""])

    while k < len(lines):
        x = lines[k]
        if adorns(x) and k + 2 < len(lines) and adorns(lines[k + 2]) and lines[k + 1].strip():
            heading(lines[k + 1], "o" + x[0])
            k += 3
            continue
        if x.strip() and k + 1 < len(lines) and adorns(lines[k + 1]) and not adorns(x) and len(lines[k + 1].strip()) >= min(3, len(x.strip())):
            heading(x, lines[k + 1][0])
            k += 2
            continue
        if adorns(x):
            out.extend(["", "---", ""])
        elif m := re.match(r"\s*\.\. (?:image|figure):: (\S+)", x):
            out.append(f"![]({m[1]})")
        elif re.match(r"\s*\.\. (?:code|code-block|sourcecode|literalinclude)::", x):
            pass
        elif m := re.match(r"\s*\.\. [\w-]+::\s*(.*)", x):
            out.append(m[1])
        elif re.match(r"\s*\.\.(?:\s|$)", x):
            pass
        elif not re.match(r"\s+:[\w-]+:.*$", x):
            out.append(re.sub(r"::\s*$", ":", x))
        k += 1
    t = "\n".join(out)
    t = re.sub(r"``(.+?)``", r"`\1`", t)
    t = re.sub(r"`([^`<]+?)\s*<([^>`]+)>`__?", r"[\1](\2)", t)
    t = re.sub(r":[\w:-]+:`([^`]+)`", r"\1", t)
    t = re.sub(r"^(\s*)[*+•] ", r"\1- ", t, flags=re.M)
    return few_breaks(t).strip()


_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})?[ ]?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.I | re.S)
_DESTINATIONS = set("fonttbl colortbl datastore themedata stylesheet info picture pict object header headerl headerr headerf footer footerl footerr footerf listtable listoverridetable rsidtbl generator xmlnstbl latentstyles mmathPr filetbl revtbl pgptbl colorschememapping".split())
_RTF_CHARS = {"par": "\n", "sect": "\n\n", "page": "\n\n", "line": "\n", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "cell": "|", "row": "\n", "emspace": " ", "enspace": " "}


def rtf_text(source: str) -> str:
    """Text of RTF: groups that don't hold text are left out, characters are decoded by the Windows code page or as Unicode."""
    out: list[str] = []
    stack: list[tuple[int, bool]] = []
    width, skipped, pending = 1, False, 0
    for m in _RTF.finditer(source):
        word, number, code, symbol, brace, char = m.groups()
        if brace == "{":
            stack.append((width, skipped))
        elif brace == "}":
            if stack:
                width, skipped = stack.pop()
            pending = 0
        elif symbol:
            if symbol == "*":
                skipped = True
            elif symbol == "~":
                out.append("" if skipped else " ")
            elif symbol in "{}\\" and not skipped:
                out.append(symbol)
        elif word:
            if word in _DESTINATIONS:
                skipped = True
            elif skipped:
                continue
            elif word in _RTF_CHARS:
                out.append(_RTF_CHARS[word])
            elif word == "uc":
                width = int(number or 1)
            elif word == "u" and number:
                out.append(chr(int(number) % 0x10000))
                pending = width
        elif code:
            if pending:
                pending -= 1
            elif not skipped:
                out.append(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif char:
            if pending:
                pending -= 1
            elif not skipped:
                out.append(char)
    # code points beyond the basic plane come in halves
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip()


_PAPER = [(re.compile(p.replace(r"\p{Nd}", r"\d").replace(r"\p{L}\p{N}_", r"\w")), to.replace("$", "\\")) for p, to in PAPER]


def paper_text(text: str) -> str:
    """The clean-up of a paper's pages for one text."""
    for pattern, to in _PAPER:
        text = pattern.sub(to, text)
    return text
