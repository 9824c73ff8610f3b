"""Blocks of source code: functions, classes and what stands around them, found line by line without a grammar.

Lines that are part of a comment, doc comment, long string or decorator are tagged first; a scan then
puts lines together to blocks by declarations and indentation, and a stack of indentations gives
each block the path of names that it stands under.
"""

from __future__ import annotations

import ast
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from xml.etree import ElementTree

from ..functions import code_patterns as P
from ..functions.plain import few_breaks

DOCSTRINGS = ("all", "summary", "excluded")
_TAGGED = (("string", P.STRING_ASSIGNED), ("comment", P.WHOLE_LINE_COMMENT), ("comment", P.BLOCK_COMMENT), ("doc", P.DOC_BLOCK), ("doc", P.DOC_LINE), ("decorator", P.DECORATOR))
#: Longer code is parsed, and parted into lines, so many characters at a time.
PIECE = 1 << 16
#: A line that begins a statement where nothing is open: not one that goes on with an if, for or try.
_FRESH = re.compile(r"(?<!\\\n)^([ \t]*)(?!(?:else|elif|except|finally)\b)[A-Za-z_@]", re.M)


@dataclass
class Block:
    content: str
    indent: int
    start_line: int
    end_line: int
    function: str | None
    relations: list[tuple[str, str]] = field(default_factory=list)


def is_python(code: str, path: str | None = None) -> bool:
    """By the path's extension, else by the first line or because it parses, else by a guess at its look."""
    if path:
        return bool(re.search(r"\.py[iwx]?$", path, re.I))
    if re.match(r"\s*#!/usr/bin/(?:env\s+)?python", code):
        return True
    try:
        _parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return bool(re.search(r"^\s*(?:def \w+\(.*\).*:|class \w+.*:|from [\w.]+ import |elif .*:)\s*$", code, re.M)) and not re.search(r"[{};]\s*$", code, re.M)
    return True


def _parse(code: str, piece: int = PIECE) -> None:
    """Raises what ast.parse raises if code isn't Python; long code is parsed a piece after another, as the tree of all takes a hundred times its size.

    A piece that parses leaves nothing open but classes and functions around its last statement. If the next line begins a statement in one of
    these, or in none, the rest is parsed as that class's or function's next statements. A piece that doesn't parse is tried again with more behind it."""
    if len(code) <= piece:
        ast.parse(code)
        return
    code = code.replace("\r\n", "\n").replace("\r", "\n")
    start, size, head, levels, failed = 0, piece, "", None, 0
    while True:
        cut = next((m for m in _FRESH.finditer(code, start + size) if (levels is None or m[1] in levels) and not _goes_on(code, m.start())), None)
        end = cut.start() if cut else len(code)
        text = head + code[start:end]
        try:
            inside = _levels(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            if cut is None:
                raise
            # the next line may do; if a few don't, the piece has to be longer, as inside of a long string
            failed += 1
            size, levels = end - start + 1 if failed % 4 else 2 * (end - start), None
            continue
        if cut is None:
            return
        if cut[1] in inside:
            depth = inside.index(cut[1])
            start, size, head, levels, failed = end, piece, "".join(f"{w}class _:\n" for w in inside[:depth]), None, 0
        elif levels is None:
            size, levels = end - start, inside
        else:
            size, levels = 2 * (end - start), None


def _goes_on(code: str, at: int) -> bool:
    """Whether the line before place at, which starts a line, looks like one that something has to follow."""
    line = code[code.rfind("\n", 0, max(0, at - 1)) + 1 : at].strip()
    return line.startswith("@") or line.endswith((":", ",", "(", "[", "{"))


def _levels(code: str) -> list[str]:
    """Indentation of the classes' and functions' bodies that stand open at the end of code, from the outermost on; raises if it isn't Python."""
    body, out, lines = ast.parse(code).body, [""], code.split("\n")
    while body and isinstance(body[-1], (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
        body = body[-1].body
        n, line = body[0].lineno - 1, lines[body[0].lineno - 1]
        indent = line[: len(line) - len(line.lstrip(" \t"))]
        # not a body on its header's line, nor on one that the header goes on with
        if body[0].col_offset != len(indent) or lines[n - 1].endswith("\\"):
            break
        out.append(indent)
    return out


def each_line(code: str, keepends: bool = False) -> Iterator[str]:
    """code.splitlines(keepends), of which only a part is held at a time."""
    at = 0
    while at < len(code):
        end = code.find("\n", at + PIECE) + 1 or len(code)
        yield from code[at:end].splitlines(keepends)
        at = end


def line_ends(code: str) -> array:
    """Offset at which each line starts, and the length of all as the last."""
    return array("q", accumulate(map(len, each_line(code, True)), initial=0))


def _blanked(m: re.Match) -> str:
    return "\n" * max(0, len(m[0].splitlines()) - 1)


def _block_summary(m: re.Match) -> str:
    opening, text, closing = (next(v for k, v in m.groupdict().items() if v is not None and k.startswith(part)) for part in ("open", "text", "close"))
    first = next((x.strip() for x in text.splitlines() if x.strip()), "")
    return (m["indent"] + opening + first + closing).strip() + _blanked(m)


def _line_summary(m: re.Match) -> str:
    raw = re.sub(rf"^\s*{re.escape(m['mark'])}\s*", "", m[0])
    try:
        found = ElementTree.fromstring(f"<root>{raw}</root>").find("summary")
        text = "" if found is None else ElementTree.tostring(found, encoding="unicode").strip("\n")
    except ElementTree.ParseError:
        found, text = None, ""
    bare = raw.strip()
    if found is None and not (bare[:1] == "<" and bare.find(">") == len(bare) - 1):
        text = bare
    return (f"{m['mark']} {text}" if text else "") + _blanked(m)


def prepared(code: str, comments: bool, docstrings: str) -> str:
    """code without what isn't wanted; its lines keep their numbers."""
    if not comments:
        code = P.BLOCK_COMMENT.sub(_blanked, P.LINE_COMMENT.sub("", code))
    if docstrings == "summary":
        return P.DOC_LINE.sub(_line_summary, P.DOC_BLOCK.sub(_block_summary, code))
    if docstrings == "excluded":
        return P.DOC_LINE.sub(_blanked, P.DOC_BLOCK.sub(_blanked, code))
    return code


def tags(code: str) -> list[str | None]:
    """What each line is part of; what starts on a line that has a tag already doesn't count."""
    begins = line_ends(code)
    out: list[str | None] = [None] * (len(begins) - 1)
    for tag, pattern in _TAGGED:
        pos, marked = 0, array("q")
        while m := pattern.search(code, pos):
            first = bisect_right(begins, m.start()) - 1
            head = bisect_right(begins, m.end() - len(m[0].lstrip())) - 1
            if m.end() == m.start() or first >= len(out) or out[min(head, len(out) - 1)] is not None or out[first] is not None:
                pos = begins[first + 1] if first + 1 < len(begins) else len(code) + 1
                if pos > len(code):
                    break
                continue
            marked.extend((first, bisect_right(begins, m.end() - 1) - 1))
            pos = m.end()
        for a, b in zip(marked[::2], marked[1::2], strict=True):
            out[a : b + 1] = [tag] * (b + 1 - a)
    return out


@dataclass
class _Line:
    number: int
    text: str
    indent: int
    function: str | None


class _Scan:
    """State of one pass over the lines: an open block, tagged lines that wait for one, and the level that the block started on."""

    def __init__(self, python: bool):
        self.python, self.level = python, 0
        self.open: list[_Line] = []
        self.waiting: dict[str, list[_Line]] = {}
        self.blocks: list[Block] = []

    def close(self, lines: list[_Line] | None = None) -> None:
        own = self.open if lines is None else lines
        every = sorted([x for held in self.waiting.values() for x in held] + own, key=lambda x: x.number)
        if not every:
            return
        indent = next((x.indent for x in own if x.text), 0)
        function = next((x.function for x in own if x.function), None)
        self.blocks.append(Block("\n".join(x.text for x in every), indent, every[0].number, every[-1].number, function))
        self.waiting.clear()
        own.clear()

    def tagged(self, tag: str, line: _Line) -> None:
        docs = self.waiting.get("doc")
        goes_on = bool(docs) and docs[-1].number == line.number - 1
        if not goes_on or tag == "decorator" and not self.waiting.get("decorator"):
            self.close()
        self.waiting.setdefault(tag, []).append(line)

    def declaration(self, line: _Line) -> None:
        """Closes the open block where another one is declared."""
        nested = line.indent > self.level
        held = any(x.function for x in self.open)
        if line.function:
            if nested and held:
                return
            if self.waiting.get("decorator") and not held:
                self.level = line.indent
                return
        named = bool(P.NAMESPACE.match(line.text))
        if named and nested or not (named or line.function):
            return
        if self.open:
            # doc comments above a declaration are its own, but in Python they belong to what they stand in
            docs = [] if self.python else self.waiting.pop("doc", [])
            self.close()
            if docs:
                self.waiting["held docs"] = docs
        self.level = line.indent

    def line(self, line: _Line) -> None:
        if self.waiting.get("string"):
            self.close([])
        if not self.open:
            self.open.append(line)
            self.level = line.indent
            return
        self.declaration(line)
        if line.text.strip() and line.indent <= self.level and not P.OPENS.match(line.text) and not P.CLOSES.match(line.text):
            self.level = line.indent
            self.close()
        self.open.append(line)


def _indent(text: str) -> int:
    return len(text) - len(text.lstrip())


def each_block(code: str, comments: bool = True, docstrings: str = "all", python: bool | None = None) -> Iterator[Block]:
    """The blocks of code, in order, each with the chain of names above it; they are given as they are found, and not held."""
    if not code:
        return
    scan = _Scan(is_python(code) if python is None else python)
    code = prepared(code, comments, docstrings)
    above: list[tuple[str, int]] = [("global", -1)]
    for n, (text, tag) in enumerate(zip(each_line(code), tags(code), strict=True), 1):
        if tag:
            scan.tagged(tag, _Line(n, text, _indent(text), None))
        else:
            m = P.FUNCTION.match(text)
            scan.line(_Line(n, text, _indent(text), m[0] if m else None))
        if scan.blocks:
            yield from _related(scan.blocks, above)
            scan.blocks.clear()
    if scan.open or scan.waiting:
        scan.close()
    yield from _related(scan.blocks, above)


def _related(found: list[Block], above: list[tuple[str, int]]) -> Iterator[Block]:
    """Blocks with their chains of names; above: the names that are open, with their indentation."""
    for b in found:
        if b.content.strip():
            while b.indent <= above[-1][1]:
                above.pop()
            if m := P.NAMESPACE.search(b.content):
                above.append((m["name"], b.indent))
            if b.function:
                above.append((b.function.strip(), b.indent))
            b.content = few_breaks(b.content)
        b.relations = [(x[0], y[0]) for x, y in zip(above, above[1:], strict=False)]
        yield b


def blocks(code: str, comments: bool = True, docstrings: str = "all", python: bool | None = None) -> list[Block]:
    """The same as a list."""
    return list(each_block(code, comments, docstrings, python))


def tree(relations: list[tuple[str, str]]) -> str:
    """The names under "global", drawn with lines: each relation once, in the order of their first place. A name isn't drawn below itself."""
    below: dict[str, list[str]] = {}
    for parent, child in dict.fromkeys(relations):
        below.setdefault(parent, []).append(child)
    out = ["global"]
    todo: list[tuple[str, str, str, tuple[str, ...]]] = []

    def inner(name: str, prefix: str, path: tuple[str, ...]) -> None:
        kids = [c for c in below.get(name, []) if c not in path]
        todo.extend((c, prefix, "└─ " if k == len(kids) - 1 else "├─ ", (*path, c)) for k, c in reversed(list(enumerate(kids))))

    inner("global", "", ("global",))
    while todo:
        name, prefix, branch, path = todo.pop()
        out.append(prefix + branch + name)
        inner(name, prefix + ("   " if branch[0] == "└" else "│  "), path)
    return "\n".join(out)
