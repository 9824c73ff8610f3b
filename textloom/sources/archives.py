"""Sections and metadata of zipped office formats and books: docx, odt, epub, pptx, xlsx."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree as ET
from xml.parsers import expat

from ..errors import FileProcessingError
from ..operators.packing import packed_paragraphs
from ..operators.tables import table_text
from .html import to_markdown

#: A member of more bytes is an error: it is taken for an attack.
LARGEST_MEMBER = 1 << 30


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


class _Root(Exception):
    """The root element begins: nothing is declared any more."""


def _refuse_entities(raw: bytes, name: str) -> None:
    """An error if a document declares entities; they stand before its root, wherever that is."""

    def declared(*_) -> None:
        raise FileProcessingError(f"{name} declares entities")

    def root(*_) -> None:
        raise _Root

    parser = expat.ParserCreate()
    parser.EntityDeclHandler, parser.StartElementHandler = declared, root
    try:
        parser.Parse(raw, True)
    except _Root:
        pass


class Archive:
    def __init__(self, content: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as e:
            raise FileProcessingError(f"Not a zip archive: {e}") from e
        self.names = set(self.zip.namelist())

    def read(self, name: str) -> bytes:
        if name not in self.names:
            raise FileProcessingError(f"The archive has no {name}")
        if self.zip.getinfo(name).file_size > LARGEST_MEMBER:
            raise FileProcessingError(f"{name} is too large")
        return self.zip.read(name)

    def xml(self, name: str) -> ET.Element:
        raw = self.read(name)
        try:
            _refuse_entities(raw, name)
            return ET.fromstring(raw)
        except (ET.ParseError, expat.ExpatError) as e:
            raise FileProcessingError(f"{name} isn't XML: {e}") from e

    def related(self, part: str) -> dict[str, str]:
        """Targets of a part's relations by id."""
        folder, base = posixpath.split(part)
        rels = f"{folder}/_rels/{base}.rels"
        if rels not in self.names:
            return {}
        return {r.get("Id", ""): posixpath.normpath(posixpath.join(folder, r.get("Target", ""))) if not r.get("Target", "").startswith("/") else r.get("Target", "")[1:] for r in self.xml(rels)}


def _properties(a: Archive, keys: dict[str, str], name: str = "docProps/core.xml") -> dict[str, str]:
    if name not in a.names:
        return {}
    found = {_name(e): (e.text or "").strip() for e in a.xml(name).iter()}
    return {key: found[n] for n, key in keys.items() if found.get(n)}


# --- docx


def _word_runs(p: ET.Element, images: list[int], links: dict[str, str]) -> str:
    out = []
    for x in p:
        kind = _name(x)
        if kind in ("ins", "smartTag", "sdt", "sdtContent", "fldSimple"):
            out.append(_word_runs(x, images, links))
        elif kind == "hyperlink":
            text, to = _word_runs(x, images, links), links.get(_attr(x, "id") or "")
            out.append(f"[{text}]({to})" if to and text else text)
        elif kind == "r":
            text = ""
            for y in x.iter():
                n = _name(y)
                if n == "t":
                    text += y.text or ""
                elif n in ("br", "cr"):
                    text += "\n"
                elif n == "tab":
                    text += "\t"
                elif n in ("drawing", "pict"):
                    images[0] += 1
                    text += f"[Image - {images[0]}]"
            style = {_name(y): _attr(y, "val") for rpr in x if _name(rpr) == "rPr" for y in rpr}
            for key, mark in (("i", "*"), ("b", "**")):
                if key in style and style[key] not in ("0", "false") and text.strip():
                    text = text.replace(text.strip(), f"{mark}{text.strip()}{mark}", 1)
            out.append(text)
    return "".join(out)


def docx(content: bytes) -> tuple[list[str], dict[str, str]]:
    """Paragraphs as Markdown, packed to sections of at most 4,000 characters."""
    a = Archive(content)
    body = next((x for x in a.xml("word/document.xml") if _name(x) == "body"), None)
    images, links, parts = [0], a.related("word/document.xml"), []

    def paragraph(p: ET.Element) -> str:
        text = _word_runs(p, images, links).strip()
        props = [y for x in p if _name(x) == "pPr" for y in x]
        style = next((_attr(x, "val") or "" for x in props if _name(x) == "pStyle"), "")
        if text and (m := re.fullmatch(r"(?:Heading|heading ?)([1-6])|(Title)", style)):
            return "#" * int(m[1] or 1) + " " + text
        return f"* {text}" if text and any(_name(x) == "numPr" for x in props) else text

    def walk(e: ET.Element) -> None:
        for x in e:
            if _name(x) == "p":
                if t := paragraph(x):
                    parts.append(t)
            elif _name(x) == "tbl":
                rows = [[" ".join(filter(None, (paragraph(p) for p in c.iter() if _name(p) == "p"))) for c in r if _name(c) == "tc"] for r in x if _name(r) == "tr"]
                if any(rows):
                    parts.append(table_text(rows).strip())
            elif _name(x) in ("sdt", "sdtContent"):
                walk(x)

    if body is not None:
        walk(body)
    keys = {"title": "title", "creator": "author", "publisher": "publisher", "lastModifiedBy": "last_modified_by", "created": "created", "modified": "modified", "rights": "rights", "version": "version"}
    return packed_paragraphs(parts, joiner="\n\n"), _properties(a, keys)


# --- odt


def odt(content: bytes) -> tuple[list[str], dict[str, str]]:
    """Text nodes of paragraphs themselves, without what stands in spans; blank ones are left out."""
    a = Archive(content)
    parts = []
    for p in a.xml("content.xml").iter():
        if _name(p) == "p":
            text = (p.text or "") + "".join(x.tail or "" for x in p)
            if text.strip():
                parts.append(text)
    keys = {"title": "title", "creator": "author", "initial-creator": "creator", "creation-date": "created", "chapter": "chapter", "author-name": "authorname"}
    return packed_paragraphs(parts), _properties(a, keys, "meta.xml")


# --- epub

_BOOK_KEYS = frozenset("contributor creator date publisher rights title".split())


def epub(content: bytes) -> tuple[list[str], dict[str, str]]:
    """A section for each item of the spine."""
    a = Archive(content)
    root = next((x.get("full-path") for x in a.xml("META-INF/container.xml").iter() if _name(x) == "rootfile"), None)
    if not root:
        raise FileProcessingError("The book has no package file")
    package, folder = a.xml(root), posixpath.dirname(root)
    items, order, meta = {}, [], {}
    for x in package.iter():
        if _name(x) == "item":
            items[x.get("id")] = posixpath.normpath(posixpath.join(folder, unquote(x.get("href", ""))))
        elif _name(x) == "itemref":
            order.append(x.get("idref"))
        elif _name(x) in _BOOK_KEYS and (x.text or "").strip():
            meta.setdefault(_name(x), []).append(x.text.strip())
    sections = []
    for k in order:
        if (name := items.get(k)) in a.names:
            page = a.read(name).decode("utf-8", "replace")
            body = re.search(r"<body[^>]*>(.*)</body>", page, re.S | re.I)
            sections.append(to_markdown(body[1] if body else page).strip())
    return sections, {k: ", ".join(v) for k, v in meta.items()}


# --- pptx


def _paragraphs(shape: ET.Element) -> Iterator[tuple[int, str]]:
    for p in shape.iter():
        if _name(p) == "p":
            level = next((int(_attr(x, "lvl") or 0) for x in p if _name(x) == "pPr"), 0)
            text = "".join(t.text or "" for t in p.iter() if _name(t) == "t").strip()
            if text:
                yield level, text


def _chart(root: ET.Element) -> str:
    """Categories and a column for each series; missing values are empty."""

    def points(e: ET.Element) -> dict[int, str]:
        return {int(p.get("idx", 0)): next((v.text or "" for v in p if _name(v) == "v"), "") for p in e.iter() if _name(p) == "pt"}

    names, columns, categories = [], [], {}
    for s in root.iter():
        if _name(s) == "ser":
            part = {_name(x): x for x in s}
            names.append(next(iter(points(part["tx"]).values()), "") if "tx" in part else "")
            columns.append(points(part["val"]) if "val" in part else {})
            categories = categories or (points(part["cat"]) if "cat" in part else {})
    size = max([*categories, *(k for c in columns for k in c)], default=-1) + 1
    return table_text([["Categories", *names], *([categories.get(k, ""), *(c.get(k, "") for c in columns)] for k in range(size))]) if names else ""


def pptx(content: bytes) -> tuple[list[str], dict[str, str]]:
    """A section for each slide: number, title, tables, charts, bullets, notes."""
    a = Archive(content)
    links = a.related("ppt/presentation.xml")
    slides = [links[i] for x in a.xml("ppt/presentation.xml").iter() if _name(x) == "sldId" and (i := next((v for k, v in x.attrib.items() if k.endswith("}id")), None)) in links]
    sections = []
    for n, name in enumerate(slides, 1):
        root, own, out = a.xml(name), a.related(name), [f"<!-- Slide number: {n} -->"]
        title, body = None, []
        for shape in root.iter():
            kind = _name(shape)
            if kind == "sp":
                holder = next((_attr(x, "type") or "body" for x in shape.iter() if _name(x) == "ph"), "")
                if holder in ("ftr", "hdr", "sldNum", "dt"):
                    continue
                if holder in ("title", "ctrTitle") and title is None:
                    title = " ".join(t for _, t in _paragraphs(shape))
                    continue
                body += ["  " * level + "- " + t for level, t in _paragraphs(shape)]
            elif kind == "graphicFrame":
                for x in shape.iter():
                    if _name(x) == "tbl":
                        rows = [[" ".join(t for _, t in _paragraphs(c)) for c in r if _name(c) == "tc"] for r in x if _name(r) == "tr"]
                        body.append(table_text(rows) if rows else "")
                    elif _name(x) == "chart" and own.get(_attr(x, "id") or "") in a.names:
                        body.append(_chart(a.xml(own[_attr(x, "id")])))
        if title and not title.strip().isdigit():
            out.append(f"# {title}")
        out += [b for b in body if b]
        notes = next((p for p in own.values() if "notesSlide" in p and p in a.names), None)
        if notes:
            said = [t for s in a.xml(notes).iter() if _name(s) == "sp" and next((_attr(x, "type") for x in s.iter() if _name(x) == "ph"), None) == "body" for _, t in _paragraphs(s)]
            if said:
                out += ["### Notes:", *said]
        sections.append("\n".join(out))
    keys = {"title": "title", "creator": "author", "lastModifiedBy": "last_modified_by", "created": "created", "modified": "modified", "subject": "subject", "keywords": "keywords", "category": "category", "contentStatus": "content_status", "version": "version"}
    return sections, _properties(a, keys)


# --- xlsx


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx(content: bytes) -> tuple[list[str], dict[str, str]]:
    """The active sheet's values as a table; empty cells print as None."""
    a = Archive(content)
    strings = ["".join(t.text or "" for t in s.iter() if _name(t) == "t") for s in a.xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in a.names else []
    book, links = a.xml("xl/workbook.xml"), a.related("xl/workbook.xml")
    active = next((int(x.get("activeTab", 0)) for x in book.iter() if _name(x) == "workbookView"), 0)
    sheets = [links.get(next((v for k, v in x.attrib.items() if k.endswith("}id")), "")) for x in book.iter() if _name(x) == "sheet"]
    if not sheets:
        raise FileProcessingError("The workbook has no sheets")
    rows: dict[int, dict[int, object]] = {}
    for r in a.xml(sheets[min(active, len(sheets) - 1)] or "xl/worksheets/sheet1.xml").iter():
        if _name(r) != "row":
            continue
        n = int(r.get("r") or len(rows) + 1)
        cells: dict[int, object] = {}
        for c in r:
            at = _column(c.get("r", "")) if c.get("r") else len(cells)
            v = next((x.text for x in c if _name(x) == "v"), None)
            kind = c.get("t")
            if kind == "s" and v is not None:
                v = strings[int(v)]
            elif kind == "inlineStr":
                v = "".join(t.text or "" for t in c.iter() if _name(t) == "t")
            elif kind == "b" and v is not None:
                v = str(v == "1")
            cells[at] = v
        rows[n] = cells
    if not rows:
        return [], {}
    width = max((max(c, default=-1) for c in rows.values()), default=-1) + 1
    return [table_text([[c.get(k) for k in range(width)] for _, c in sorted(rows.items())])], {}
