"""Text of simple PDF files with the standard library: pages in order, text operators of their content streams.

Streams may be plain or deflated, also in object streams. Fonts are read by their ToUnicode tables where they have
any, else by the Windows code page. Encrypted files, and text that is only drawn, are beyond it.
"""

from __future__ import annotations

import re
import zlib

from ..errors import FileProcessingError
from .markup import paper_text

#: A stream that inflates to more bytes is an error.
LARGEST_STREAM = 1 << 28
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+.\d]+|[A-Za-z'\"*]+\d?", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_INFO = {"Title": "title", "Author": "author", "Creator": "creator", "Producer": "producer", "Publisher": "publisher", "CreationDate": "created", "ModDate": "modified"}


def _stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n", body)
    if not m:
        return b""
    raw = body[m.end() : body.rfind(b"endstream")].rstrip(b"\r\n")
    if b"FlateDecode" in body[: m.start()]:
        out = zlib.decompressobj()
        try:
            data = out.decompress(raw, LARGEST_STREAM)
        except zlib.error:
            return b""
        if out.unconsumed_tail:
            raise FileProcessingError(f"A stream of the PDF file has more than {LARGEST_STREAM} bytes")
        return data
    return raw


def _string(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].strip() == b"" else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)


def _plain(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


def _table(cmap: bytes) -> dict[bytes, str]:
    out: dict[bytes, str] = {}

    def text(x: bytes) -> str:
        return bytes.fromhex(x.decode()).decode("utf-16-be", "replace")

    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            out[bytes.fromhex(a.decode())] = text(b)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            first = int(c, 16)
            many = int(b, 16) - int(a, 16) + 1
            if many > 0x110000:
                raise FileProcessingError("A code range of the PDF file is longer than Unicode")
            for k in range(many):
                out[(int(a, 16) + k).to_bytes(len(a) // 2, "big")] = text(f"{first + k:0{len(c)}x}".encode())
    return out


class _File:
    def __init__(self, content: bytes):
        self.objects = {int(n): body for n, body in _OBJECT.findall(content)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body and (m := re.search(rb"/First\s+(\d+)", body)):
                data, first = _stream(body), int(m[1])
                numbers = list(map(int, re.findall(rb"\d+", data[:first])))
                places = numbers[1::2] + [len(data) - first]
                for k, n in enumerate(numbers[::2]):
                    self.objects[n] = data[first + places[k] : first + places[k + 1]]

    def refs(self, body: bytes, key: str) -> list[int]:
        m = re.search(rb"/" + key.encode() + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def pages(self) -> list[bytes]:
        catalog = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        out: list[bytes] = []
        todo, seen = self.refs(catalog, "Pages"), set()
        while todo:
            n = todo.pop(0)
            if n in seen or n not in self.objects:
                continue
            seen.add(n)
            body = self.objects[n]
            if re.search(rb"/Type\s*/Page\b", body):
                out.append(body)
            else:
                todo = self.refs(body, "Kids") + todo
        return out or [b for _, b in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page\b", b)]

    def fonts(self, page: bytes) -> dict[bytes, dict[bytes, str]]:
        inside = page + b"".join(self.objects.get(n, b"") for n in self.refs(page, "Resources"))
        inside += b"".join(self.objects.get(n, b"") for n in self.refs(inside, "Font"))
        out = {}
        for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", inside):
            for u in self.refs(self.objects.get(int(n), b""), "ToUnicode"):
                out[name] = _table(_stream(self.objects.get(u, b"")))
        return out

    def text(self, page: bytes) -> str:
        data = b"\n".join(_stream(self.objects.get(n, b"")) for n in self.refs(page, "Contents"))
        fonts, now, out, args, in_array = self.fonts(page), None, [], [], False

        def show(raw: bytes) -> str:
            if not now:
                return _plain(raw)
            width = max(map(len, now))
            return "".join(now.get(raw[k : k + width], "") for k in range(0, len(raw), width))

        for token in _TOKEN.findall(data):
            if token[:1] in b"(<":
                args.append(_string(token))
            elif token in (b"[", b"]"):
                in_array = token == b"["
            elif token[:1] == b"/":
                args.append(token[1:])
            elif re.fullmatch(rb"[-+.\d]+", token):
                try:
                    args.append(float(token))
                except ValueError:
                    args.append(0.0)
            elif not in_array:
                if token == b"Tf":
                    now = fonts.get(next((x for x in args if isinstance(x, bytes)), b""))
                elif token in (b"T*", b"ET") or token in (b"Td", b"TD", b"Tm") and args and (args[-1] if isinstance(args[-1], float) else 0):
                    out.append("\n")
                elif token in (b"Tj", b"TJ", b"'", b'"'):
                    if token in (b"'", b'"'):
                        out.append("\n")
                    for x in args:
                        if isinstance(x, bytes):
                            out.append(show(x))
                        elif token == b"TJ" and x < -200:
                            out.append(" ")
                args = []
        return re.sub(r"\n+", "\n", "".join(out)).strip("\n")


def pdf(content: bytes) -> tuple[list[str], dict[str, str]]:
    """A section for each page, cleaned up; page_count and what the file says of itself."""
    if not content.lstrip()[:5].startswith(b"%PDF"):
        raise FileProcessingError("Not a PDF file")
    file = _File(content)
    # in a trailer, or in the dictionary of a stream that stands for it
    trailers = re.findall(rb"\btrailer\b(.*?)(?:startxref|\Z)", content, re.S)
    trailers += [head for body in file.objects.values() if re.search(rb"/Type\s*/XRef\b", head := body.split(b"stream", 1)[0])]
    if any(b"/Encrypt" in t for t in trailers):
        raise FileProcessingError("The PDF file is encrypted")
    pages = file.pages()
    meta = {"page_count": str(len(pages))}
    if m := re.search(rb"/Info\s+(\d+)\s+\d+\s+R", content):
        info = file.objects.get(int(m[1]), b"")
        for key, name in _INFO.items():
            if v := re.search(rb"/" + key.encode() + rb"\s*(\((?:\\.|[^\\)])*\)|<[0-9A-Fa-f\s]*>)", info, re.S):
                meta[name] = _plain(_string(v[1]))
    return [paper_text(file.text(p)) for p in pages], meta
