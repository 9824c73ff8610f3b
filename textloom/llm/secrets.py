"""Secret scans through layers of encoding.

A text is the first layer on a worklist. Each layer is scanned by the rules, and every stretch of it that is
encoded (base64, and compressed data or sixteen-bit text inside base64) becomes a layer of its own, as does the whole of it with its
URL escapes or its Unicode escapes replaced, and compressed data whose bytes are escaped, until there is none left. A stretch that decodes to one of the layers it came from is a cycle and
isn't followed. Every character of a layer knows where in the document it comes from, so that what is
found anywhere is reported by its place in the document's text.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import math
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import dealt_table

FINDINGS = "array<struct<rule:string,start:int,end:int,depth:int,path:string,fingerprint:string>>"

#: name, pattern (its last group is the secret), substrings in lower case of which one must be there
RULES: list[tuple[str, re.Pattern, tuple[str, ...]]] = [
    ("aws_access_key", re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[0-9A-Z]{16})(?![A-Za-z0-9])"), ("akia", "asia")),
    ("github_token", re.compile(r"(?<![A-Za-z0-9])(gh[pousr]_[A-Za-z0-9]{36,})"), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("slack_token", re.compile(r"(?<![A-Za-z0-9])(xox[abprs]-[A-Za-z0-9-]{10,})"), ("xox",)),
    ("google_api_key", re.compile(r"(?<![A-Za-z0-9])(AIza[0-9A-Za-z_-]{35})"), ("aiza",)),
    ("stripe_key", re.compile(r"(?<![A-Za-z0-9])([sr]k_(?:live|test)_[0-9A-Za-z]{16,})"), ("k_live_", "k_test_")),
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"), ("eyj",)),
    ("private_key", re.compile(r"(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)"), ("private key-----",)),
    ("assigned_secret", re.compile(r"(?i)(?<![a-z0-9])(?:api[_-]?key|secret|token|passw(?:or)?d|pwd)[\"']?\s{0,8}[:=]\s{0,8}[\"']?([A-Za-z0-9+/_.~-]{16,})"), ("key", "secret", "token", "passw", "pwd")),
]


@dataclass(frozen=True)
class Limits:
    #: Shorter runs of base64 letters aren't decoded, as they hold less than any rule looks for; line breaks inside them don't count.
    base64_chars: int = 20
    #: Share of a decoded text that must be printable.
    printable: float = 0.9
    #: Least entropy, in bits a character, of what is assigned to a name.
    entropy: float = 3.0
    #: Compressed data that would take more bytes is scanned in overlapping windows of so many.
    inflated: int = 1 << 24


@dataclass
class Layer:
    text: str
    #: Where in the document each character starts and ends; None for the document itself.
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None
    path: tuple[str, ...] = ()
    above: tuple[str, ...] = field(default=(), repr=False)
    #: Where in the text one encoded piece may end and another begin, in order.
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64), repr=False)
    #: Of a window of a longer text, whether it is the first and the last.
    window: tuple[bool, bool] | None = None
    #: Whether it stands for contents that are neither held nor text.
    unscanned: bool = False

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.starts is None:
            return a, b
        return int(self.starts[a]), int(self.ends[b - 1])


_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = "A-Za-z0-9+/_-"
_LETTERS = re.compile(f"[{_BASE64}]+")
#: How compressed data starts.
_MAGIC = re.compile(rb"\x1f\x8b|\x78[\x01\x5e\x9c\xda]|\x28\xb5\x2f\xfd|BZh[1-9]|\xfd7zXZ\x00")
#: Sixteen-bit text of ASCII letters, in either order of bytes.
_WIDE = ((re.compile(rb"(?:[\t\r\n\x20-\x7e]\x00){8,}+"), "utf-16-le"), (re.compile(rb"(?:\x00[\t\r\n\x20-\x7e]){8,}+"), "utf-16-be"))
_BYTES = re.compile(r"(?:\\x[0-9A-Fa-f]{2})+")
_UTF8 = rb"[\t\r\n\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _unescape(m: str) -> str:
    if m.startswith("\\u"):
        return bytes.fromhex(m.replace("\\u", "")).decode("utf-16-be", "replace")
    if m.startswith("\\x"):
        return bytes.fromhex(m.replace("\\x", "")).decode("utf-8", "replace")
    code = int(m[2:], 16) if m.startswith("\\U") else int(m[3:-1], 16) if m[2] in "xX" else int(m[2:-1])
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def _escaped(text: str, pattern: re.Pattern, decode) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(decoded, starts, ends) of the whole text with its matches replaced, if it has any; the places are in text."""
    out, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(text):
        plain = np.arange(at, m.start())
        got = decode(m.group())
        out += [text[at : m.start()], got]
        starts += [plain, np.full(len(got), m.start())]
        ends += [plain + 1, np.full(len(got), m.end())]
        at = m.end()
    if at:
        plain = np.arange(at, len(text))
        yield "".join([*out, text[at:]]), np.concatenate([*starts, plain]), np.concatenate([*ends, plain + 1])


def _raw(text: str, pattern: re.Pattern, decode) -> tuple[bytes, np.ndarray, np.ndarray] | None:
    """(bytes, starts, ends) of the whole text in UTF-8 with its matches replaced by the bytes they stand for, if compressed data may be in it."""
    out, where, at = [], [], 0
    for m in pattern.finditer(text):
        got = decode(m.group())
        out += [text[at : m.start()].encode("utf-8", "replace"), got]
        where.append((m.start(), m.end(), got))
        at = m.end()
    data = b"".join([*out, text[at:].encode("utf-8", "replace")])
    if not at or not _MAGIC.search(data):
        return None
    starts, ends, at = [], [], 0
    for a, b, got in [*where, (len(text), len(text), b"")]:
        plain = np.repeat(np.arange(at, a), [len(c.encode("utf-8", "replace")) for c in text[at:a]])
        # an escape of each byte has as many letters
        own = a + (np.arange(len(got)) * (b - a)) // max(1, len(got))
        starts += [plain, own]
        ends += [plain + 1, own + (b - a) // max(1, len(got))]
        at = b
    return data, np.concatenate(starts).astype(np.int64), np.concatenate(ends).astype(np.int64)


def _kind(head: bytes) -> str | None:
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:1] == b"\x78" and len(head) > 1 and (head[0] << 8 | head[1]) % 31 == 0:
        return "zlib"
    return "zstd" if head[:4] == b"\x28\xb5\x2f\xfd" else "bz2" if head[:3] == b"BZh" else "xz" if head[:6] == b"\xfd7zXZ\x00" else None


_OPEN = {"gzip": lambda: zlib.decompressobj(47), "zlib": lambda: zlib.decompressobj(47), "zstd": lambda: zstandard.ZstdDecompressor().decompressobj(), "bz2": bz2.BZ2Decompressor, "xz": lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ)}


class _Stream:
    """Contents of compressed data, all its members one after another, piece by piece; used and good count the bytes of whole members, before and after."""

    def __init__(self, pieces: Iterator[bytes], kind: str):
        self.pieces, self.kind, self.used, self.good, self.members = pieces, kind, 0, 0, 0

    def __iter__(self) -> Iterator[bytes]:
        d, buf, fed, made = None, b"", 0, 0
        while True:
            if d is None:
                while len(buf) < 6 and (more := next(self.pieces, None)) is not None:
                    buf += more
                if _kind(buf[:6]) != self.kind:
                    return
                d = _OPEN[self.kind]()
            buf = buf or next(self.pieces, b"")
            if not buf:
                return
            fed += len(buf)
            try:
                out = d.decompress(buf, 1 << 20) if self.kind in ("bz2", "xz") else d.decompress(buf)
                while True:
                    made += len(out)
                    if out:
                        yield out
                    if self.kind not in ("bz2", "xz") or d.eof or d.needs_input:
                        break
                    out = d.decompress(b"", 1 << 20)
            except (zlib.error, zstandard.ZstdError, OSError, lzma.LZMAError, EOFError, ValueError):
                return
            buf = b""
            if d.eof:
                buf = d.unused_data
                fed -= len(buf)
                self.used, self.good, self.members, d = fed, made, self.members + 1, None


def _pieces(data: bytes | memoryview) -> Iterator[bytes]:
    """A little at a time, as there is no limit to what a call of some decompressors returns."""
    return (bytes(data[k : k + 512]) for k in range(0, len(data), 512))


def _inflate(data: bytes | memoryview, limit: int) -> tuple[str, bytes | None, int] | None:
    """(kind, contents or None if they are too long to hold, bytes it takes) of compressed data, or None if it isn't, or is broken."""
    if (kind := _kind(bytes(data[:6]))) is None:
        return None
    stream, out, n = _Stream(_pieces(data), kind), [], 0
    for x in stream:
        out.append(x)
        n += len(x)
        if n > limit:
            return kind, None, len(data)
    return (kind, b"".join(out)[: stream.good], stream.used) if stream.members else None


def _windows(data: bytes | memoryview, size: int) -> Iterator[tuple[tuple[str, ...], bytes, bool, bool]]:
    """(kinds, contents, is the first, is the last) of windows of compressed data, which overlap by a quarter; what is compressed several times is opened as often."""
    kinds: tuple[str, ...] = ()
    pieces = _pieces(data)
    while True:
        head = b""
        while len(head) < 6 and (more := next(pieces, None)) is not None:
            head += more
        pieces = chain([head], pieces)
        if (kind := _kind(head[:6])) is None:
            break
        kinds, pieces = (*kinds, kind), iter(_Stream(pieces, kind))
    held, first = bytearray(), True
    for x in pieces:
        held += x
        while len(held) > size:
            # characters of several bytes stay whole
            b = next(k for k in range(size, -1, -1) if held[k] & 0xC0 != 0x80 or k < size - 3)
            a = next(k for k in range(b - b // 4, b + 1) if k == b or held[k] & 0xC0 != 0x80)
            yield kinds, bytes(held[:b]), first, False
            del held[: max(a, 1)]
            first = False
    yield kinds, bytes(held), first, True


def _wide_runs(data: bytes, a: int, b: int) -> list[tuple[int, str]]:
    """(start, text) of sixteen-bit text in data[a:b]. Each order of bytes also fits the other's, but for a letter: the longer one is meant."""
    every = sorted(((m.end() - m.start(), -m.start(), m.group().decode(code)) for pattern, code in _WIDE for m in pattern.finditer(data, a, b)), reverse=True)
    out: list[tuple[int, str]] = []
    for n, start, text in every:
        if all(-start >= x + 2 * len(t) or x >= n - start for x, t in out):
            out.append((-start, text))
    return sorted(out)


def _readable(data: bytes, limits: Limits) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if not text or sum(c.isprintable() or c in "\r\n\t" for c in text) < limits.printable * len(text):
        return None
    return text


def _decoded(letters: str) -> bytes:
    # three letters a byte short of four hold nothing when one is left over
    whole = letters[: len(letters) - (len(letters) % 4 == 1)]
    return binascii.a2b_base64(whole.replace("-", "+").replace("_", "/") + "=" * (-len(whole) % 4))


def _base64_runs(text: str, run: re.Pattern, least: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(letters, their places in the text, numbers of the letters before which a line starts); a run goes on over single line breaks."""
    for m in run.finditer(text):
        parts = [x.span() for x in _LETTERS.finditer(text, *m.span())]
        letters = "".join(text[x:y] for x, y in parts)
        if len(letters) >= least:
            yield letters, np.concatenate([np.arange(x, y) for x, y in parts]), np.cumsum([y - x for x, y in parts])[:-1]


def _unwrapped(layer: Layer, run: re.Pattern, stretch: re.Pattern, limits: Limits, known: set[tuple[int, int, int]]) -> Iterator[Layer]:
    text = layer.text
    above = (*layer.above, text)

    def of(kind: tuple[str, ...], decoded: str, starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray | None = None) -> Iterator[Layer]:
        """The layer of a decoded stretch, unless it leads back."""
        if decoded and decoded not in above:
            if cuts is None:
                cuts = np.searchsorted(starts, layer.cuts)
            if layer.starts is not None:
                starts, ends = layer.starts[starts], layer.ends[ends - 1]
            # several orders of decoding lead to the same layer
            key = (int(starts[0]), int(ends[-1]), hash(decoded))
            if key in known:
                return
            known.add(key)
            yield Layer(decoded, starts, ends, (*layer.path, *kind), above, cuts)

    def large(packed: bytes | memoryview, a: int, b: int, above_: tuple[str, ...] = ("base64",)) -> Iterator[Layer]:
        """The layers of contents that are too long to hold."""
        for kinds, part, first, last in _windows(packed, limits.inflated):
            if (decoded := _readable(part, limits)) is not None:
                for x in of((*above_, *kinds), decoded, np.full(len(decoded), a), np.full(len(decoded), b), np.zeros(0, np.int64)):
                    x.window = first, last
                    yield x
            elif part:
                for x in of((*above_, *kinds), "\0", np.array([a]), np.array([b]), np.zeros(0, np.int64)):
                    x.unscanned = True
                    yield x

    def base64_text(decoded: str, first: int, at: np.ndarray, breaks: np.ndarray, width: int = 0) -> Iterator[Layer]:
        """The layer of a text whose bytes are from `first` on in those of the letters at `at`; width: bytes of each character, if they all have as many."""
        # character i of the text is from its bytes on, four letters hold three bytes
        size = np.full(len(decoded), width) if width else np.fromiter((len(c.encode()) for c in decoded), np.int64, len(decoded))
        last = first + np.cumsum(size)
        starts, ends = at[(last - size) * 4 // 3], at[np.minimum(-(-last * 4 // 3), len(at)) - 1] + 1
        cuts = np.searchsorted(last, np.maximum(breaks, 0) * 3 // 4, "right")
        yield from of(("base64", "utf16") if width else ("base64",), decoded, starts, ends, np.unique(cuts[(cuts > 0) & (cuts < len(decoded))]))

    def packed(data: bytes, places, above_: tuple[str, ...]) -> Iterator[Layer | tuple[int, int]]:
        """The layers of the compressed data in data, and between them (start, end) of what is none. places: where in the text the bytes from x to y are."""
        view, done = memoryview(data), 0
        for m in _MAGIC.finditer(data):
            if m.start() < done or (inner := _inflate(view[m.start() :], limits.inflated)) is None:
                continue
            x, y = m.start(), m.start() + inner[2]
            kind = above_
            if inner[1] is None:
                yield from large(view[x:], *places(x, len(data)), above_)
                yield done, x
                return
            contents, seen = data, {data}
            while inner is not None and inner[1] is not None:
                kind, contents = (*kind, inner[0]), inner[1]
                if contents in seen:
                    contents = b""
                seen.add(contents)
                inner = _inflate(contents, limits.inflated)
            if inner is not None:
                yield from large(contents, *places(x, y), kind)
            else:
                text_, kind = (_readable(contents, limits), kind)
                if text_ is None:
                    text_, kind = "\n".join(t for _, t in _wide_runs(contents, 0, len(contents))), (*kind, "utf16")
                if not text_:
                    continue
                a, b = places(x, y)
                yield from of(kind, text_, np.full(len(text_), a), np.full(len(text_), b), np.zeros(0, np.int64))
            yield done, x
            done = y
        yield done, len(data)

    if "%" in text:
        for decoded, starts, ends in _escaped(text, _PERCENT, lambda m: unquote_to_bytes(m).decode("utf-8", "replace")):
            yield from of(("url",), decoded, starts, ends)
    for pattern, decode, kind in ((_PERCENT, unquote_to_bytes, "url"), (_BYTES, lambda m: bytes.fromhex(m.replace("\\x", "")), "unicode")):
        if "%" in text and kind == "url" or "\\x" in text and kind == "unicode":
            if (raw := _raw(text, pattern, decode)) is not None:
                data, starts, ends = raw
                for found in packed(data, lambda x, y, starts=starts, ends=ends: (starts[x], ends[y - 1]), (kind,)):
                    if isinstance(found, Layer):
                        yield found
    if "\\" in text or "&#" in text:
        for decoded, starts, ends in _escaped(text, _ESCAPE, _unescape):
            yield from of(("unicode",), decoded, starts, ends)
    for letters, at, lines in _base64_runs(text, run, limits.base64_chars):
        breaks = np.union1d(lines, np.searchsorted(at, layer.cuts)) if len(layer.cuts) else lines
        data = _decoded(letters)
        if not _MAGIC.match(data) and (decoded := _readable(data, limits)) is not None:
            yield from base64_text(decoded, 0, at, breaks)
            continue
        # what is encoded may start at any letter, and other things may stand around it
        marks = np.fromiter((x + y for x, c in enumerate(letters) if c in "+/_-" for y in (0, 1)), np.int64)
        breaks = np.union1d(breaks, marks)
        for k in range(4):
            data = data if k == 0 else _decoded(letters[k:])
            places = lambda x, y, k=k: (at[k + x * 4 // 3], at[min(k - (-y * 4 // 3), len(at)) - 1] + 1)
            for found in packed(data, places, ("base64",)):
                if isinstance(found, Layer):
                    yield found
                    continue
                for m in stretch.finditer(data, *found):
                    yield from base64_text(m.group().decode(), m.start(), at[k:], breaks - k)
                for start, wide in _wide_runs(data, *found):
                    yield from base64_text(wide, start, at[k:], breaks - k, 2)


def _matches(pattern: re.Pattern, layer: Layer) -> list[tuple[str, int, int]]:
    """(secret, start, end) of the matches in a layer, and of those in its pieces that meet none of them."""
    out = [(m.group(1), *m.span(1)) for m in pattern.finditer(layer.text)]
    if layer.window is not None:
        # what a window cuts off is whole in the one before or behind
        first, last = layer.window
        out = [x for x in out if (first or x[1] > 0) and (last or x[2] < len(layer.text) or x[1] < len(layer.text) * 3 // 4)]
    if len(layer.cuts):
        whole = np.array([x[1:] for x in out], np.int64).reshape(-1, 2)
        edges = [0, *layer.cuts.tolist(), len(layer.text)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            for m in pattern.finditer(layer.text[a:b]):
                x, y = m.start(1) + a, m.end(1) + a
                # the first of the whole matches that ends behind x
                k = int(np.searchsorted(whole[:, 1], x, "right"))
                if k == len(whole) or whole[k, 0] >= y:
                    out.append((m.group(1), x, y))
    return out


def scan(text: str | None, limits: Limits = Limits()) -> list[dict]:
    """What the rules find in any layer of the text, by place; a secret that a deeper layer shows again at the same place is reported once."""
    if not text:
        return []
    # long enough, or carried on in the next line
    run = re.compile(rf"(?<![{_BASE64}])(?=[{_BASE64}]{{{limits.base64_chars}}}|[{_BASE64}]++\r?\n[ \t]*+[{_BASE64}])(?:[{_BASE64}]++(?:\r?\n[ \t]*+(?=[{_BASE64}]))?+)++")
    stretch = re.compile(b"(?:%b){%d,}+" % (_UTF8, max(1, limits.base64_chars * 3 // 4)))
    found: dict[tuple, dict] = {}
    known: set[tuple[int, int, int]] = set()

    def follow(first: Layer) -> None:
        work = deque([first])
        while work:
            layer = work.popleft()
            if layer.unscanned:
                a, b = layer.span(0, 1)
                found.setdefault(("unscanned", a, ""), {"rule": "unscanned", "start": a, "end": b, "depth": len(layer.path), "path": ">".join(layer.path), "fingerprint": ""})
                continue
            low = layer.text.lower()
            for rule, pattern, anchors in RULES:
                if not any(x in low for x in anchors):
                    continue
                for m in _matches(pattern, layer):
                    value = m[0]
                    if rule == "assigned_secret" and (_entropy(value) < limits.entropy or not any(c.isdigit() for c in value)):
                        continue
                    a, b = layer.span(m[1], m[2])
                    digest = hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:16]
                    found.setdefault((rule, a, digest), {"rule": rule, "start": a, "end": b, "depth": len(layer.path), "path": ">".join(layer.path), "fingerprint": digest})
            for inner in _unwrapped(layer, run, stretch, limits, known):
                # windows are done with one by one
                follow(inner) if inner.window is not None else work.append(inner)

    follow(Layer(text))
    return sorted(found.values(), key=lambda f: (f["start"], f["end"], f["rule"], f["path"]))


_TYPE = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("depth", pa.int32()), ("path", pa.string()), ("fingerprint", pa.string())]))


def scan_text(docs: DataFrame, limits: Limits = Limits(), text: str = "text"):
    """Column expression over docs: array of structs rule, start, end (code points of the text), depth, path (the encodings from the outside in), fingerprint.

    Null and empty texts have none; equal texts have equal findings. Contents that are too long to hold (limits.inflated) and
    aren't text are not gone into: a row of the rule "unscanned" says where they are. The secret itself is not in the result:
    fingerprint is the start of its SHA-256."""

    @arrow_udf(FINDINGS)
    def f(t: pa.Array) -> pa.Array:
        return pa.array([scan(x.as_py(), limits) for x in t], _TYPE)

    return f.asNondeterministic()(docs[text])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    docs = dealt_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(scan_text(docs)).alias("f")).select("doc_id", "f.*")
