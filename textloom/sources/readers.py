"""From a file's bytes to sections of text and metadata: decoding, routing by extension, the simple formats."""

from __future__ import annotations

import codecs
import csv
import email
import email.policy
import io
import json
import mimetypes
import posixpath
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from ..errors import FileProcessingError, UnsupportedFileTypeError
from ..functions.gather import gathered
from ..operators.registry import call_processor
from ..operators.tables import table_text
from . import archives, markup
from .html import to_markdown
from .pdf import pdf

Read = tuple[list[str], dict[str, str]]
_MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


def is_binary(content: bytes, path: str = "") -> bool:
    """Whether bytes aren't text: by a NUL among the first 1,024, unless a byte-order mark says what they are."""
    if mimetypes.guess_type(path)[0] in ("text/plain", "application/rtf") or any(content.startswith(m) for m, _ in _MARKS):
        return False
    return b"\0" in content[:1024]


#: Encodings of text that isn't UTF-8, with the letters that are commonest in what is written in them.
_CHARSETS = (
    ("cp1252", "etaonisrhdlucmäöüßéèàçñóíêôâùåøæïëîûìòúáõãœ"),
    ("cp1250", "aeionzrswcytkdpmluąęłśżźćńóěščřžýáíéůďťňőű"),
    ("cp1251", "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъ"),
    ("koi8_r", "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъ"),
    ("cp1253", "αοιετσνηυρπκμλςόάίέήώύγδθχφβξζψ"),
    ("cp1255", "יוהלארמבתשנעדקפחצגטזסכןםךףץ"),
    ("cp1256", "ايلمونرتبدهعسكفقحجةشأصخطضذزثغ"),
    ("shift_jis", "のにはをたがでとしるいれさんなかもくすあ、。"),
    ("euc_jp", "のにはをたがでとしるいれさんなかもくすあ、。"),
    ("gb18030", "的一是不了在人有我他这中大来上国们到说，。"),
    ("big5", "的一是不了在人有我他這中大來上國們到說，。"),
    ("euc_kr", "이다는을의에가고하지한로은를기어사도리"),
)
#: Bytes by which an encoding is told.
_TOLD_BY = 1 << 16


def charset(content: bytes) -> str:
    """The encoding of text that isn't UTF-8: the one in which most of what isn't ASCII is made of the commonest letters of its languages, among those that can be decoded."""
    part = content[:_TOLD_BY]
    best, most = "cp1252", 0.0
    for name, common in _CHARSETS:
        # the part may end within a character
        text = next((t for cut in (0, 1, 2, 3) if (t := _strict(part[: len(part) - cut], name)) is not None), None)
        if text is None:
            continue
        far = [c for c in text if c > "\x7f"]
        # capitals inside words and signs are what a wrong encoding gives
        odd = sum(not c.isalpha() and c not in "«»„“”’–—…。、，" for c in far) + sum(a.islower() and b.isupper() for a, b in zip(text, text[1:], strict=False))
        score = (sum(c.lower() in common for c in far) - odd) / max(1, len(far)) + (0.02 if name == "cp1252" else 0.0)
        if score > most:
            best, most = name, score
    return best


def _strict(content: bytes, encoding: str) -> str | None:
    try:
        return content.decode(encoding)
    except UnicodeDecodeError:
        return None


def decoded(content: bytes, path: str = "") -> str:
    """Text of a file: by its byte-order mark, as UTF-8, else in the encoding that its letters speak for; line ends made one character."""
    if is_binary(content, path):
        raise FileProcessingError(f"{path or 'The content'} is binary")
    encoding = next((e for m, e in _MARKS if content.startswith(m)), "utf-8")
    try:
        text = content.decode(encoding)
    except UnicodeDecodeError:
        text = content.decode(charset(content), "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def csv_table(text: str) -> str:
    """Rows between commas as a Markdown table, the first as its header."""
    return table_text(list(csv.reader(io.StringIO(text))))


_HEADERS = ("Subject", "From", "To", "Cc", "Date", "Message-ID", "In-Reply-To", "References")


def eml(content: bytes) -> Read:
    """The plain-text body, if there is one; headers that are set, and names of attachments and inline parts as JSON lists."""
    m = email.message_from_bytes(content, policy=email.policy.default)
    meta = {h.lower().replace("-", "_"): str(m[h]) for h in _HEADERS if m[h]}
    bodies, names = [], {"attachment": [], "inline": []}
    for part in m.walk():
        if part.is_multipart():
            continue
        kind = part.get_content_disposition()
        if part.get_filename():
            names["inline" if kind == "inline" else "attachment"].append(part.get_filename())
        elif part.get_content_type() == "text/plain" and kind != "attachment":
            try:
                bodies.append(part.get_content())
            except (LookupError, UnicodeDecodeError):
                bodies.append((part.get_payload(decode=True) or b"").decode("utf-8", "replace"))
    meta |= {f"{k}_names": json.dumps(v, ensure_ascii=False) for k, v in names.items() if v}
    body = "\n".join(bodies).strip()
    return ([body] if body else []), meta


def _text(f: Callable[[str], str] = lambda t: t) -> Callable[[bytes], Read]:
    return lambda content: ([f(decoded(content))], {})


READERS: dict[str, Callable[[bytes], Read]] = {
    ".txt": _text(),
    ".md": _text(),
    ".html": _text(to_markdown),
    ".hml": _text(to_markdown),
    ".csv": _text(csv_table),
    ".tex": _text(markup.latex_text),
    ".rst": _text(markup.rst_text),
    ".rtf": _text(markup.rtf_text),
    ".eml": eml,
    ".docx": archives.docx,
    ".odt": archives.odt,
    ".epub": archives.epub,
    ".pptx": archives.pptx,
    ".xlsx": archives.xlsx,
    ".pdf": pdf,
}
#: Formats that give several sections.
SECTIONED = {".docx", ".odt", ".epub", ".pptx", ".pdf"}


def extension(path: str) -> str:
    return posixpath.splitext(path)[1].lower()


def read(path: str, content: bytes, own: dict[str, tuple[str, Callable]] | None = None) -> Read:
    """Sections and metadata of one file. own: users' processors by extension, which come first and are given the path."""
    ext = extension(path)
    if not ext:
        raise FileProcessingError(f"{path} has no extension")
    if own and ext in own:
        return call_processor(*own[ext], path)
    if ext not in READERS:
        raise UnsupportedFileTypeError(f"No reader for {ext} files: {path}")
    try:
        return READERS[ext](content)
    except FileProcessingError:
        raise
    except Exception as e:
        raise FileProcessingError(f"{path} can't be read: {type(e).__name__}: {e}") from e


@arrow_udf(StringType())
def _html(pages: pa.Array) -> pa.Array:
    # pages and texts are strings of Python's a few at a time
    return gathered((None if p is None else to_markdown(p) for p in (x.as_py() for x in pages)), pa.string(), lambda t: len(t or ""))


def html_column(html: Column) -> Column:
    """Markdown of a column of HTML pages; null for null."""
    return _html.asNondeterministic()(html)


def has_reader(path: Column) -> Column:
    """Whether a path's extension is one that is read."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1)).isin(*READERS)
