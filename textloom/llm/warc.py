"""WARC transactions: request, response and metadata records joined into one nested row per capture.

Records of one capture name each other by WARC-Concurrent-To. Most writers let the others name the
response, so a record's own first target is its capture, without any join; where targets chain or differ,
the identifiers that are linked are gathered first. Record bodies are moved once.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table
from .graph import components

RECORD = "record_id string, warc_type string, target_uri string, warc_date string, concurrent_to array<string>, content_type string, block binary"
READ = f"{RECORD}, error string"
_FIELDS = ["record_id", "warc_type", "target_uri", "warc_date", "content_type", "block"]


_GZIP = b"\x1f\x8b\x08"
_HEAD = re.compile(rb"WARC/[0-9]\.[0-9]\r\n")
_STEP = 1 << 16


class _Broken(str):
    """Why a part of a file can't be read, in the stream of what can."""


def _inflated(data: bytes) -> Iterator[bytes | _Broken]:
    """The contents of gzip members one after another, a little at a time; behind one that is broken, reading goes on with the next."""
    view, at = memoryview(data), 0
    while at < len(data):
        if data[at : at + 3] != _GZIP:
            if any(view[at : at + _STEP]):
                yield _Broken("not a gzip member")
            following = data.find(_GZIP, at)
            at = following if following >= 0 else len(data)
            continue
        d, p = zlib.decompressobj(31), at
        try:
            while not d.eof and p < len(data):
                chunk = view[p : p + _STEP]
                p += len(chunk)
                if out := d.decompress(chunk):
                    yield out
            if not d.eof:
                yield _Broken("the last gzip member ends too soon")
            at = p - len(d.unused_data)
        except zlib.error as e:
            yield _Broken(f"gzip member: {e}")
            following = data.find(_GZIP, at + 1)
            at = following if following >= 0 else len(data)


class _Window:
    """A stream of pieces, of which what is still needed is held."""

    def __init__(self, pieces: Iterator[bytes | _Broken]):
        self.pieces, self.held, self.at = pieces, bytearray(), 0

    def more(self) -> _Broken | bool:
        """Takes in another piece: True; False at the end; or what is broken there."""
        piece = next(self.pieces, None)
        if piece is None or isinstance(piece, _Broken):
            return False if piece is None else piece
        self.held += piece
        return True

    def drop(self) -> None:
        """Forgets what was read, now and then, so that it costs no more than reading."""
        if self.at > 1 << 20:
            del self.held[: self.at]
            self.at = 0


def _unreadable(why: str) -> dict:
    return dict.fromkeys(("record_id", "warc_type", "target_uri", "warc_date", "content_type", "block")) | {"concurrent_to": [], "error": why}


def parse(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, gzipped by record or as a whole, or not at all, read in one pass in which a record or so is held. Header names match in any case.

    What can't be read (a broken gzip member, a length that is no number or doesn't lead to a record's end, a file that
    ends in a record) gives a row of nulls with `error`, and reading goes on with the next thing that looks like a record's first line."""
    zipped = data[:2] == _GZIP[:2]
    w = _Window(_inflated(data) if zipped else (data[k : k + (1 << 20)] for k in range(0, len(data), 1 << 20)))
    while True:
        w.drop()
        start = w.at
        while (m := _HEAD.search(w.held, start)) is None:
            start = max(w.at, len(w.held) - 10)
            if (got := w.more()) is False:
                return
            if got is not True:
                yield _unreadable(got)
                w.held, w.at, start = bytearray(), 0, 0
        at = from_ = m.start()
        broken = None
        while (end := w.held.find(b"\r\n\r\n", from_)) < 0:
            from_ = max(at, len(w.held) - 3)
            if (got := w.more()) is not True:
                broken = got or _Broken("the file ends in a record's headers")
                break
        if broken is not None:
            yield _unreadable(broken)
            w.held, w.at = bytearray(), 0
            continue
        if (m := _HEAD.search(w.held, at + 10, end)) is not None:
            yield _unreadable("a record's headers end too soon")
            w.at = m.start()
            continue
        headers: dict[str, list[str]] = {}
        for line in w.held[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        one = lambda k: headers.get(k, [None])[0]
        given = one("content-length")
        if given is None or not given.isascii() or not given.isdigit():
            yield _unreadable(f"Content-Length {given!r}")
            w.at = end + 4
            continue
        size, at = int(given), end + 4
        # a record ends in two line breaks, but for the last of some files
        while broken is None and len(w.held) < at + size + 4:
            if (got := w.more()) is not True:
                broken = got or _Broken("")
        rest = w.held[at + size : at + size + 4]
        if len(w.held) < at + size or (rest[:2] != b"\r\n" and len(rest)):
            yield _unreadable(broken or f"Content-Length {size} doesn't lead to the record's end")
            if broken:
                w.held, w.at = bytearray(), 0
            else:
                w.at = at
            continue
        yield {"record_id": one("warc-record-id"), "warc_type": one("warc-type"), "target_uri": one("warc-target-uri"), "warc_date": one("warc-date"), "concurrent_to": headers.get("warc-concurrent-to", []), "content_type": one("content-type"), "block": bytes(w.held[at : at + size])}
        w.at = at + size
        if broken:
            yield _unreadable(broken)
            w.held, w.at = bytearray(), 0


def serialise(record: dict, zipped: bool = False) -> bytes:
    """A record as it stands in a file."""
    head = ["WARC/1.1"]
    for name, k in (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "warc_date"), ("WARC-Target-URI", "target_uri"), ("Content-Type", "content_type")):
        if record.get(k) is not None:
            head.append(f"{name}: {record[k]}")
    head += [f"WARC-Concurrent-To: {x}" for x in record.get("concurrent_to") or []]
    block = record.get("block") or b""
    out = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + bytes(block) + b"\r\n\r\n"
    return gzip.compress(out, mtime=0) if zipped else out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files at path, with error: null, or why a part of a file couldn't be read.

    A file is one row for Spark, of 2 GB at most as it lies there; its contents are inflated and cut as they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    schema = pa.schema([(n, pa.binary() if n == "block" else pa.list_(pa.string()) if n == "concurrent_to" else pa.string()) for n in [f.split()[0] for f in READ.split(", ")]])

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                held: list[dict] = []
                n = 0
                for r in parse(content.as_py()):
                    held.append(r)
                    n += len(r["block"] or b"")
                    if len(held) == 256 or n > 1 << 26:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, n = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    return files.mapInArrow(rows, READ)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """The records that a crawler would have written for pages (page_id, url, html): a response, the request for it, and metadata, both concurrent to the response."""
    p = pages.select(F.col("page_id").alias("i"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).where("i is not null")
    name = lambda kind: F.concat(F.lit(f"<urn:textloom:{kind}:"), F.col("i").cast("string"), F.lit(">"))
    host, path = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^#]*)", 1)
    to = F.array(name("response"))
    none = F.array().cast("array<string>")
    record = lambda kind, concurrent, content, block: F.struct(name(kind).alias("record_id"), F.lit(kind).alias("warc_type"), F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("warc_date"), concurrent.alias("concurrent_to"), F.lit(content).alias("content_type"), F.encode(block, "UTF-8").alias("block"))
    nl = "\r\n"
    return p.select(
        F.inline(
            F.array(
                record("request", to, "application/http; msgtype=request", F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(f" HTTP/1.1{nl}Host: "), host, F.lit(nl + nl))),
                record("response", none, "application/http; msgtype=response", F.concat(F.lit(f"HTTP/1.1 200 OK{nl}Content-Type: text/html; charset=utf-8{nl}Content-Length: "), F.octet_length("html").cast("string"), F.lit(nl + nl), F.col("html"))),
                record("metadata", to, "application/warc-fields", F.concat(F.lit("page-id: "), F.col("i").cast("string"), F.lit(nl), F.lit("characters: "), F.length("html").cast("string"), F.lit(nl))),
            )
        )
    )


def _capture_names(records: DataFrame) -> DataFrame:
    """records with tl_capture, the identifier that its capture has, be it by chains."""
    targets = F.array_sort(F.array_distinct(F.filter(F.coalesce("concurrent_to", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != F.coalesce("record_id", F.lit(""))))))
    own = records.withColumn("tl_targets", targets).withColumn("tl_first", F.when(F.size("tl_targets") > 0, F.col("tl_targets")[0]).otherwise(F.col("record_id")))
    links = own.select("record_id", "tl_targets", "tl_first").where(F.size("tl_targets") > 0)
    # links that the first target alone doesn't show: further targets, and records that others name though they name some themselves
    further = links.select(F.col("tl_first").alias("x"), F.explode(F.slice("tl_targets", 2, 1 << 30)).alias("y"))
    named = links.select(F.explode("tl_targets").alias("record_id")).distinct()
    chained = links.where("record_id is not null").join(named, "record_id", "left_semi").select(F.col("record_id").alias("x"), F.col("tl_first").alias("y"))
    extra = durable(further.union(chained).where("x <> y"))
    if extra.isEmpty():
        return own.withColumn("tl_capture", F.col("tl_first"))
    # the identifiers themselves are the graph's nodes: no hash can make two captures one
    names = durable(components(extra.select(F.col("x").alias("a"), F.col("y").alias("b")))).select(F.col("node").alias("tl_first"), F.col("component").alias("tl_name"))
    return own.join(names, "tl_first", "left").withColumn("tl_capture", F.coalesce("tl_name", "tl_first"))


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, target_uri, n_records, request, response (structs, null if there is none), metadata and others (arrays of structs).

    Records are of one capture if a chain of concurrent-to identifiers, followed either way, leads from one to the other;
    identifiers of records that aren't there link too. capture_id is the response's record_id, or the least record_id
    without a response, or the least identifier they name if none has its own. Of several responses or requests the one of least date and identifier is taken,
    and the rest are in others, as are records of further types. A repeated record counts once. A record without identifier
    joins what it names; if it names nothing, it is left out. Null blocks stay null. Further columns are ignored."""
    r = records.select(*_FIELDS, "concurrent_to").where("record_id is not null or size(filter(concurrent_to, x -> x is not null)) > 0")
    item = F.struct(F.col("warc_date"), *[F.col(c) for c in _FIELDS if c != "warc_date"])
    one = _capture_names(r).select("tl_capture", item.alias("r"))
    every = one.groupBy("tl_capture").agg(F.array_sort(F.collect_set("r")).alias("r"))
    of = lambda kind: F.filter("r", lambda x: F.coalesce(x["warc_type"], F.lit("")) == kind)
    first = lambda kind: F.get(of(kind), F.lit(0))
    out = every.select(
        F.coalesce(first("response")["record_id"], F.array_min(F.transform("r", lambda x: x["record_id"])), F.col("tl_capture")).alias("capture_id"),
        F.coalesce(first("response")["target_uri"], F.get(F.transform("r", lambda x: x["target_uri"]), F.lit(0))).alias("target_uri"),
        F.size("r").alias("n_records"),
        first("request").alias("request"),
        first("response").alias("response"),
        of("metadata").alias("metadata"),
        F.filter("r", lambda x: ~F.coalesce(x["warc_type"], F.lit("")).isin("request", "response", "metadata")).alias("rest"),
        F.slice(of("response"), 2, 1 << 30).alias("responses"),
        F.slice(of("request"), 2, 1 << 30).alias("requests"),
    )
    return out.select("capture_id", "target_uri", "n_records", "request", "response", "metadata", F.concat("requests", "responses", "rest").alias("others"))


def op2_warc_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captures of all pages, from the records a crawler would have written."""
    return assemble(records_of_pages(table(spark, sf_dir, "pages")))
