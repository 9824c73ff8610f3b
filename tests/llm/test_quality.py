"""Compression bands against the plain rules, text by text."""

import base64
import random
import string

import pyarrow as pa
import zstandard

from textloom.llm import quality as Q


def plain(text, b):
    data = (text or "").encode()
    if not data:
        return 0, 0.0, 0, 0, 0, None, True
    z = lambda x: len(zstandard.ZstdCompressor(level=b.level, write_content_size=False, write_checksum=False).compress(x))
    ratio, reason = len(data) / z(data), None
    bands = [x for x in b.documents if len(data) >= x[0]]
    if bands:
        reason = "repetitive" if ratio > bands[-1][2] else "incompressible" if ratio < bands[-1][1] else None
    chunks = [data[k : k + b.chunk] for k in range(0, len(data), b.chunk)]
    chunks = [c for k, c in enumerate(chunks) if len(c) >= b.least_chunk] if len(data) >= b.least_chunk else []
    high = sum(len(c) / z(c) > b.chunk_greatest for c in chunks)
    low = sum(len(c) / z(c) < b.chunk_least for c in chunks)
    if reason is None and high > b.chunk_share * len(chunks):
        reason = "repetitive chunks"
    if reason is None and low > b.chunk_share * len(chunks):
        reason = "incompressible chunks"
    return len(data), ratio, len(chunks), high, low, reason, reason is None


def test_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    vocab = [word() for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    noise = lambda n: "".join(chr(rng.randrange(33, 127)) for _ in range(n))
    texts = [None, "", "x", "short", "é" * 600, prose(20), prose(400), prose(30000), "again and " * 300, noise(90), noise(500), noise(5000), prose(400) + noise(9000), prose(300) + "ab" * 4000, prose(150)[:1024], prose(300)[:1536], prose(300)[:1535]]
    texts += [texts[6], None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r.v) for r in docs.select("doc_id", Q.compression_bands(docs).alias("v")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == plain(t, Q.Bands()), (k, (t or "")[:30])
    kept = {k for k in got if got[k][-1]}
    assert {6, 7}.issubset(kept) and not kept & {8, 11, 12, 13}


ENGLISH = """The harbour lay quiet when we came down from the hills, and only a few lamps were burning along the quay. An old man
sat mending his nets beside the wall; he looked up as we passed, nodded, and went on with his work. Nobody had expected
visitors so late in the year, because the road over the pass is usually closed by the first week of November. We asked
for rooms at the inn, where the owner's daughter brought us bread, cheese and a jug of warm cider, and told us which of
the boats would cross to the islands in the morning. Later, long after the others had gone to bed, I could hear the wind
getting up outside, and the ropes knocking against the masts. It sounded like somebody walking slowly through an empty
house, opening one door after another, never quite finding what had been left behind there many years ago."""


def test_encoded_and_random_text():
    rng = random.Random(6)
    kinds = {
        "base64": lambda n: base64.b64encode(rng.randbytes(n)).decode()[:n],
        "lines": lambda n: base64.encodebytes(rng.randbytes(n)).decode()[:n],
        "letters": lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n)),
        "characters": lambda n: "".join(rng.choices([chr(c) for c in range(33, 127)], k=n)),
    }
    starts = [b[0] for b in Q.Bands().documents]
    lengths = [*starts, *(n - 1 for n in starts[1:]), 512, 1024, 50_000]
    for name, f in kinds.items():
        got = Q.judged(pa.array([f(n) for n in lengths]), Q.Bands()).field("reason").to_pylist()
        assert got == ["incompressible"] * len(lengths), (name, list(zip(lengths, got, strict=True)))
    assert Q.judged(pa.array([ENGLISH[:n] for n in starts if n <= len(ENGLISH)]), Q.Bands()).field("keep").to_pylist() == [True] * sum(n <= len(ENGLISH) for n in starts)


def test_mostly_encoded():
    rng = random.Random(7)
    words = ENGLISH.split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    noise = lambda n: base64.b64encode(rng.randbytes(n)).decode()[:n]
    texts = [prose(900) + " " + noise(9000), noise(9000) + " " + prose(900), prose(2400) + " " + noise(4000)]
    v = Q.judged(pa.array(texts), Q.Bands())
    assert v.field("keep").to_pylist() == [False, False, True]
    assert v.field("random_chunks").to_pylist()[0] >= 8
    # what keeps a document's ratio up doesn't hide that most of its chunks are encoded
    (r,) = Q.judged(pa.array(["all of it again " * 600 + noise(12_000)]), Q.Bands()).field("reason").to_pylist()
    assert r == "incompressible chunks"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, v string")
    assert docs.select(Q.compression_bands(docs).alias("x")).count() == 0
