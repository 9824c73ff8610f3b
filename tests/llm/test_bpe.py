"""BPE against another implementation with the same vocabulary, and the way back."""

import base64
import random

import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from textloom.llm import bpe

SF = "/root/testdata/sf0.001"
#: Pieces as the vocabulary's makers cut them.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ODD = ["", " ", "  ", "\n\n a", "don't we'll they've I'm 's 't x'", "'''s '' 'll", "a  b   c ", "1 2 33abc", "  x", "日本語 テスト", "😀😀 👍🏽", "a\tb\r\nc", "<|endoftext|>", "x" * 5000, " " * 700, "é" * 900, "\x00\x01", "é ́"]


@pytest.fixture(scope="module")
def other():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts):
    tokens, offsets = bpe.encode(pa.array(texts, pa.string()), bpe.vocabulary())
    return [tokens[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_same_tokens(other):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("aeTh 'slvdm\n\t  1.,é日😀 ") for _ in range(rng.randrange(80))) for _ in range(600)]
    for t, got in zip(texts, encoded(texts), strict=True):
        assert got == other.encode_ordinary(t), t[:60]


def test_table(spark, other):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    df = docs.select("doc_id", "text", bpe.encode_text(docs).alias("v")).select("doc_id", "text", "v.*")
    df = df.withColumn("back", bpe.decode_tokens(df))
    assert df.where("not round_trip or back <> text or n_tokens <> size(tokens)").count() == 0
    for r in df.where(F.col("doc_id") % 5 == 0).collect():
        assert r.tokens == other.encode_ordinary(r.text)


def test_nulls(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (2, "")], "doc_id long, text string")
    got = docs.select(bpe.encode_text(docs).alias("v")).select("v.*").collect()
    assert [(r.n_tokens, r.round_trip) for r in got] == [(0, True), (0, True), (1, True), (0, True)]
    ids = spark.createDataFrame([(None,), ([],), ([64, 65],)], "tokens array<int>")
    assert [r[0] for r in ids.select(bpe.decode_tokens(ids)).collect()] == [None, "", "ab"]
    assert docs.where("false").select(bpe.encode_text(docs).alias("v")).count() == 0


def test_pieces_that_sums_modulo_two_to_the_64_confuse(other):
    x = "a"
    while len(x) < 4096:
        x += x.translate({97: "b", 98: "a"})
    y = x.translate({97: "b", 98: "a"})
    assert encoded([f"{x} {y}", y]) == [other.encode_ordinary(f"{x} {y}"), other.encode_ordinary(y)]
