"""Language ID: accuracy on texts it wasn't trained on, and the vectors against a slow computation."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import language_id as L

SF = "/root/testdata/sf0.01"


def slow_profile(text, s):
    """The sum over n-grams of the products of rotated letter vectors, one n-gram after another."""
    letters = np.random.default_rng(s.seed).choice(np.array([-1, 1], np.int8), (s.symbols, s.dims)).astype(np.int64)
    slots = L._slots(s.symbols)
    symbols = [0]
    for c in text:
        x = int(slots[ord(c)])
        if x or symbols[-1]:
            symbols.append(x)
    if symbols[-1]:
        symbols.append(0)
    out, n = np.zeros(s.dims, np.int64), 0
    for k in range(len(symbols) - s.order + 1):
        gram = symbols[k : k + s.order]
        if any(gram):
            v = np.ones(s.dims, np.int64)
            for p, x in enumerate(gram):
                v *= np.roll(letters[x], s.order - 1 - p)
            out, n = out + v, n + 1
    return out, n


def test_profiles():
    s = L.Settings(dims=256)
    texts = ["Hello there, you", "", "a", "  ", "ÄÖ ß 12 x", "the end.", "éé\n\né", "b" * 3000]
    got, n = L.profiles(pa.array(texts), s)
    for k, t in enumerate(texts):
        want, m = slow_profile(t, s)
        assert n[k] == m and np.allclose(got[k], want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars >= 200")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = L.train(docs.where(half == 0))
    rest = docs.where(half == 1)
    right, n = rest.select((L.identify(rest, model).getField("lang") == rest.lang).cast("int").alias("ok")).agg(F.sum("ok"), F.count("*")).first()
    assert n > 200 and right / n > 0.95


def test_rejects_noise_keeps_prose(spark):
    rng = np.random.default_rng(1)
    noise = "".join(rng.choice(list("qxzjkvwy0123456789"), 3000))
    docs = spark.createDataFrame([(1, "en", "the house and the garden are by the sea and it was warm " * 20), (2, "de", "das Haus und der Garten sind am Meer und es war warm " * 20), (3, None, noise)], "doc_id long, lang string, text string")
    kept = L.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(None, "en", ""), (1, "en", None)]])
def test_nothing_to_learn_from(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = docs.select(L.identify(docs).alias("v")).select("v.*").collect()
    assert [(r.lang, r.keep) for r in got] == [(None, True)] * len(rows)
