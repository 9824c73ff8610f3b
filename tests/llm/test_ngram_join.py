"""The n-gram join against every pair of documents."""

import random
import re
import time
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import ngram_join as J
from textloom.llm.common import DROP_SHUFFLES
from textloom.llm.graph import components


def grams(text, n):
    w = [x.lower() for x in re.findall(r"[^\W_]+", text or "")]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def kinds_of(docs, n):
    sets = {}
    for d, text in docs:
        if d is not None and (g := grams(text, n)):
            sets.setdefault(g, set()).add(d)
    return list(sets.items())


def brute(docs, n, t):
    """Pairs of distinct sets."""
    kinds, out = kinds_of(docs, n), []
    for i, (a, da) in enumerate(kinds):
        for b, db in kinds[:i]:
            o = len(a & b)
            j = o / (len(a) + len(b) - o)
            if j >= t - 1e-12:
                (x, p), (y, q) = sorted(((min(da), len(a)), (min(db), len(b))))
                out.append((x, y, p, q, o, round(j, 9)))
    return sorted(out)


def brute_classes(docs, n, t):
    """What every similar pair of documents says, counted one by one."""
    kinds = kinds_of(docs, n)
    of = {d: g for g, ds in kinds for d in ds}
    link = {d: d for d in of}

    def root(x):
        while link[x] != x:
            x = link[x]
        return x

    out = {}
    for d, g in of.items():
        copies = [e for e, h in of.items() if e != d and h == g]
        near = []
        for h, ds in kinds:
            if h != g and (o := len(g & h)) / (len(g) + len(h) - o) >= t - 1e-12:
                near.append((-o / (len(g) + len(h) - o), min(ds), ds))
        docs_ = [e for *_, ds in near for e in ds]
        for e in copies + docs_:
            link[max(root(d), root(e))] = min(root(d), root(e))
        if copies or near:
            best = min(near)[:2] if near else (None, None)
            out[d] = (len(copies), len(near), len(copies) + len(docs_), best[1], None if best[0] is None else round(-best[0], 9))
    return {d: (root(d), *x) for d, x in out.items()}


def some_docs(copies=6):
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(400)] + ["the", "of", "Éa"] * 40
    docs = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 12, 60, 300, 1500]))]
        for _ in range(rng.randrange(1, copies)):
            x = list(base)
            for _ in range(rng.choice([0, 0, 1, len(x) // 30, len(x) // 12, len(x) // 6])):
                k = rng.randrange(len(x))
                x[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [rng.choice(vocab), x[k]]])
                x = x or ["w"]
            docs.append((len(docs) * 7 % 1000, rng.choice([" ", ", ", "\n"]).join(x).capitalize()))
    return [*docs, (2000, None), (2001, ""), (2002, "..."), (None, docs[0][1]), docs[3]]


def result(df):
    return sorted((r.doc_a, r.doc_b, r.size_a, r.size_b, r.overlap, round(r.jaccard, 9)) for r in df.collect())


def class_result(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: (r.class_id, r.n_copies, r.n_texts, r.n_links, r.nearest_id, None if r.nearest_jaccard is None else round(r.nearest_jaccard, 9)) for r in rows}


@pytest.mark.parametrize("block", [J.Settings().block, 2])
def test_all_pairs(spark, block):
    docs = some_docs(12)
    s = replace(J.Settings(), block=block)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs, s.n, s.jaccard)
    assert len(want) > 30
    assert result(J.similar(df, s)) == want
    assert class_result(J.classes(df, s)) == brute_classes(docs, s.n, s.jaccard)


@pytest.mark.parametrize("seed", range(3))
def test_few_kinds_of_words(spark, seed):
    """Sets that share much by chance, at every bound."""
    rng = random.Random(seed)
    docs = [(k, " ".join(rng.choice("abcd") for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 20, 40])))) for k in range(90)]
    s = J.Settings(n=rng.choice([1, 2, 3]), jaccard=rng.choice([0.3, 0.5, 0.75, 0.9]), block=rng.choice([3, 1000]))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert result(J.similar(df, s)) == brute(docs, s.n, s.jaccard)
    assert class_result(J.classes(df, s)) == brute_classes(docs, s.n, s.jaccard)


def test_all_pairs_of_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = class_result(J.op4_ngram_join(spark, "/root/testdata/sf0.001"))
    assert got == brute_classes(docs, J.Settings().n, J.Settings().jaccard) and got


def test_groups_of_copies(spark):
    """Five copies of one text and three of another one near it: every link counts."""
    one = " ".join(f"w{k}" for k in range(40))
    docs = [(k, one) for k in range(1, 6)] + [(k, one + " end") for k in range(6, 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert [(r.doc_a, r.doc_b) for r in J.similar(df).collect()] == [(1, 6)]
    got = class_result(J.classes(df))
    assert {d: x[:5] for d, x in got.items()} == {d: (1, 4, 1, 7, 6) for d in range(1, 6)} | {d: (1, 2, 1, 7, 1) for d in range(6, 9)}


def test_a_key_with_two_texts(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    df = spark.createDataFrame([(5, a), (5, b), (2, a), (9, b + " more"), (9, b + " more")], "doc_id long, text string")
    assert {d: x[:4] for d, x in class_result(J.classes(df)).items()} == {2: (2, 1, 0, 1), 5: (2, 1, 1, 2), 9: (2, 0, 1, 1)}


def test_groups_of_more_blocks_than_46341():
    """Block numbers of a tile are kept apart, whatever their size."""
    n = np.array([3, 3, 3, 3])
    columns = [np.zeros(4, np.int64), np.array([30000, 30000, 70000, 70000], np.int32), np.array([70000, 70000, 70001, 70001], np.int32), np.array([0, 1, 0, 1], np.int8), np.arange(4), np.arange(4).astype(np.uint64), np.ones(4, np.int64), n, np.tile(np.arange(3, dtype=np.uint64), 4)]
    (b,) = J._pair_rows(J.Settings())(*columns)
    assert sorted(zip(b.column("doc_a").to_pylist(), b.column("doc_b").to_pylist())) == [(0, 1), (2, 3)]


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_components(spark, small):
    rng = random.Random(small)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2040)] + [(None, 5), (7, 7)]
    link = {}

    def root(x):
        while link.setdefault(x, x) != x:
            x = link[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            link[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components(df, small).collect()} == {x: root(x) for x in link}
    if not small:
        assert {r.node for r in components(df.select(F.col("a").cast("string"), F.col("b").cast("string")), small).collect()} == {str(x) for x in link}
    assert components(df.limit(0), small).count() == 0


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert J.similar(none).count() == J.classes(none).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    a = " ".join(f"a{k}" for k in range(50))
    docs = [(5, a), (3, a + " more"), (9, a.upper()), (4, "something else"), (6, None), (None, a)]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, tl_group string, doc_a string")
    out = J.stage(spark, df, "")
    assert out.columns == df.columns
    assert {(r.doc_id, r.text) for r in out.collect()} == {(3, a + " more"), (4, "something else"), (6, None), (None, a)}


def test_words_that_sums_modulo_two_to_the_64_confuse(spark):
    """Thue-Morse words differ in every letter, and their sums modulo a power of two are one, whatever the base."""
    x = "a"
    while len(x) < 4096:
        x += x.translate({97: "b", 98: "a"})
    docs = [(1, f"one two {x}"), (2, f"one two {x.translate({97: 'b', 98: 'a'})}")]
    assert J.classes(spark.createDataFrame(docs, "doc_id long, text string")).count() == 0


def shuffled(spark):
    """Bytes of each shuffle file that is on disk."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f: f.stat().st_size for d in dirs for f in Path(d.getPath()).rglob("shuffle_*.data")}


def test_shuffle_files_go_when_a_step_is_written(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(5000)}" for _ in range(1500)] for _ in range(100)]
    docs = [(2 * k + c, " ".join(x + ["end"] * c)) for k, x in enumerate(base) for c in (0, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    before, was = shuffled(spark), spark.conf.get(DROP_SHUFFLES, None)
    found = J.classes(df)
    most, until = sum(len(t) for _, t in docs) // 8, time.monotonic() + 20
    while (left := sum(n for f, n in shuffled(spark).items() if f not in before)) > most and time.monotonic() < until:
        time.sleep(0.2)
    # texts, grams and sets have been shuffled; what is left are ids and edges
    assert left <= most
    assert spark.conf.get(DROP_SHUFFLES, None) == was
    assert found.count() == len(docs)
