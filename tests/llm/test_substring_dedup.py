"""Substring dedup against a search through every line and every stretch of words."""

import random
import re

from textloom.llm import substring_dedup as S


def words(t):
    return [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", t or "")]


def brute(docs, s):
    lines, where = {}, {}
    gone_lines, gone_words = set(), set()
    for d, t in sorted({(d, t) for d, t in docs if d is not None and t}):
        at = 0
        for x in t.split("\n"):
            w = tuple(k[2] for k in words(x))
            if len(w) >= s.min_words:
                if lines.setdefault(w, (d, at)) != (d, at):
                    gone_lines.add((d, at, at + len(x), *lines[w]))
            at += len(x) + 1
        w = words(t)
        for i in range(len(w) - s.window + 1):
            k = tuple(x[2] for x in w[i : i + s.window])
            if where.setdefault(k, (d, w[i][0])) != (d, w[i][0]):
                gone_words |= {(d, x[0], x[1]) for x in w[i : i + s.window]}
    return gone_lines, gone_words


def some_docs():
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(60)] + ["é", "the", "A", "中文"]
    say = lambda n: rng.choice([" ", ", "]).join(rng.choice(vocab) for _ in range(n))
    shared = [say(n) for n in (6, 9, 14, 14, 25, 40)]
    docs = []
    for k in range(70):
        parts = []
        for _ in range(rng.randrange(6)):
            parts.append(rng.choice([say(rng.randrange(12)), rng.choice(shared), rng.choice(shared).upper() + "!", "the " * rng.randrange(30)]))
            parts.append(rng.choice(["\n", " ", ". ", "\n\n"]))
        docs.append((k * 3 % 71, "".join(parts)))
    return [*docs, (300, None), (301, ""), (302, "\n"), (None, shared[5]), docs[4]]


def test_brute_force(spark):
    docs, s = some_docs(), S.Settings(window=10, run=4, min_words=3)
    rows = S.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), s).collect()
    lines, gone = brute(docs, s)
    assert {(r.doc_id, r.start, r.end, r.kept_doc_id, r.kept_start) for r in rows if r.unit == "line"} == lines and len(lines) > 20
    text = dict(x for x in docs if x[0] is not None)
    spans = [(r.doc_id, r.start, r.end) for r in rows if r.unit == "passage"]
    assert {(d, w[0], w[1]) for d, a, b in spans for w in words(text[d]) if a <= w[0] and w[1] <= b} == gone and len(gone) > 100
    for x, y in zip(sorted(spans), sorted(spans)[1:]):
        assert x[0] != y[0] or x[2] < y[1]


def test_passage_inside_lines(spark):
    rng = random.Random(1)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(55))
    docs = [(1, f"one two {passage} three"), (2, f"four\nfive {passage.upper()}, six"), (3, "clean words " * 3 + " ".join(f"c{k}" for k in range(90)))]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, tl_doc string, unit string")
    (r,) = S.repeated_spans(df).collect()
    assert (r.doc_id, r.unit, r.kept_doc_id, docs[1][1][r.start : r.end]) == (2, "passage", 1, passage.upper())
    out = S.without_repeats(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: docs[0][1], 2: "four\nfive , six", 3: docs[2][1]}


def test_empty_table_and_long_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.repeated_spans(none).count() == 0
    rows = S.repeated_spans(spark.createDataFrame([(1, "same " * 400_000)], "doc_id long, text string")).collect()
    assert [(r.unit, r.start, r.end, r.kept_start) for r in rows] == [("passage", 5, 1_999_999, 0)]


def thue_morse(n):
    """Two words that differ in every letter; sums modulo a power of two can't tell them apart, whatever their base."""
    x = "a"
    while len(x) < n:
        x += x.translate({97: "b", 98: "a"})
    return x, x.translate({97: "b", 98: "a"})


def test_words_that_sums_modulo_two_to_the_64_confuse(spark):
    a, b = thue_morse(4096)
    docs = [(1, f"one two three four {a}"), (2, f"one two three four {b}")]
    assert S.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).count() == 0


def test_a_line_and_a_passage_of_every_document(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    docs = [(k, f"the same line in all of them\nown{k} {passage} end{k}") for k in range(60, 0, -1)]
    rows = S.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in rows if r.unit == "line"} == {(k, 1) for k in range(2, 61)}
    found = [r for r in rows if r.unit == "passage"]
    assert sorted(r.doc_id for r in found) == list(range(2, 61)) and all(dict(docs)[r.doc_id][r.start : r.end].endswith(passage) and r.kept_doc_id < r.doc_id for r in found)
