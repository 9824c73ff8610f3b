"""Line dedup against every pair of lines."""

import random

import pytest

from textloom.llm import line_dedup as D


def form(x):
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in x.strip())


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    if len(a) < len(b):
        a, b = b, a
    return a[i + 1 :] == b[i:]


def brute(docs, min_chars):
    found = sorted((d, n, form(x)) for d, t in docs if d is not None for n, x in enumerate((t or "").split("\n")) if len(form(x)) >= min_chars)
    first, out = {}, {}
    for d, n, f in found:
        if (k := first.setdefault(f, (d, n))) != (d, n):
            out[d, n] = (k, 0)
    reps = sorted((k, f) for f, k in first.items())
    for i, (k, f) in enumerate(reps):
        near = next((q for q, g in reps[:i] if within_one(f, g)), None)
        if near:
            out[k] = (near, 1)
    return out


def mutate(rng, x):
    i, r, c = rng.randrange(len(x) + 1), rng.random(), rng.choice("abÀé ")
    return x[:i] + c + x[i:] if r < 0.33 else x[:i] + x[i + 1 :] if r < 0.66 else x[:i] + c + x[i + 1 :]


def some_docs():
    rng = random.Random(5)
    base = ["".join(rng.choice("aabAé  xyz😀") for _ in range(rng.randrange(10, 40))) for _ in range(25)] + ["a" * 20, "ab" * 10, "xé" * 2500]
    docs = []
    for d in range(120):
        lines = []
        for _ in range(rng.randrange(6)):
            x = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                x = mutate(rng, x)
            lines.append(rng.choice(["", " "]) + x + rng.choice(["", "  ", "\t"]))
        docs.append((d, "\n".join(lines)))
    return [*docs, (200, None), (201, ""), (202, "\n\n"), (None, base[0]), (5, docs[5][1])]


def test_all_pairs(spark):
    docs = some_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.line): ((r.kept_doc_id, r.kept_line), r.distance) for r in D.removed_lines(df, min_chars=10).collect()}
    assert got == brute(docs, 10)
    assert {d for _, d in got.values()} == {0, 1}


def test_offsets(spark):
    docs = [(1, "one line that stays here\nanother"), (2, "😀\n One line that stays here \nrest"), (3, "one line that stays hear")]
    rows = {r.doc_id: r for r in D.removed_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(rows) == {2}
    assert docs[1][1][rows[2].start : rows[2].end] == " One line that stays here "


def test_empty_table(spark):
    assert D.removed_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage_cuts_lines_and_keeps_the_rest(spark):
    docs = [(1, "a line that is long enough", 26), (2, "A line that is long enough.\nmore", 33), (3, "a line that is long enough", 26), (4, None, None), (5, "", 0), (None, "a line that is long enough", 26)]
    df = spark.createDataFrame([(*d, "en", "x", "y") for d in docs], "doc_id long, text string, n_chars long, lang string, tl_doc string, lines string")
    out = D.stage(spark, df, "")
    assert out.columns == df.columns
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, docs[0][1], 26), (2, "more", 4), (4, None, None), (5, "", 0), (None, docs[0][1], 26)}


def thue_morse(n):
    """Two words that differ in every letter; sums modulo a power of two can't tell them apart, whatever their base."""
    x = "a"
    while len(x) < n:
        x += x.translate({97: "b", 98: "a"})
    return x, x.translate({97: "b", 98: "a"})


def test_lines_that_sums_modulo_two_to_the_64_confuse(spark):
    docs = list(enumerate(thue_morse(4096)))
    assert D.removed_lines(spark.createDataFrame(docs, "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("parts", [1, 6])
def test_a_line_of_every_document(spark, parts):
    """One line that all documents have, twice each: the earliest of all is named, whatever blocks the others are in."""
    line = "this line stands in every document"
    docs = [(k, f"{line}\nown line of document {k * 7919}{'x' * k}\n{line}") for k in range(50, 0, -1)]
    rows = D.removed_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)).where("distance = 0").collect()
    assert {(r.doc_id, r.line, r.kept_doc_id, r.kept_line) for r in rows} == {(k, n, 1, 0) for k in range(1, 51) for n in (0, 2)} - {(1, 0, 1, 0)} and len(rows) == 99
