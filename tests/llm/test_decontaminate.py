"""Decontamination against brute-force search for common stretches of words."""

import pickle
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import decontaminate as D
from textloom.llm import kernels as K


def words(t):
    return [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", t or "")]


def brute(text, items, lim):
    """Spans by comparing every stretch of the text with every item."""
    w = words(text)
    ws = [x[2] for x in w]
    its = [(i, [x[2] for x in words(t)]) for i, t in items]
    least = [min(lim.shortest, len(x)) for _, x in its]
    common = {}  # stretch of the text: items and their words
    for s in range(len(ws)):
        for e in range(s + 1, len(ws) + 1):
            at = {(k, p) for k, (_, x) in enumerate(its) if e - s >= least[k] > 0 for p in range(len(x) - (e - s) + 1) if x[p : p + e - s] == ws[s:e]}
            if at:
                common[s, e] = at
    covered = {}
    for (s, e), at in common.items():
        for k, p in at:
            covered.setdefault(k, set()).update(range(p, p + e - s))
    share = {k: len(c) / len(its[k][1]) for k, c in covered.items()}
    out = []
    for s, e in common:
        if any((x, y) != (s, e) and x <= s and e <= y for x, y in common):
            continue
        ks = {k for k, _ in common[s, e]} | {k for (x, y), at in common.items() if s <= x and y <= e for k, _ in at if share[k] >= lim.coverage}
        most = max(share[k] for k in ks)
        if e - s >= lim.length or most >= lim.coverage:
            out.append((w[s][0], w[e - 1][1], e - s, round(float(np.float32(most)), 5), tuple(its[k][0] for k in sorted(ks))))
    return sorted(out)


def flat(spans):
    return sorted((s["start"], s["end"], s["n_words"], round(float(np.float32(s["coverage"])), 5), tuple(s["items"])) for s in spans)


def cases():
    rng = random.Random(3)
    vocab = "a b c d é f the of".split()
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(2, 30)))) for k in range(15)] + [(90, None), (91, ""), (92, "a " * 12)]
    docs = []
    for k in range(80):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            if rng.random() < 0.6:
                x = (rng.choice(items)[1] or "").split()
                a = rng.randrange(len(x) + 1)
                parts.append(rng.choice([", ", " ", "\n"]).join(x[a : a + rng.randrange(25)]).upper())
            else:
                parts.append(" ".join(rng.choice([*vocab, "zz"]) for _ in range(rng.randrange(20))))
        docs.append((k, "! ".join(parts)))
    return items, [*docs, (200, None), (201, ""), (None, items[0][1])]


@pytest.mark.parametrize("shard_words", [5, 60, 10**6])
def test_brute_force(spark, shard_words):
    """Whatever number of automata the items are in."""
    items, docs = cases()
    lim = D.Limits(shortest=3, length=6, coverage=0.6, shard_words=shard_words)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    idf = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    want = {d: x for d, t in docs if d is not None and (x := brute(t, [(i, t) for i, t in items if t], lim))}
    got = {r.doc_id: flat(s.asDict() for s in r.spans) for r in D.contaminated(df, idf, lim).collect()}
    assert len(want) > 20
    assert got == want


def test_more_limits():
    items, docs = cases()
    items = [(i, t) for i, t in items if t]
    for lim in (D.Limits(3, 12, 0.5), D.Limits(5, 9, 0.3), D.Limits(1, 2, 1.0)):
        a = D.Automaton([(n, i, K.words(pa.array([t])).hash) for n, (i, t) in enumerate(items)], lim.shortest)
        assert [flat(x) for x in D.spans(pa.array([t for _, t in docs]), [a], lim)] == [brute(t, items, lim) for _, t in docs]


def test_items_that_share_stretches(spark):
    """A longer item around another one doesn't hide it."""
    a, b = [f"a{k}" for k in range(100)], [f"a{k}" for k in range(24, 32)]
    items = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x y " + " ".join(a[20:32]) + " z")], "doc_id long, text string")
    (r,) = D.contaminated(docs, items).collect()
    assert [(s.n_words, s.coverage, s["items"]) for s in r.spans] == [(12, 1.0, [1, 2])]


def test_short_items(spark):
    items = spark.createDataFrame([(1, "What is it called?"), (2, "w1 w2 w3")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "what is IT called"), (2, "so what is it called then"), (3, "what is it"), (4, "a w1 w2, w3.")], "doc_id long, text string")
    for lim in (D.Limits(), D.Limits(shard_words=1)):
        assert {r.doc_id: [(s.start, s.end, s["items"]) for s in r.spans] for r in D.contaminated(docs, items, lim).collect()} == {1: [(0, 17, [1])], 2: [(3, 20, [1])], 4: [(2, 11, [2])]}


def test_many_words_take_little():
    """Some 60 bytes a word, as the docstring says, when it is sent."""
    rng = random.Random(5)
    items = [(k, k, np.array([rng.randrange(1, 20_000) for _ in range(100)], np.uint64)) for k in range(1000)]
    a = D.Automaton(items, 6)
    assert len(pickle.dumps(a)) < 60 * 100_000 + 3_000_000
    (s,) = D.decided([p for k in (7,) for p in [D.Piece(0, 100, 0, 1, k, k, 0, 100)]], D.Limits())
    assert s["coverage"] == 1
    got = list(a.matched(items[7][2].tolist()))
    assert (100, 7, 100, 100) in got


def test_item_inside_another(spark):
    b = " ".join(f"w{k}" for k in range(8))
    a = " ".join(f"a{k}" for k in range(20))
    items = spark.createDataFrame([(1, f"{a} v {b} w {a}"), (2, b)], "item_id long, text string")
    docs = [(1, f"x {b} w y"), (2, f"x v {b} y"), (3, f"x v {b} w y"), (4, "x w1 w2 w3 w4 w5 y")]
    rows = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {r.doc_id: [(s.n_words, s.coverage, s["items"]) for s in r.spans] for r in rows} == {d: [(n, 1.0, [1, 2])] for d, n in ((1, 9), (2, 9), (3, 10))}


def test_repeated_rows_and_rounds(spark, tmp_path):
    """Equal rows stay two rows, rows of one key with other texts keep to themselves, in one round and in several."""
    item = " ".join(f"w{k}" for k in range(20))
    docs = [(1, f"x {item}"), (1, f"x {item}"), (1, f"longer before {item} y"), (2, "clean"), (None, item)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "v " * 30)], "item_id long, text string").coalesce(1)
    for n in (10**6, 5):
        rows = D.contaminated(df, items, D.Limits(shard_words=n)).collect()
        assert sorted((r.doc_id, r.spans[0].start) for r in rows) == [(1, 2), (1, 2), (1, 14)]


def test_no_items_and_no_docs(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, none).count() == 0
    assert D.contaminated(docs.limit(0), none).count() == 0


def test_long_text():
    item = " ".join(f"w{k}" for k in range(40))
    text = "x " * 300_000 + item + " y" * 300_000
    a = D.Automaton([(0, 1, K.words(pa.array([item])).hash)], 6)
    (span,) = D.spans(pa.array([text]), [a], D.Limits())[0]
    assert text[span["start"] : span["end"]] == item and span["coverage"] == 1


def test_stage(spark, tmp_path):
    item = " ".join(f"w{k}" for k in range(20))
    spark.createDataFrame([(1, item), (2, "other words")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(1, f"before {item.upper()} after", 0), (2, item, 0), (3, None, None), (4, "clean text", 10), (None, item, 5)]
    df = spark.createDataFrame([(*d, "q") for d in docs], "doc_id long, text string, n_chars long, spans string")
    for n in (10**6, 1):
        out = D.stage(spark, df, str(tmp_path), D.Limits(shard_words=n))
        assert out.columns == df.columns
        check_stage(out, item)


def check_stage(out, item):
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, "before  after", 13), (3, None, None), (4, "clean text", 10), (None, item, 5)}
