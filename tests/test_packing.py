"""Chunks of documents: limits, overlap, spans, errors; plans against the procedure."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from textloom.errors import CallbackError, InvalidInputError, MissingTokenCounterError
from textloom.functions.gather import gathered
from textloom.operators.documents import chunk_documents, split_errors, words
from textloom.operators.packing import Finder, Limits, _sections, pack, packed_paragraphs
from textloom.operators.spans import places
from textloom.plans.queries import QUERIES
from textloom.sources import tables

TEXT = "# Intro\nFirst, one thing; then another. Second here. Third there, too. \n## Next\nFourth one. Fifth, at last. Sixth."


@pytest.mark.parametrize(
    "text, part, span",
    [
        ("Good morning", "Good morning", (0, 12)),
        ("Good morning", "morning", (5, 12)),
        ("Good, morning! Stop.", "Good morning", (0, 12)),
        ("Stop... Rust is fun.", "Rust is fun", (8, 19)),
        ("No--yes perhaps", "No yes perhaps", (0, 13)),
        ("Good morning", "evening", (-1, -1)),
        ("Good morning", "!?", (-1, -1)),
        ("", "x", (-1, -1)),
    ],
)
def test_spans(text, part, span):
    assert Finder(text).find(part) == span


def test_limits_hold():
    sentences = [f"Sentence number {k} has words." for k in range(50)]
    for n in (1, 2, 7):
        assert pack(sentences, Limits(max_sentences=n, overlap_percent=0)) == ["\n".join(sentences[i : i + n]) for i in range(0, 50, n)]
    for c in pack(sentences, Limits(max_tokens=17, overlap_percent=0), words):
        assert words(c) <= 17


def test_overlap_and_marker():
    s = ["One, two, three, four, five.", "six, seven.", "Eight."]
    assert pack(s, Limits(max_sentences=2, overlap_percent=30)) == ["\n".join(s[:2]), "... six,\nseven.", "seven.\nEight."] or pack(s, Limits(max_sentences=2, overlap_percent=30))[1].startswith("... ")


def test_fitted_clauses_repeat_only_in_compat():
    s = ["a a a a a a a a a a", "b b, c c c c c c c c c c."]
    kept = pack(s, Limits(max_tokens=12, overlap_percent=0), words)
    assert kept == ["a a a a a a a a a a\nb b,", "b b, c c c c c c c c c c."]
    assert pack(s, Limits(max_tokens=12, overlap_percent=0, compat=False), words) == ["a a a a a a a a a a\nb b,", "c c c c c c c c c c."]


def test_long_unpunctuated_text_ends_with_dots():
    assert pack(["word " * 100], Limits(max_tokens=30, overlap_percent=0), words)[0].endswith("...")


def test_counter_that_fails():
    for bad in (lambda t: "3", lambda t: None, lambda t: 1 / 0):
        with pytest.raises(CallbackError):
            pack(["a b"], Limits(max_tokens=12), bad)
    assert pack(["a b"], Limits(max_tokens=12), lambda t: 3.7) == ["a b"]


def test_arguments(spark):
    df = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    for bad in ({}, {"max_tokens": 11, "token_counter": words}, {"max_sentences": 0}, {"max_sentences": True}, {"max_sentences": 2, "overlap_percent": 76}, {"max_sentences": 2, "offset": -1}, {"max_sentences": 1, "on_errors": "x"}):
        with pytest.raises(InvalidInputError):
            chunk_documents(df, **bad)
    with pytest.raises(MissingTokenCounterError):
        chunk_documents(df, max_tokens=20)


@pytest.mark.parametrize("limits", [{"max_sentences": 2}, {"max_section_breaks": 1}])
def test_plan_of_expressions_agrees_with_the_procedure(spark, limits):
    df = spark.createDataFrame([(1, TEXT), (2, ""), (3, None), (4, "No heading. Here."), (5, TEXT + "\n" + TEXT)], "doc_id long, text string")
    cols = ["doc_id", "chunk_num", "content"]
    plain = chunk_documents(df, overlap_percent=0, spans=False, **limits).select(cols).orderBy(*cols[:2]).collect()
    assert plain == chunk_documents(df, overlap_percent=0, **limits).select(cols).orderBy(*cols[:2]).collect()
    assert {r.doc_id for r in plain} == {1, 4, 5}


def test_offset(spark):
    df = spark.createDataFrame([(1, "A one. B two. C three.")], "doc_id long, text string")
    assert [r.content for r in chunk_documents(df, max_sentences=5, offset=2).collect()] == ["C three."]
    assert chunk_documents(df, max_sentences=5, offset=9).count() == 0


def test_errors(spark):
    def counter(t):
        if "fail" in t:
            raise ValueError("no")
        return len(t.split())

    df = spark.createDataFrame([(1, "All is fine."), (2, "This must fail."), (3, "Fine again.")], "doc_id long, text string")
    args = {"max_tokens": 12, "token_counter": counter}
    with pytest.raises(Exception, match="CallbackError"):
        chunk_documents(df, **args).collect()
    good, bad = split_errors(chunk_documents(df, on_errors="skip", **args))
    assert sorted(r.doc_id for r in good.collect()) == [1, 3]
    assert [(r.doc_id, r.error_class) for r in bad.collect()] == [(2, "CallbackError")]
    assert [r.doc_id for r in chunk_documents(df, on_errors="break", **args).collect()] == [1]


def test_paragraphs():
    assert packed_paragraphs(["a" * 3000, "b" * 1000, "c", "d" * 5000]) == ["a" * 3000 + "\n" + "b" * 1000, "c", "d" * 5000]
    assert packed_paragraphs([]) == []


def test_token_query_against_the_procedure(spark):
    """The registered query's plan, document by document, against the splitter and the packing in Python."""
    from textloom.functions.plain import plain_sentences
    from textloom.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {}
    for r in QUERIES["chunk_tokens_fit"](spark, sf).orderBy("doc_id", "chunk_num").collect():
        got.setdefault(r.doc_id, []).append((r.content, r.start, r.end))
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        find = Finder(d.text or "").find
        want = [(c.strip(), *find(c.removeprefix("..."))) for c in pack(plain_sentences(d.text or ""), Limits(max_tokens=60, overlap_percent=20), words)]
        assert got.get(d.doc_id, []) == want


def test_paragraphs_are_packed_without_strings_of_python():
    import random

    r = random.Random(5)
    given = [None, [], [""], ["é" * 30, "x"]] + [["ü" * r.randrange(25) for _ in range(r.randrange(30))] for _ in range(300)]
    for most, joiner in ((40, "\n"), (0, "--"), (4000, "\n\n")):
        want = [None if p is None else packed_paragraphs(p, most, joiner) for p in given]
        got = _sections(pa.array([["dropped"], *given], pa.list_(pa.string()))[1:], most, joiner)
        assert got.to_pylist() == want and got.type == pa.list_(pa.string())
    with pytest.raises(TypeError):
        _sections(pa.array([["a", None]]), 40, "\n")


def test_places_of_all_parts_of_a_text(spark):
    rows = [(1, "aé. b aé 漢字 b\U0001f600 x", ["aé", "b", "字", "\U0001f600 x", "", "not there", "b"]), (2, "abab", ["ab", "b", "ba"]), (3, None, ["a"]), (4, "a", None), (5, "", []), (6, "plain", ["in", "z"])]
    df = spark.createDataFrame(rows, "k int, t string, p array<string>").repartition(1)
    got = {r.k: r.x and [tuple(y) for y in r.x] for r in df.select("k", places(df.t, df.p).alias("x")).collect()}
    assert got == {k: p and [(-1 if t is None else t.find(x), len(x)) for x in p] for k, t, p in rows}


def test_texts_are_not_copied_for_each_sentence(spark):
    for name in ("span_exact", "chunk_overlaps", "position_cover"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        made = [line for line in plan.split("\n") if "Generate posexplode" in line]
        # what is exploded carries no text along
        assert made and not any("text#" in line.split("[", 1)[-1] for line in made)


def test_tasks_dont_grow_with_a_file_of_one_row_group(spark, tmp_path, monkeypatch):
    pq.write_table(pa.table({"x": list(range(20_000))}), tmp_path / "t.parquet")
    df = spark.read.parquet(str(tmp_path / "t.parquet"))
    assert tables.dealt(df).rdd.getNumPartitions() == 4
    monkeypatch.setattr(tables, "SHARE", (tmp_path / "t.parquet").stat().st_size // 10)
    assert tables.dealt(df).rdd.getNumPartitions() >= 10 and tables.dealt(df).count() == 20_000


def test_finder_holds_no_list_of_places():
    text = "Añ, b²! " * 1000
    found = Finder(text)
    assert not isinstance(found.at, list) and found.at.dtype.itemsize <= 8
    assert found.find("b² Añ") == (4, 9) and found.clean == "Añb²" * 1000


def test_chunks_are_held_as_values_of_python_a_few_at_a_time():
    alive = most = 0

    class Held(str):
        def __new__(cls, x):
            nonlocal alive, most
            alive += 1
            most = max(most, alive)
            return super().__new__(cls, x)

        def __del__(self):
            nonlocal alive
            alive -= 1

    got = gathered((Held("x" * 1000) for _ in range(20_000)), pa.string(), len)
    assert len(got) == 20_000 and got.nbytes > 20_000_000 and most < 1500
    assert gathered([], pa.string(), len).to_pylist() == [] and gathered(["a", None], pa.string(), lambda t: len(t or "")).to_pylist() == ["a", None]
