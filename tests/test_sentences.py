"""Sentence splitting, cleaning, routing and the functions on text."""

import pytest
from pyspark.sql import functions as F

from textloom.errors import CallbackError, InvalidInputError
from textloom.functions import text as T
from textloom.operators import sentences as S
from textloom.operators.detect import detect
from textloom.operators.registry import Registry, splitters


def one(spark, f, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in df.orderBy("k").select(f(F.col("t"))).collect()]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("One here. Two there! Three? yes.", ["One here.", "Two there!", "Three? yes."]),
        ("Ask Dr. Who about it. Then go.", ["Ask Dr. Who about it.", "Then go."]),
        ('He said "Stop. Now." and left. She stayed.', ['He said "Stop. Now." and left.', "She stayed."]),
        ("See (it is. So what) here. End.", ["See (it is. So what) here.", "End."]),
        ("Line one\nline two\n\nline three", ["Line one", "line two", "line three"]),
        ("एक वाक्य। दूसरा वाक्य।", ["एक वाक्य।", "दूसरा वाक्य।"]),
        ("これは文。次の文。", ["これは文。次の文。"]),
        ("これは文。 次の文。", ["これは文。", "次の文。"]),
        ("  \n ", []),
        ("", []),
        (None, None),
        ("What\n!?!?!?!\nNext", ["What!?!?!", "Next"]),
        ("!!!!\nNext", ["!!", "Next"]),
        ("A\n---\nB", ["A", "---", "B"]),
    ],
)
def test_sentences(spark, text, expected):
    assert one(spark, T.sentences, text) == [expected]


def test_rows_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "x", "It is one. And two."), (2, "y", None), (3, "z", "")], "doc_id long, sentence_of string, text string")
    got = [tuple(r) for r in S.split_sentences(df).select("doc_id", "sentence_of", "sent_num", "sentence").orderBy("sent_num").collect()]
    assert got == [(1, "x", 1, "It is one."), (1, "x", 2, "And two.")]


def test_clauses_headings_counts(spark):
    assert one(spark, T.clauses, "a, b; c — d e") == [["a,", "b;", "c —", "d e"]]
    heads = ["# x", "####### x", "---", "* * *", "text", "<hr/>", "</section>", "#x", None]
    assert one(spark, T.is_section_break, *heads) == [True, False, True, False, False, True, True, False, None]
    assert one(spark, T.word_tokens, "a b\n c", "  ", "", None) == [3, 0, 0, None]
    assert one(spark, T.alnum, "a-b_1 é!") == ["ab1é"]
    assert one(spark, T.collapse_newlines, "a\n\n\n\nb\n\nc") == ["a\n\nb\n\nc"]


def test_detection(spark):
    code = lambda t: detect(t)["code"]
    assert one(spark, code, "the cat is on the mat and it was not with them", "der Hund und die Katze sind nicht in dem Haus", "Это предложение", "12345", None) == ["en", "de", "ru", "und", None]


def test_splitters_of_users(spark):
    splitters.register("xx", lambda t: t.split("X"), name="by X")
    try:
        df = spark.createDataFrame([("aXbXc", "xx"), ("It is one. And two.", "en")], "text string, lang string")
        assert [r[0] for r in df.select(S.sentence_column(F.col("text"), F.col("lang"))).collect()] == [["a", "b", "c"], ["It is one.", "And two."]]
    finally:
        splitters.clear()
    assert not splitters.is_registered("xx")


def test_registry_refuses():
    r = Registry("thing", lambda n: None)
    for bad in (lambda: r.register("a", lambda: 1, name="n"), lambda: r.register("a", lambda x: 1), lambda: r.register(lambda x: 1), lambda: r.register("", len)):
        with pytest.raises(InvalidInputError):
            bad()


def test_splitter_of_wrong_type_fails():
    from textloom.operators.registry import call_splitter

    for f in (lambda t: "text", lambda t: [1], lambda t: 1 / 0):
        with pytest.raises(CallbackError):
            call_splitter("f", f, "x")


LANGUAGES = [
    ("de", "Das gilt z. B. Hunden und Katzen, d.h. Tieren. Und so weiter.", ["Das gilt z. B. Hunden und Katzen, d.h. Tieren.", "Und so weiter."]),
    ("en", "See fig. Two and vol. Three of it. Then stop.", ["See fig. Two and vol. Three of it.", "Then stop."]),
    ("ru", "Это см. Рис на стр. Пятнадцать. Потом конец.", ["Это см. Рис на стр. Пятнадцать.", "Потом конец."]),
    ("ja", "これは文。次の文。「彼は。言った」と。終わり", ["これは文。", "次の文。", "「彼は。言った」と。", "終わり"]),
    ("zh", "这是一句。这是第二句！第三句", ["这是一句。", "这是第二句！", "第三句"]),
    ("hi", "यह एक है।यह दो है। तीन", ["यह एक है।", "यह दो है।", "तीन"]),
    ("xx", "Das gilt z. B. Hunden. Ende.", ["Das gilt z.", "B.", "Hunden.", "Ende."]),
]


@pytest.mark.parametrize("code, text, expected", LANGUAGES)
def test_rules_of_languages(spark, code, text, expected):
    assert one(spark, lambda t: S.sentence_column(t, code), text) == [expected]


def test_rules_by_a_column_of_codes(spark):
    df = spark.createDataFrame([(k, c, t) for k, (c, t, _) in enumerate(LANGUAGES)] + [(99, None, "It is one. And two.")], "k int, lang string, text string")
    got = [r[0] for r in df.orderBy("k").select(S.sentence_column(F.col("text"), F.col("lang"))).collect()]
    assert got == [e for *_, e in LANGUAGES] + [["It is one.", "And two."]]


def test_plain_splitter_looks_as_far_as_it_has_to(spark):
    from textloom.functions.plain import plain_sentences

    texts = ["One." + " " * 250 + "two. Three.", "One." + " " * 300 + "Two.", "(" * 3000 + " a. B. c", "'x. Y' (z. Z) w. W"]
    for t, got in zip(texts, one(spark, T.sentences, *texts), strict=True):
        assert plain_sentences(t) == got
