"""What every operator over documents has to stand: nulls everywhere, no rows, repeated rows, one very long text, clashing names."""

import pytest
from pyspark.sql import functions as F

from textloom.llm import bpe, chat, decontaminate, language_id, line_dedup, ngram_join, quality, secrets, substring_dedup, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["tl_doc", "tl_text", "tl_c0", "tl_lines", "tl_spans", "tl_gone", "tl_v0", "v", "bucket", "c0", "key", "node", "component", "spans", "doc_ids"]
ITEM = "which of these seven rivers runs the longest way down to the northern sea each year"
PROSE = "The house stands by the sea, and the garden is full of roses that the wind moves. "


def column(f):
    return lambda docs, items: docs.select("doc_id", f(docs).alias("out"))


OPERATORS = {
    "substring": lambda docs, items: substring_dedup.repeated_spans(docs),
    "substring_cut": lambda docs, items: substring_dedup.without_repeats(docs),
    "quality": column(quality.compression_bands),
    "ngram": lambda docs, items: ngram_join.classes(docs),
    "ngram_pairs": lambda docs, items: ngram_join.similar(docs),
    "language": column(language_id.identify),
    "decontaminate": lambda docs, items: decontaminate.contaminated(docs, items),
    "lines": lambda docs, items: line_dedup.removed_lines(docs),
    "bpe": column(bpe.encode_text),
    "secrets": column(secrets.scan_text),
}
STAGES = {"language": language_id.stage, "lines": line_dedup.stage, "ngram": ngram_join.stage, "decontaminate": decontaminate.stage, "bpe": bpe.stage}


def rows():
    long = " ".join(f"w{k % 9973} said{k}" for k in range(60_000))
    return [
        (1, PROSE * 3, "en", "a", 3),
        (1, PROSE * 3, "en", "a", 3),
        (2, None, None, None, None),
        (None, PROSE, "en", "a", 1),
        (3, "", "en", None, 0),
        (4, " \n\t\n ", None, "b", None),
        (5, long, "en", "b", len(long)),
        (6, f"Before it. {ITEM}. After it.", "en", "c", 9),
        (7, "one single line of words that stands alone here", "en", "c", 9),
        (8, "one single line of words that stands alone here", "en", "c", 9),
    ]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit("x"))
    return docs, spark.createDataFrame([(1, ITEM), (None, "a b c"), (2, None), (3, "")], "item_id long, text string")


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(tables, name):
    docs, items = tables
    out = OPERATORS[name](docs, items)
    keys = [c for c in out.columns if c in ("doc_id", "doc_a")]
    found = {r[0] for r in out.select(keys[0]).collect()}
    if name in ("substring", "lines"):
        assert found == {8}
    elif name == "ngram_pairs":
        assert found == set()
    elif name == "ngram":
        assert found == {7, 8}
    elif name == "decontaminate":
        assert found == {6}
    else:
        assert out.count() == docs.count()
    assert OPERATORS[name](docs.where("false"), items.where("false")).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages(spark, tables, tmp_path, name):
    docs, items = tables
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    out = STAGES[name](spark, docs, str(tmp_path))
    assert out.columns[: len(SCHEMA.split(", "))] == [c.split()[0] for c in SCHEMA.split(", ")]
    if name != "bpe":
        assert out.columns == docs.columns
    got = [r.doc_id for r in out.select("doc_id").collect()]
    # the long text is made of numbered nonsense
    gone = {"lines": {8}, "ngram": {8}, "language": {5}}.get(name, set())
    assert {1, 2, 3, 4, 5, 6, 7, 8, None} - set(got) == gone
    assert got.count(1) == 2
    assert STAGES[name](spark, docs.where("false"), str(tmp_path)).count() == 0


def test_answers_do_not_hang_on_partitions(tables):
    docs, items = tables
    for name in ("substring", "lines", "ngram"):
        a, b = ({str(r) for r in OPERATORS[name](docs.repartition(k), items).collect()} for k in (1, 7))
        assert a == b


def test_conversations_and_records(spark):
    turns = spark.createDataFrame([(1, 1, None, None), (1, 1, None, None), (None, 2, "user", "x"), (2, None, "assistant", "")], "conv_id long, turn long, role string, text string").withColumn("tl_x", F.lit(1))
    assert chat.format_chats(turns).count() == 3
    assert chat.format_chats(turns.where("false")).count() == 0
    pages = spark.createDataFrame([(1, None, None), (None, "http://x.org", "<p>"), (1, None, None)], "page_id long, url string, html string")
    warc.assemble(warc.records_of_pages(pages)).collect()
