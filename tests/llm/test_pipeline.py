"""The pipeline: each stage's decisions take effect, and what was planted is gone at the end."""

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from textloom.llm import bpe, decontaminate, language_id, line_dedup, ngram_join
from textloom.llm import kernels as K

from . import test_decontaminate, test_line_dedup, test_ngram_join

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontaminate", "bpe"]


def test_whole(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.columns == [*docs.columns, "tokens", "n_tokens", "round_trip"]
    rows = out.collect()
    assert 0 < len(rows) <= docs.count() and all(r.round_trip for r in rows)
    kept = spark.createDataFrame([tuple(r)[:5] for r in rows], docs.schema)
    # nothing is left for the stages to do
    assert line_dedup.removed_lines(kept).count() == 0
    assert ngram_join.classes(kept).count() == 0
    assert decontaminate.contaminated(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    df = out.withColumn("back", bpe.decode_tokens(out))
    assert df.where(F.col("back") != F.col("text")).count() == 0


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_step_by_step(spark):
    """Every stage, on what the one before kept, against the same decisions taken in Python: from pairs, from a search, from another tokenizer."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    at, n = names.index("text"), names.index("n_chars")

    def changed(row, text):
        return tuple(text if k == at else len(text) if k == n else v for k, v in enumerate(row))

    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        if name == "language_id":
            model = language_id.train(docs)
            keep = language_id.classify(pa.array([r[at] for r in before], pa.string()), *model, language_id.Settings()).field("keep").to_pylist()
            want = [r for r, k in zip(before, keep, strict=True) if k]
        elif name == "line_dedup":
            gone = test_line_dedup.brute([(r[0], r[at]) for r in before], line_dedup.MIN_CHARS)
            want = []
            for r in before:
                drop = {line for d, line in gone if d == r[0]}
                text = "\n".join(x for k, x in enumerate(r[at].split("\n")) if k not in drop)
                if not drop or text.strip():
                    want.append(changed(r, text) if drop else r)
        elif name == "ngram_join":
            classes = test_ngram_join.brute_classes([(r[0], r[at]) for r in before], 3, ngram_join.Settings().jaccard)
            want = [r for r in before if r[0] not in classes or classes[r[0]][0] == r[0]]
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            runs = {x for _, t in items for w in [[y[2] for y in test_decontaminate.words(t)]] for k in range(len(w) - 5) for x in [tuple(w[k : k + 6])]}
            want = []
            for r in before:
                w = [y[2] for y in test_decontaminate.words(r[at])]
                if not any(tuple(w[k : k + 6]) in runs for k in range(len(w) - 5)):
                    want.append(r)
                    continue
                (spans,) = decontaminate.spans(pa.array([r[at]]), [decontaminate.Automaton([(k, i, K.words(pa.array([t])).hash) for k, (i, t) in enumerate(items)], 6)], decontaminate.Limits())
                inside = {k for s in spans for k in range(s["start"], s["end"])}
                text = "".join(c for k, c in enumerate(r[at]) if k not in inside)
                if not spans or any(c.isalnum() for c in text):
                    want.append(changed(r, text) if spans else r)
        docs = stage(spark, docs, SF)
        assert rows(docs) == sorted(want, key=repr), name
        assert len(want) <= len(before)


def test_odd_tables(spark, tmp_path):
    """Nulls in any column, rows without a key, repeated rows, further columns with clashing names, and no rows at all."""
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    text = "The house stands by the sea, and the garden is full of roses. " * 3
    odd = [(1, text, "en", "a", len(text)), (1, text, "en", "a", len(text)), (2, None, None, None, None), (None, text, "en", None, 5), (3, "", "en", "b", 0), (4, " \n ", None, None, 3)]
    df = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").withColumn("tl_c0", F.lit("x")).withColumn("tokens", F.lit("y"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 1, 1, 2, 3, 4] and all(r.round_trip for r in out)
    df.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
