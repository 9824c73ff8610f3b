"""Chat formatting against string concatenation."""

import random

import duckdb

from textloom.llm import chat as C


def brute(rows):
    out = {}
    for c, turn, role, text in sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:])):
        head = f"<|im_start|>{role if role is not None else 'unknown'}\n"
        whole, n, spans = out.get(c, ("", 0, []))
        at = len((whole + head).encode())
        body = text or ""
        if role == "assistant":
            spans = [*spans, (at, at + len(body.encode()))]
        out[c] = (whole + head + body + "<|im_end|>\n", n + 1, spans)
    return out


def some_rows():
    rng = random.Random(0)
    rows = [(rng.randrange(40), rng.choice([0, 1, 2, 3, None]), rng.choice(["user", "assistant", "système", "", None]), rng.choice(["", "hi", "é😀" * rng.randrange(50), "x\ny", None])) for _ in range(300)]
    return rows + rows[:10] + [(None, 0, "user", "lost"), (99, 0, "assistant", "long " * 300_000)]


def test_concatenation(spark):
    rows = some_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, turns string").repartition(3)
    got = {r.conv_id: (r.text, r.n_turns, list(zip(r.reply_starts, r.reply_ends))) for r in C.format_chats(df).collect()}
    assert got == brute(rows)
    for r in C.format_chats(df).collect():
        assert r.n_bytes == len(r.text.encode()) and r.reply_bytes == sum(b - a for a, b in zip(r.reply_starts, r.reply_ends))


def test_sql_and_template(spark, tmp_path):
    rows = some_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(C.SQL).fetchall()
    got = [tuple(r) for r in C.op8_chat_format(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is None, r[0])
    assert sorted(got, key=key) == sorted(want, key=key)
    (r,) = C.format_chats(df.where("conv_id = 99"), C.Template("[", "]", "", step=7)).collect()
    assert r.text == "[assistant]" + "long " * 300_000


def test_empty(spark):
    assert C.format_chats(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
