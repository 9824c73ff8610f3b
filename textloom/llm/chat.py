"""Chat formatting by columnar byte assembly.

Each turn becomes a header with its role, its text and a footer. The lengths of these segments and their
cumulative offsets are computed in numpy for a whole batch of conversations, then all bytes
are gathered from the columns' own buffers into one preallocated buffer, which becomes the Arrow column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import ranges, table

SCHEMA = "text string, n_bytes long, reply_bytes long, reply_starts array<long>, reply_ends array<long>"


@dataclass(frozen=True)
class Template:
    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    after_text: str = "<|im_end|>\n"
    #: Turns of this role are what a model is to learn; their places are returned.
    reply: str = "assistant"
    #: Bytes gathered at once.
    step: int = 1 << 22


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths) of a string array without nulls."""
    off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off[:-1], np.diff(off)


def assembled(turns: pa.ListArray, template: Template) -> pa.StructArray:
    """Texts of the conversations: lists of structs role, text in order."""
    turns = pc.fill_null(turns, pa.scalar([], turns.type)) if turns.null_count else turns
    counts = turns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = turns.flatten()
    roles, texts = pc.fill_null(flat.field("role"), "unknown"), pc.fill_null(flat.field("text"), "")
    fixed = [x.encode() for x in (template.before_role, template.after_role, template.after_text)]
    constant = np.frombuffer(b"".join(fixed), np.uint8)
    (role_data, role_at, role_size), (text_data, text_at, text_size) = _bytes(roles), _bytes(texts)
    source = np.concatenate([constant, role_data, text_data])
    at_role, at_text = len(constant), len(constant) + len(role_data)
    n = len(flat)
    # five segments a turn
    sizes = np.empty((n, 5), np.int64)
    places = np.empty((n, 5), np.int64)
    for k, (size, place) in enumerate([(len(fixed[0]), 0), (role_size, at_role + role_at), (len(fixed[1]), len(fixed[0])), (text_size, at_text + text_at), (len(fixed[2]), len(fixed[0]) + len(fixed[1]))]):
        sizes[:, k], places[:, k] = size, place
    sizes, places = sizes.ravel(), places.ravel()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(ends[-1], np.uint8)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + template.step, "right")) - 1)
        part = sizes[a:b]
        out[ends[a] : ends[b]] = source[np.repeat(places[a:b], part) + ranges(part)]
        a = b
    last = np.concatenate([[0], np.cumsum(counts)])
    offsets = ends[last * 5]
    size = np.diff(offsets)
    text = pa.Array.from_buffers(pa.large_string(), len(turns), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.string())
    reply = pc.equal(roles, template.reply).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(turns)), counts)
    start = ends[3 : len(sizes) : 5] - offsets[row] if n else np.zeros(0, np.int64)
    lists = np.concatenate([[0], np.cumsum(np.bincount(row[reply], minlength=len(turns)))]).astype(np.int32)
    learned = np.bincount(row[reply], weights=text_size[reply], minlength=len(turns)).astype(np.int64)
    return pa.StructArray.from_arrays(
        [text, pa.array(size), pa.array(learned), pa.ListArray.from_arrays(pa.array(lists), pa.array(start[reply])), pa.ListArray.from_arrays(pa.array(lists), pa.array((start + text_size)[reply]))],
        ["text", "n_bytes", "reply_bytes", "reply_starts", "reply_ends"],
    )


def format_chats(turns: DataFrame, template: Template = Template(), key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, text, n_bytes, reply_bytes, and where the replies' texts stand (bytes).

    Turns are in order of turn, then role and text, nulls first, so that ties are in the same order each time; repeated turns
    stay. A null role is "unknown", a null text is empty, and its turn stays. Turns without a conversation make up one of
    their own, with a null conv_id. The texts of one Arrow batch make up less than 2 GB: lower
    spark.sql.execution.arrow.maxRecordsPerBatch for very long conversations."""
    t = turns.select(turns[key].alias("conv_id"), F.struct(turns[turn].alias("turn"), turns[role].cast("string").alias("role"), turns[text].cast("string").alias("text")).alias("t"))

    @arrow_udf(SCHEMA)
    def f(x: pa.Array) -> pa.Array:
        return assembled(x, template)

    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    grouped = t.groupBy("conv_id").agg(ordered.alias("turns"))
    return grouped.select("conv_id", F.size("turns").alias("n_turns"), f.asNondeterministic()("turns").alias("v")).select("conv_id", "n_turns", "v.*")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one text; the places of its replies are written as lists with commas, which SQL has too."""
    places = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    f = format_chats(table(spark, sf_dir, "conversations"))
    return f.select("conv_id", "n_turns", "text", "n_bytes", "reply_bytes", places("reply_starts"), places("reply_ends"))


SQL = """
WITH turns AS (
  SELECT conv_id, role, '<|im_start|>' || coalesce(role, 'unknown') || chr(10) AS head, coalesce(text, '') AS body, '<|im_end|>' || chr(10) AS foot,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations),
placed AS (
  SELECT *, coalesce(sum(strlen(head || body || foot)) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + strlen(head) AS place
  FROM turns)
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, string_agg(head || body || foot, '' ORDER BY k) AS text,
       CAST(sum(strlen(head || body || foot)) AS BIGINT) AS n_bytes,
       CAST(sum(CASE WHEN role = 'assistant' THEN strlen(body) ELSE 0 END) AS BIGINT) AS reply_bytes,
       coalesce(string_agg(CASE WHEN role = 'assistant' THEN CAST(CAST(place AS BIGINT) AS VARCHAR) END, ',' ORDER BY k), '') AS reply_starts,
       coalesce(string_agg(CASE WHEN role = 'assistant' THEN CAST(CAST(place + strlen(body) AS BIGINT) AS VARCHAR) END, ',' ORDER BY k), '') AS reply_ends
FROM placed GROUP BY conv_id
"""
