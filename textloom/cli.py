"""Command line: split text into sentences, chunk text, documents or code, view chunks in a browser."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import TextloomError
from .functions.counters import CommandCounter
from .operators.code import chunk_code
from .operators.detect import detect
from .operators.documents import chunk_documents, words
from .operators.sentences import sentence_column
from .sources import sinks
from .sources.files import chunk_code_files, chunk_files, sentence_files


def session(name: str = "textloom") -> SparkSession:
    """The session that is there, or a local one."""
    return SparkSession.getActiveSession() or SparkSession.builder.appName(name).config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    split = sub.add_parser("split", help="sentences of a text or files")
    split.add_argument("text", nargs="?")
    split.add_argument("--source", "-s", action="append", help="file or folder")
    split.add_argument("--lang", default="auto")
    split.add_argument("--destination", "-d")
    chunk = sub.add_parser("chunk", help="chunks of a text or files")
    chunk.add_argument("text", nargs="?")
    chunk.add_argument("--source", "-s", action="append", help="file or folder")
    kind = chunk.add_mutually_exclusive_group()
    kind.add_argument("--doc", action="store_true", help="documents (as is the case without this)")
    kind.add_argument("--code", action="store_true", help="source code")
    chunk.add_argument("--destination", "-d", help="a .json file or a folder; else standard output")
    chunk.add_argument("--metadata", action="store_true")
    chunk.add_argument("--lang", default="auto")
    for name in ("max-tokens", "max-sentences", "max-section-breaks", "max-lines", "max-functions"):
        chunk.add_argument(f"--{name}", type=int)
    chunk.add_argument("--overlap-percent", type=float, default=20)
    chunk.add_argument("--offset", type=int, default=0)
    chunk.add_argument("--on-errors", choices=("raise", "skip", "break"), default="raise")
    chunk.add_argument("--tokenizer-command", help="program that counts tokens; else words are counted")
    chunk.add_argument("--tokenizer-timeout", type=float)
    chunk.add_argument("--docstring-mode", choices=("all", "summary", "excluded"), default="all")
    chunk.add_argument("--include-comments", action=argparse.BooleanOptionalAction, default=True)
    chunk.add_argument("--strict", action=argparse.BooleanOptionalAction, default=True)
    show = sub.add_parser("visualize", help="chunks in a browser")
    show.add_argument("--host", default="127.0.0.1")
    show.add_argument("--port", type=int, default=8000)
    return p


def _sources(paths: list[str]) -> list[str]:
    """Absolute paths of what is there; the rest is warned of."""
    there = [os.path.abspath(p) for p in paths if os.path.exists(p)]
    for p in paths:
        if not os.path.exists(p):
            print(f"{p} isn't there; it is left out", file=sys.stderr)
    return there


def _split(a: argparse.Namespace) -> int:
    spark = session()
    if a.source:
        if not (paths := _sources(a.source)):
            return 0
        rows = sentence_files(spark, *paths, lang=a.lang).select("sentence").toLocalIterator()
        lines = (r.sentence for r in rows)
    else:
        df = spark.createDataFrame([(a.text,)], "text string")
        r = df.select(sentence_column(F.col("text"), a.lang).alias("s"), detect(F.col("text")).alias("d")).first()
        print(f"Language: {r.d.code} (confidence {r.d.confidence:.2f})" if a.lang == "auto" else f"Language: {a.lang}", file=sys.stderr)
        lines = iter(r.s)
    out = open(a.destination, "w", encoding="utf-8") if a.destination else sys.stdout
    try:
        out.writelines(f"{s}\n" for s in lines)
    finally:
        if a.destination:
            out.close()
    return 0


def _chunk(a: argparse.Namespace) -> int:
    spark = session()
    counter = CommandCounter(a.tokenizer_command, a.tokenizer_timeout) if a.tokenizer_command else words
    if a.code:
        limits = {"max_tokens": a.max_tokens, "max_lines": a.max_lines, "max_functions": a.max_functions, "strict": a.strict, "include_comments": a.include_comments, "docstring_mode": a.docstring_mode, "token_counter": counter, "on_errors": a.on_errors}
    else:
        limits = {"max_tokens": a.max_tokens, "max_sentences": a.max_sentences, "max_section_breaks": a.max_section_breaks, "overlap_percent": a.overlap_percent, "offset": a.offset, "lang": a.lang, "token_counter": counter, "on_errors": a.on_errors}
    if a.source:
        if not (paths := _sources(a.source)):
            return 0
        chunks = (chunk_code_files if a.code else chunk_files)(spark, *paths, **limits)
    else:
        df = spark.createDataFrame([("stdin", a.text)], "source string, text string")
        chunks = chunk_code(df, code="text", **limits) if a.code else chunk_documents(df, key="source", **limits)
    if not a.destination:
        sinks.write_text(chunks, sys.stdout, a.metadata)
    elif a.destination.endswith(".json"):
        sinks.write_json(chunks, a.destination, a.metadata)
    elif a.destination.endswith((".yaml", ".yml")):
        sinks.write_yaml(chunks, a.destination, a.metadata)
    else:
        sinks.write_folder(chunks, a.destination, a.metadata)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "visualize":
        from .view import serve

        serve(session(), a.host, a.port)
        return 0
    if bool(a.text) == bool(a.source):
        print("Give either a text or --source", file=sys.stderr)
        return 2
    try:
        return _split(a) if a.command == "split" else _chunk(a)
    except TextloomError as e:
        print(json.dumps({"error": type(e).__name__, "message": str(e)}), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
