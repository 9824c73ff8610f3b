"""Code: blocks, trees, packing, comments and doc comments."""

import ast

import pyarrow as pa
import pytest

from textloom.errors import InvalidInputError, MissingTokenCounterError, TokenLimitError
from textloom.operators import code_structure
from textloom.operators.code import CodeLimits, _chunked, chunk_code, declarations, pack_code
from textloom.operators.code_structure import blocks, is_python, tree
from textloom.operators.documents import words

PYTHON = '''"""What this is."""

import re

class Box:
    def open(self, key):
        """Opens it.

        With a key.
        """
        return key  # inline

    @staticmethod
    def shut():
        # whole line
        return None

def alone(x):
    return x
'''
CSHARP = """namespace Shop
{
    /// <summary>
    /// Sells things.
    /// </summary>
    public class Till
    {
        public int Add(int a, int b)
        {
            return a + b; // sum
        }
    }
}
"""


def joined(chunks):
    return "\n".join(c["content"] for c in chunks)


def test_nothing_is_lost():
    for code in (PYTHON, CSHARP):
        for n in (1, 2, 9):
            chunks = pack_code(code, CodeLimits(max_functions=n))
            # in braces, doc comments move to the first function below
            assert sorted(filter(None, joined(chunks).split("\n"))) == sorted(filter(None, code.split("\n")))
            if code is CSHARP:
                continue
            assert [c["start_line"] for c in chunks][1:] == [c["end_line"] + 1 for c in chunks][:-1]
            for c in chunks:
                assert code[c["start"] : c["end"]].strip("\n") == c["content"].strip("\n")


def test_functions_one_by_one():
    chunks = pack_code(PYTHON, CodeLimits(max_functions=1))
    assert [sum("def " in line for line in c["content"].split("\n")) for c in chunks] == [1, 1, 1]
    shut = next(c["content"] for c in chunks if "def shut" in c["content"])
    assert shut.index("@staticmethod") < shut.index("def shut")


def test_comments_and_docs():
    assert "inline" not in joined(pack_code(PYTHON, CodeLimits(max_functions=9, comments=False)))
    assert "whole line" not in joined(pack_code(PYTHON, CodeLimits(max_functions=9, comments=False)))
    short = joined(pack_code(PYTHON, CodeLimits(max_functions=9, docstrings="summary")))
    assert "Opens it." in short and "With a key" not in short
    none = joined(pack_code(PYTHON, CodeLimits(max_functions=9, docstrings="excluded")))
    assert "Opens it." not in none and "What this is" not in none
    lines = joined(pack_code(CSHARP, CodeLimits(max_functions=9, docstrings="summary")))
    assert "Sells things." in lines and "<summary>" not in lines


def test_too_long():
    code = "def long():\n    " + "x = 1\n    " * 50
    with pytest.raises(TokenLimitError):
        pack_code(code, CodeLimits(max_tokens=30), words)
    parts = pack_code(code, CodeLimits(max_tokens=30, strict=False), words)
    assert len(parts) > 1 and all(words(p["content"]) <= 30 and p["content"] for p in parts)
    assert all(p["content"].count("\n") < 5 for p in pack_code(code, CodeLimits(max_lines=5, strict=False)))


def test_tree():
    assert tree([]) == "global"
    assert tree([("global", "a"), ("a", "b"), ("global", "c"), ("a", "b")]) == "global\n├─ a\n│  └─ b\n└─ c"
    assert tree([("global", "a"), ("a", "a")]) == "global\n└─ a"
    assert blocks("class A {\n  def f(x)\n}\n", python=False)[0].relations == [("global", "class A")]


def test_language():
    assert is_python("x = 1") and is_python("#!/usr/bin/env python\nx ==") and is_python("let x", "a.py")
    assert not is_python("int main() { return 0; }") and not is_python("x = 1", "a.rb")


@pytest.mark.parametrize("code", [None, "", " \n ", "\x00", "\r\n\r\n", '"""', "/*", "@a(", "(" * 500, "# only\n", "a b\x0cc"])
def test_odd_texts(spark, code):
    df = spark.createDataFrame([(1, code)], "k long, code string")
    assert chunk_code(df, max_lines=5, strict=False).count() == (0 if not (code or "").strip() else 1)


def test_frame(spark):
    df = spark.createDataFrame([("a.py", PYTHON), ("b.cs", CSHARP), ("c.py", "def f():\n" + "    x = 1\n" * 60)], "path string, code string")
    got = chunk_code(df, path="path", max_lines=20, on_errors="skip")
    assert {r.path: r.error is not None for r in got.collect()} == {"a.py": False, "b.cs": False, "c.py": True}
    assert {r[0]: r[1] for r in df.select("path", declarations(df.code)).collect()} == {"a.py": 3, "b.cs": 0, "c.py": 1}


def test_arguments(spark):
    df = spark.createDataFrame([("x",)], "code string")
    for bad in ({}, {"max_lines": 4}, {"max_functions": 0}, {"max_lines": 9, "docstring_mode": "some"}, {"max_lines": 9, "on_errors": "break"}):
        with pytest.raises(InvalidInputError):
            chunk_code(df, **bad)
    with pytest.raises(MissingTokenCounterError):
        chunk_code(df, max_tokens=50)


def test_long_code_is_parsed_in_pieces(monkeypatch):
    longest = 0

    def parse(code):
        nonlocal longest
        longest = max(longest, len(code))
        return real(code)

    real = code_structure.ast.parse
    monkeypatch.setattr(code_structure.ast, "parse", parse)
    method = "    @cached\n    def m{0}(self):\n        if {0}:\n            return 1\n        else:\n            return '''\nx = 2\n'''\n"
    code = "class A:\n" + "".join(map(method.format, range(9000)))
    assert is_python(code)
    assert not is_python(code + "    def\n{")
    assert len(code) > 700_000 and longest < 150_000


@pytest.mark.parametrize("code", ["class A:\n  def f():\n    x\n  y\nelse:\n  z\n", "match x:\n  case 1:\n    y\n  z\n", "try:\n  x\ny\n", "class A: \\\n  x\n  y\n", "class A:\n\tx\n        y\n", "def f():\n  x \\\ny\n", "if x:\n  y\nelse:\n  z\nw\n", "def f():\n  '''\na\n'''\n  b\nc\n"])
def test_pieces_parse_where_the_whole_does(code):
    def parses(f, *a):
        try:
            f(*a)
        except SyntaxError:
            return False
        return True

    for piece in (1, 8, 20):
        assert parses(code_structure._parse, code, piece) == parses(ast.parse, code)


def test_chunks_leave_python_a_few_at_a_time():
    code = "\n".join(f"def f{k}():\n    return {k}\n" for k in range(3000))
    given = pa.record_batch([pa.array(["a", "b", "c"]), pa.array([code, None, code]), pa.array([None] * 3, pa.string())], ["k", "code", "path"])
    for skip in (False, True):
        out = list(_chunked(["k", "num", "c"], CodeLimits(max_functions=1), None, skip)(iter([given])))
        assert max(b.num_rows for b in out) <= 1000
        assert [(r["k"], r["num"], r["c"]) for b in out for r in b.to_pylist()] == [(k, n, c) for k in "ac" for n, c in enumerate(pack_code(code, CodeLimits(max_functions=1)), 1)]


def test_functions_outside_of_classes_are_parsed_in_pieces(monkeypatch):
    read = []
    real = code_structure.ast.parse
    monkeypatch.setattr(code_structure.ast, "parse", lambda code: read.append(len(code)) or real(code))
    assert is_python("\n".join(f"def part_{k}(self):\n    size = {k}\n    return size * {k}\n" for k in range(9000)))
    assert len(read) > 3 and max(read) < 150_000
