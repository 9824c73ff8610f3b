"""What lines of source code look like, whatever the language: comments, doc comments, declarations, decorators, brackets."""

from __future__ import annotations

import re

_LETTER = r"[^\W\d_]"


def _any(*parts: str) -> str:
    return "(?:" + "|".join(parts) + ")"


#: A variable that is given a string over several lines.
STRING_ASSIGNED = re.compile(
    r"^(?:\w+\s*){1,2}(?::\s*[^:=]+)?\s*:?=\s*"
    + _any(
        r"(?P<q>'''|\"\"\").*?(?P=q)\s*",
        r"\[(?P<eq>=?)\[.*?\](?P=eq)\]\s*",
        r"`[^`]*`\s*",
        r"@\"\n.*?\n\"@\s*",
        r"q{1,2}[\[{(<|].*?[\]})>|]\s*",
        rf"<<<?(?P<label>{_LETTER}+)\n.*?\n(?P=label);?\s*",
    )
    + "$",
    re.M | re.S,
)

_MARKS = _any(r"\#(?!\#|\[)", r"//(?!/|!)", r"\\", ";", "--", "%", "!", "⍝", r"(?:(?<=\n)|(?<=\A))[^\S\n]*'")
#: A comment to the end of its line; marks of doc comments don't count. The mark stands free on both sides.
LINE_COMMENT = re.compile(rf"(?<!\S){_MARKS}[^\S\n].+$", re.M)
WHOLE_LINE_COMMENT = re.compile(rf"^\s*{_MARKS}[^\S\n].+$", re.M)

#: opening and closing of comments that may run over lines
_BLOCKS = (
    (r"#\|", r"\|#"),
    ("<#", "#>"),
    (r"/\*(?!\*)", r"\*/"),
    (r"\(\*(?!\*)", r"\*\)"),
    (r"\(\s+(?!\*)", r"\)"),
    (r"=begin", "=end"),
    (r"=\w{3,}", "=cut"),
    (r"\{-", r"-\}"),
    (r"\{%", r"%\}"),
    (r"--\[\[", r"\]\]"),
)
BLOCK_COMMENT = re.compile(r"^\s*" + _any(*(f"{a}.+?{b}" for a, b in _BLOCKS), r"\#{3}.+?\#{3}", r":'.+?'", r':".+?"'), re.M | re.S)

_DOC_BLOCKS = (
    (r"@(?:module|type)?doc\s*\"{3}", r"\"{3}"),
    ("'''", "'''"),
    (r"\"{3}", r"\"{3}"),
    (r"/\*\*", r"\*/"),
    (r"\(\*\*", r"\*\)"),
)
#: Groups by name: indent, then open1 text1 close1, open2 ... for each style.
DOC_BLOCK = re.compile(
    r"^(?P<indent>\s*)"
    + _any(
        *(rf"(?P<open{k}>{a})(?P<text{k}>[\s\S]*?)(?P<close{k}>{b})" for k, (a, b) in enumerate(_DOC_BLOCKS)),
        r'(?P<open9>@(?:module|type)?doc\s*")(?P<text9>.*)(?P<close9>")',
    ),
    re.M,
)
DOC_LINE = re.compile(r"^(?P<indent>\s*)(?P<mark>//[/!]|%%|\#\#).+", re.M)

FUNCTION = re.compile(
    r"\s*"
    + _any(
        r"(?:[A-Za-z ]*?def|func|fun|fn|[fF]unction|FUNCTION|proc|procedure|PROCEDURE|sub)\b\s*[^(\s]+\s*\(",
        r"\(\s*def(?:n|un|macro|method)\b\s+[^)\s]+",
        "(?:" + "|".join("component constexpr friend inline internal override private protected public sealed static virtual".split()) + r")\s+[\w\[\]<>:*]+.*?[({]",
    )
)
_KINDS = "class contract enum implementation interface library mod module namespace object package protocol struct trait type".split()
_MODIFIERS = "abstract const export final friend internal mod override private protected pub public sealed static virtual".split()
NAMESPACE = re.compile(rf"^\s*(?P<name>(?:(?:{'|'.join(_MODIFIERS)})\s+)*(?:@(?:interface|implementation)|{'|'.join(_KINDS)}|\(def(?:class|package))\s+(?:{_LETTER}|_)\w*).*?(?:[(:;){{]|$)", re.M)

_META_NAME = r"\w+(?:\.\w+)*(?:\s*\([^()]*?\))?"
DECORATOR = re.compile(rf"^\s*\#?(?:@{_META_NAME}|\#?\[{_META_NAME}\]|<{_META_NAME}>)", re.M)

#: A line that only opens a block.
OPENS = re.compile(r"\s*(?:[(\[{]|(?:do|then|begin|BEGIN)\b)?\s*$")
#: A line that closes one, or that is inside one by its indentation.
CLOSES = re.compile(r"\s|(?:[)\]}]|(?:fi|done|end|END)\b)?;?(?:\s|$)")
