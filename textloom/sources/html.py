"""HTML to Markdown with the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from ..functions.plain import few_breaks
from ..functions.text import long_link

_SKIPPED = {"script", "style", "head", "template", "noscript"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "figure", "figcaption", "form", "fieldset", "address", "dl", "dt", "dd", "details", "summary", "body", "html", "center", "caption"}
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "kbd": "`", "samp": "`", "del": "~~", "s": "~~"}
_CELLS = {"td", "th"}
#: Stands for a space that is to stay, until all is tidied.
_KEPT = "\ue000"


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.inside = tag, attrs, []


class _Tree(HTMLParser):
    """Tags as they close: an end tag closes what is open down to its own start, a stray one nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        last = self.open[-1].tag
        if tag == last and tag in ("p", "li", "tr", "td", "th", "option", "dt", "dd") or tag in _CELLS and last in _CELLS or tag == "tr" and last in _CELLS:
            self.open.pop()
            if tag == "tr" and self.open[-1].tag == "tr":
                self.open.pop()
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].inside.append(node)
        if tag not in _VOID and len(self.open) < 400:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].inside.append(data)


def _escaped(text: str) -> str:
    return re.sub(r"([*_])", r"\\\1", text)


class _Markdown:
    def inline(self, node: _Node, raw: bool = False) -> str:
        return "".join((x if raw else _escaped(re.sub(r"\s+", " ", x))) if isinstance(x, str) else self.node(x, raw) for x in node.inside)

    def node(self, n: _Node, raw: bool = False) -> str:
        if n.tag in _SKIPPED:
            return ""
        if n.tag == "pre":
            body = re.sub(r"(?m)^[ \t]+", lambda m: _KEPT * len(m[0].expandtabs(4)), self.inline(n, True).strip("\n"))
            return f"\n\n```\n{body}\n```\n\n"
        if n.tag == "br":
            return "\n" if raw else "  \n"
        if raw:
            return self.inline(n, True)
        if re.fullmatch("h[1-6]", n.tag):
            text = re.sub(r"\s+", " ", self.inline(n)).strip()
            level = int(n.tag[1])
            if not text:
                return ""
            return f"\n\n{text}\n{('=' if level == 1 else '-') * len(text)}\n\n" if level < 3 else f"\n\n{'#' * level} {text}\n\n"
        if n.tag == "hr":
            return "\n\n---\n\n"
        if n.tag == "img":
            title = n.attrs.get("title", "")
            return f"![{n.attrs.get('alt', '')}]({n.attrs.get('src', '')}{f' "{title}"' if title else ''})"
        if n.tag == "a":
            text, to = self.inline(n).strip(), n.attrs.get("href", "")
            if not to or not text:
                return text
            return f"<{to}>" if text.replace("\\", "") == to and not n.attrs.get("title") else f"[{text}]({to})"
        if n.tag in _MARKS:
            text = self.inline(n, n.tag in ("code", "kbd", "samp"))
            core, mark = text.strip(), _MARKS[n.tag]
            return f"{' ' * text.startswith(' ')}{mark}{core}{mark}{' ' * text.endswith(' ')}" if core else text
        if n.tag in ("ul", "ol"):
            return self.items(n)
        if n.tag == "blockquote":
            inner = tidy(self.inline(n))
            return "\n\n" + "\n".join(f"> {x}".rstrip() for x in inner.split("\n")) + "\n\n" if inner else ""
        if n.tag == "table":
            return self.table(n)
        text = self.inline(n)
        return f"\n\n{text.strip()}\n\n" if n.tag in _BLOCKS and text.strip() else text

    def items(self, n: _Node) -> str:
        out, k = [], int(n.attrs["start"]) if n.attrs.get("start", "").isdecimal() else 1
        for x in n.inside:
            if isinstance(x, str) or x.tag != "li":
                if not isinstance(x, str) and x.tag in ("ul", "ol"):
                    out.append("  " + self.items(x).strip("\n").replace("\n", "\n  "))
                continue
            head = "* " if n.tag == "ul" else f"{k}. "
            body = "\n".join(filter(None, tidy(self.inline(x)).split("\n")))
            out.append(head + body.replace("\n", "\n" + " " * len(head)))
            k += 1
        return "\n\n" + "\n".join(out) + "\n\n" if out else ""

    def table(self, n: _Node) -> str:
        rows: list[list[str]] = []

        def walk(x: _Node) -> None:
            for y in x.inside:
                if isinstance(y, str):
                    continue
                if y.tag == "tr":
                    rows.append([re.sub(r"\s+", " ", self.inline(c)).strip().replace("|", "\\|") for c in y.inside if not isinstance(c, str) and c.tag in _CELLS])
                elif y.tag in ("thead", "tbody", "tfoot"):
                    walk(y)

        walk(n)
        rows = [r for r in rows if r]
        if not rows:
            text = self.inline(n).strip()
            return f"\n\n{text}\n\n" if text else ""
        rows.insert(1, ["---"] * len(rows[0]))
        return "\n\n" + "\n".join(f"| {' | '.join(r)} |" for r in rows) + "\n\n"


def tidy(text: str) -> str:
    """White space around line breaks gone, three or more breaks made two."""
    text = re.sub(r"(?<! )[ \t]\n", "\n", re.sub(r"\n[ \t]+(?=\S)(?![*+\-\d`|])", "\n", text))
    return few_breaks(re.sub(r"\n[ \t]+(?=\n)", "\n", text)).strip()


def truncated(text: str, longest: int = 150) -> str:
    """Addresses of links and images cut to `longest` characters, the last three of them dots."""
    return re.sub(long_link(longest), r"\1(\2...)", text)


def to_markdown(html: str, longest_url: int = 150) -> str:
    """Markdown of an HTML page or fragment; tags that aren't known give their text."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return truncated(tidy(_Markdown().inline(tree.root)).replace(_KEPT, " "), longest_url)
