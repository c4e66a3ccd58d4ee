"""HTML extraction by layout-aware rendering.

A tolerant tokenizer feeds a tree builder that closes elements whose end tags
may be left out and ignores end tags that match nothing.  Elements that a reader
doesn't see are skipped; of an svg its texts are seen.  The rest is rendered: runs of white space collapse to a
space outside pre, blocks start on lines of their own, paragraphs, headings,
lists and tables stand apart by a blank line, list items have markers and are
indented by depth, cells of a table are padded to the widest of their column.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import fresh, require

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
# fixed values: names of HTML elements by how they act
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title iframe noembed noframes xmp".split())
_UNSEEN = set("head title script style template noscript iframe object embed canvas audio video datalist noembed noframes map annotation annotation-xml mphantom".split())
#: Of an svg, text elements are seen, and others unless they only define.
_SVG_TEXT = {"text", "foreignobject"}
_SVG_UNSEEN = set("defs symbol clippath mask marker pattern desc metadata".split())
_BLOCK = set("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption legend optgroup xmp".split())
_APART = set("p h1 h2 h3 h4 h5 h6 ul ol menu dl table blockquote pre hr figure xmp".split())
#: An element that starts closes open ones of these names, up to a border.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
_CLOSES_P = _BLOCK - {"body", "html", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dt", "dd", "caption", "legend"}
_SCOPE = {"table", "td", "th", "caption", "button", "html", "template", "object"}
#: Columns from which on nesting indents no further.
INDENT = 800


class Node:
    __slots__ = ("name", "hidden", "children", "start")

    def __init__(self, name: str, hidden: bool = False, start: int = 1):
        self.name, self.hidden, self.children, self.start = name, hidden, [], start


def _element(name: str, raw: str) -> Node:
    hidden, start = name in _UNSEEN, 1
    if raw and ("hid" in raw.lower() or "none" in raw.lower() or "start" in raw or "collapse" in raw):
        for key, value in _ATTRIBUTE.findall(raw):
            key, value = key.lower(), html.unescape(value.strip("\"'"))
            if key == "hidden" and value.lower() != "until-found" or key == "style" and _HIDING.search(value) or name == "input" and key == "type" and value.lower() == "hidden":
                hidden = True
            elif key == "start" and name == "ol" and re.fullmatch(r"-?\d{1,9}", value):
                start = int(value)
    return Node(name, hidden, start)


def build(source: str) -> Node:
    """The tree of a page."""
    return _build(source)[0]


def _build(source: str) -> tuple[Node, int]:
    """The tree, and how deep elements were open."""
    root = Node("#root")
    stack, at, n, deepest = [root], 0, len(source), 1
    opened: Counter[str] = Counter()  # names on the stack

    def cut(k: int) -> None:
        opened.subtract(x.name for x in stack[k:])
        del stack[k:]

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(html.unescape(s))

    def close(names: set, border: set) -> None:
        k = len(stack) - 1
        while k and any(opened[x] > 0 for x in names):
            if stack[k].name in border:
                return
            if stack[k].name in names:
                cut(k)
            k -= 1

    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        end, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if end:
            for k in range(len(stack) - 1, 0, -1) if opened[name] > 0 or name == "p" else ():
                if stack[k].name == name:
                    cut(k)
                    break
                if stack[k].name in _SCOPE and name not in ("table", "html", "body", "tr", "tbody", "thead", "tfoot"):
                    break
            else:
                if name == "p":
                    stack[-1].children.append(Node("p"))
            continue
        if name in _CLOSES_P:
            close({"p"}, _SCOPE)
        if name in _CLOSES:
            close(*_CLOSES[name])
        if name in _BLOCK and name not in ("html", "body") and any(x.name == "head" for x in stack[1:3]):
            close({"head"}, set())
        node = _element(name, raw)
        stack[-1].children.append(node)
        if name in _RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            inner = source[at : stop.start() if stop else n]
            at = stop.end() if stop else n
            if inner:
                node.children.append(html.unescape(inner) if name in ("textarea", "title") else inner)
        elif name not in _VOID and not raw.endswith("/") or name in _BLOCK - {"hr"}:
            stack.append(node)
            opened[name] += 1
            deepest = max(deepest, len(stack))
    return root, deepest


_SPACE = re.compile(r"[ \t\n\f\r]+")


class _Page:
    """Lines of output, with the blank lines that blocks ask for."""

    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.space = self.blank = False
        self.indent, self.marker = "", ""

    def words(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s.startswith(" "):
            self.space = True
        body = s.strip(" ")
        if body:
            if self.space and self.line:
                self.line += " "
            self.line += body
            self.space = s.endswith(" ")

    def stop(self, apart: bool = False) -> None:
        if self.line:
            self.put(self.line)
            self.line = ""
        self.space = False
        self.blank |= apart

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        first = self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent
        self.marker = ""
        self.lines.append((first + line).rstrip())


def _deeper(indent: str, n: int) -> str:
    return indent + " " * n if len(indent) < INDENT else indent


def _width(s: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _rows(table: Node):
    for x in table.children:
        if isinstance(x, Node) and not x.hidden:
            if x.name == "tr":
                yield x
            elif x.name in ("thead", "tbody", "tfoot"):
                yield from _rows(x)


def _table(node: Node, page: _Page) -> None:
    page.stop(True)
    loose = [x for x in node.children if isinstance(x, Node) and not x.hidden and x.name not in ("tr", "thead", "tbody", "tfoot", "colgroup", "col") or isinstance(x, str) and x.strip()]
    for x in loose:  # captions, and text that stands in no cell
        _render(Node("div"), page, [x])
    grid = []
    for row in _rows(node):
        cells = [x for x in row.children if isinstance(x, Node) and not x.hidden and x.name in ("td", "th")]
        other = [x for x in row.children if x not in cells and not (isinstance(x, Node) and x.hidden)]
        if any(isinstance(x, Node) or x.strip() for x in other):
            _render(Node("div"), page, other)
        grid.append([[line for line in text(x).split("\n") if line] or [""] for x in cells])
    columns = max((len(r) for r in grid), default=0)
    widths = [max((_width(line) for r in grid if k < len(r) for line in r[k]), default=0) for k in range(columns)]
    page.stop()
    for r in grid:
        for k in range(max((len(c) for c in r), default=0)):
            parts = [c[k] if k < len(c) else "" for c in r]
            line = "  ".join(p + " " * (w - _width(p)) for p, w in zip(parts, widths, strict=False)).rstrip()
            if line:
                page.put(line)
    page.blank = True


def _svg_texts(svg: Node):
    todo = [svg]
    while todo:
        x = todo.pop()
        if x.name in _SVG_TEXT:
            yield x
        else:
            todo += [y for y in reversed(x.children) if isinstance(y, Node) and not y.hidden and y.name not in _SVG_UNSEEN]


def _render(node: Node, page: _Page, children=None, pre: bool = False) -> None:
    number = node.start
    for x in node.children if children is None else children:
        if isinstance(x, str):
            if pre:
                parts = x.replace("\r\n", "\n").split("\n")
                for k, part in enumerate(parts):
                    page.line += part
                    if k < len(parts) - 1:
                        page.put(page.line)
                        page.line = ""
            else:
                page.words(x)
            continue
        if x.hidden:
            continue
        if x.name == "br":
            page.put(page.line)
            page.line, page.space = "", False
        elif x.name == "hr":
            page.stop(True)
        elif x.name == "table":
            _table(x, page)
        elif x.name == "svg":
            for part in _svg_texts(x):
                page.space = True
                _render(part, page)
                page.space = True
        elif x.name == "li":
            page.stop()
            marker = f"{number}. " if node.name == "ol" else "- "
            number += 1
            indent, page.indent, page.marker = page.indent, _deeper(page.indent, len(marker)), marker
            _render(x, page)
            page.stop()
            page.indent, page.marker = indent, ""
        elif x.name in _BLOCK:
            apart = x.name in _APART and not (x.name in ("ul", "ol", "menu") and node.name == "li")
            page.stop(apart and not page.marker)
            if x.name in ("dd", "blockquote"):
                indent, page.indent = page.indent, _deeper(page.indent, 4)
                _render(x, page, pre=pre)
                page.stop(apart)
                page.indent = indent
            else:
                _render(x, page, pre=pre or x.name in ("pre", "xmp"))
                page.stop(apart)
        else:
            _render(x, page, pre=pre)


def text(node: Node) -> str:
    page = _Page()
    _render(node, page, pre=node.name in ("pre", "xmp"))
    page.stop()
    lines = page.lines
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return "\n".join(lines)


def render(source: str | None) -> str:
    """Visible text of a page; empty for null."""
    if not isinstance(source, str):
        return ""
    root, deepest = _build(source.replace("\0", "�"))
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 5 * deepest + 1000))
    try:
        return text(root)
    finally:
        sys.setrecursionlimit(limit)


def extract(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """pages with their visible text; a column of that name is renamed with a
    leading underscore.  A null or empty page, or one without visible text, has
    an empty text.  Whole pages are rendered, however deep elements nest;
    indentation grows to INDENT columns only."""
    require(pages, html_col)
    if (new := fresh(pages, name)[0]) != name:
        pages = pages.withColumnsRenamed({c: new for c in pages.columns if c.lower() == name.lower()})
        html_col = new if html_col.lower() == name.lower() else html_col

    @pandas_udf("string")
    def rendered(sources: pd.Series) -> pd.Series:
        return pd.Series([render(s) for s in sources], dtype=object)

    return pages.withColumn(name, rendered(F.col(html_col)))
