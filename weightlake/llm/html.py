"""Visible text of HTML pages, laid out as a reader sees it.

A tree builder applies implied end tags and void elements; a renderer then
walks the tree, skips what a browser would not show, and keeps block spacing,
list markers, preformatted text and aligned table cells.

Defined results: a null or empty page has an empty text; broken markup never
fails (unknown tags are inline, stray end tags are ignored); repeated rows and
ids give equal rows; empty tables give empty results; other columns are not
looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_GAP = re.compile(r"[ \t\n\r\f]+")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template plaintext".split())
UNSEEN = frozenset("head script style title template noscript iframe object audio video canvas svg math datalist noembed noframes map".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
#: A start tag closes these open elements, up to the given scope.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: Where a part of an open table goes: the parts of the table that stay open; what else is open within it is closed.
_WITHIN = {
    "td": frozenset("thead tbody tfoot tr".split()),
    "th": frozenset("thead tbody tfoot tr".split()),
    "tr": frozenset("thead tbody tfoot".split()),
} | dict.fromkeys("caption colgroup col thead tbody tfoot".split(), frozenset())
#: What may be in a head, all void or raw; any other start tag, and text, ends it.
IN_HEAD = frozenset("base link meta title noscript noframes style script template".split())
_CLOSE_P = BLOCK - {"html", "body", "option", "optgroup", "legend"} | {"hr"}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text.strip(" /") else {}


def build(source: str) -> Node:
    """The tree of a page; children are nodes and strings."""
    root = Node("#root")
    stack, at = [root], 0
    open_count: dict[str, int] = {}

    def pop_to(k: int) -> None:
        for node in stack[k:]:
            open_count[node.tag] -= 1
        del stack[k:]

    def close(tags: set[str], scope: set[str]) -> None:
        if any(open_count.get(t) for t in tags):
            k = len(stack) - 1
            cut = 0
            while k and stack[k].tag not in scope:
                if stack[k].tag in tags:
                    cut = k
                k -= 1
            if cut:
                pop_to(cut)

    def enter_table(name: str) -> None:
        """Make the open table, or its open row, the place of a new part."""
        k = len(stack) - 1
        while stack[k].tag != "table":
            k -= 1
        k += 1
        while k < len(stack) and stack[k].tag in _WITHIN[name]:
            k += 1
        pop_to(k)
        if name in ("td", "th") and stack[-1].tag != "tr":
            row = Node("tr")
            stack[-1].children.append(row)
            stack.append(row)
            open_count["tr"] = open_count.get("tr", 0) + 1

    def add_text(s: str) -> None:
        # only raw elements, which are not on the stack, can be open within a head
        if stack[-1].tag == "head" and _GAP.sub("", s):
            pop_to(len(stack) - 1)
        stack[-1].children.append(s)

    while at < len(source):
        lt = source.find("<", at)
        if lt < 0:
            add_text(html.unescape(source[at:]))
            break
        if lt > at:
            add_text(html.unescape(source[at:lt]))
        m = _TOKEN.match(source, lt)
        if not m:
            add_text("<")
            at = lt + 1
            continue
        at = m.end()
        if name := m[1]:
            name = name.lower()
            if open_count.get(name):
                k = len(stack) - 1
                while stack[k].tag != name:
                    k -= 1
                # an end does not reach beyond a cell or a table, but for those of the table's parts and the page's
                fence = () if name in ("table", "body", "html") else ("table",) if name in _WITHIN else ("td", "th", "caption", "table")
                if not any(x.tag in fence for x in stack[k + 1 :]):
                    pop_to(k)
            elif name in ("br", "p"):
                if stack[-1].tag == "head":
                    pop_to(len(stack) - 1)
                stack[-1].children.append(Node(name))
        elif name := m[2]:
            name = name.lower()
            if stack[-1].tag == "head" and name not in IN_HEAD:
                pop_to(len(stack) - 1)
            if name in _CLOSE_P and open_count.get("p"):
                close({"p"}, {"td", "th", "table", "button"})
            if name in _WITHIN and open_count.get("table"):
                enter_table(name)
            elif name in CLOSES:
                close(*CLOSES[name])
            node = Node(name, m[3] or "")
            stack[-1].children.append(node)
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at) if name != "plaintext" else None
                body = source[at : end.start() if end else len(source)]
                if name in ("textarea", "xmp", "plaintext"):
                    node.children.append(html.unescape(body) if name == "textarea" else body)
                at = end.end() if end else len(source)
            elif name not in VOID and not (m[3] or "").endswith("/"):
                stack.append(node)
                open_count[name] = open_count.get(name, 0) + 1
    return root


def _hidden(node: Node) -> bool:
    if node.tag in UNSEEN:
        return True
    if not node.attrs or not ("hidden" in node.attrs.lower() or "style" in node.attrs.lower()):
        return False
    a = _attributes(node.attrs)
    return "hidden" in a and a["hidden"].lower() != "until-found" or bool(_HIDING.search(a.get("style", "")))


class _Out:
    """Lines so far; block breaks collapse, and white space within a line is one space."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.indent = ""
        self.mark = ""
        self.gap = False

    def text(self, s: str) -> None:
        s = _GAP.sub(" ", s)
        if self.now:
            if self.now[-1].endswith(" "):
                s = s.lstrip(" ")
        else:
            s = s.lstrip(" ")
        if s:
            self.now.append(s)

    def end(self) -> None:
        line = "".join(self.now).rstrip(" ")
        self.now = []
        if line:
            self.put(line)

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        lead = self.indent
        if self.mark:
            lead, self.mark = self.indent[: -len(self.mark)] + self.mark, ""
        self.lines.append(lead + line if line else "")


def _cells(table: Node, depth: int) -> tuple[list[list[str]], list[str], list]:
    """Rows of rendered cells, captions, and what is in the table but in neither; that is shown before the table."""
    rows, captions, stray = [], [], []
    line = lambda node: " ".join(x.strip() for x in _render(node, depth + 1).split("\n") if x.strip())
    todo = [(None, iter(table.children))]
    while todo:
        row, children = todo[-1]
        for child in children:
            if isinstance(child, str):
                if _GAP.sub("", child):
                    stray.append(child)
            elif _hidden(child):
                continue
            elif child.tag == "caption":
                captions.append(" ".join(_render(child, depth + 1).split()))
            elif child.tag in ("td", "th") and row is not None:
                row.append(line(child))
            elif child.tag == "tr":
                rows.append([])
                todo.append((rows[-1], iter(child.children)))
                break
            elif child.tag in ("thead", "tbody", "tfoot", "colgroup"):
                todo.append((None, iter(child.children)))
                break
            else:
                stray.append(child)
        else:
            todo.pop()
    return rows, captions, stray


#: Tables nested deeper than this are rendered as plain blocks.
_DEEPEST_TABLE = 8


def _render(root: Node, depth: int = 0) -> str:
    """The visible text of a subtree. An explicit stack, so that deep nesting cannot exhaust Python's."""
    out = _Out()
    todo: list = [("in", root, None)]
    pre = 0
    while todo:
        what, node, extra = todo.pop()
        if what == "out":
            if node.tag == "pre":
                out.end()
                pre -= 1
            out.end()
            if extra is not None:
                out.indent = extra
                out.mark = ""
            if node.tag in SPACED and not (node.tag in ("ul", "ol") and out.indent):
                out.gap = True
            continue
        if what == "grid":
            out.end()
            out.gap = True
            rows, captions = extra
            for c in captions:
                if c:
                    out.put(c)
            widths: list[int] = []
            for r in rows:
                widths += [0] * (len(r) - len(widths))
                for i, c in enumerate(r):
                    widths[i] = max(widths[i], len(c))
            for r in rows:
                line = "  ".join(c.ljust(widths[i]) for i, c in enumerate(r)).rstrip()
                if line:
                    out.put(line)
            out.gap = True
            continue
        if isinstance(node, str):
            if pre:
                first, *rest = node.split("\n")
                if first:
                    out.now.append(first)
                for line in rest:
                    out.put("".join(out.now))
                    out.now = [line] if line else []
            else:
                out.text(node)
            continue
        tag = node.tag
        if node is not root and _hidden(node):
            continue
        if tag == "br":
            line = "".join(out.now).rstrip(" ")
            out.now = []
            out.put(line) if line or out.lines and out.lines[-1] else None
            continue
        if tag == "hr":
            out.end()
            out.put("---")
            continue
        if tag == "input":
            a = _attributes(node.attrs)
            if a.get("type", "text").lower() in ("submit", "button", "reset") and a.get("value"):
                out.text(a["value"])
            continue
        if tag == "table" and node is not root and depth < _DEEPEST_TABLE:
            rows, captions, stray = _cells(node, depth)
            todo.append(("grid", node, (rows, captions)))
            todo.extend(("in", c, None) for c in reversed(stray))
            continue
        if tag in ("td", "th") and node is not root:
            out.text(" ")
        block = tag in BLOCK or tag in ("tr", "caption")
        if block:
            out.end()
            if tag in SPACED and not (tag in ("ul", "ol") and out.indent):
                out.gap = True
            keep = None
            if tag == "li":
                keep = out.indent
                out.mark = extra or "- "
                out.indent += " " * len(out.mark)
            elif tag in ("dd", "blockquote"):
                keep = out.indent
                out.indent += "  "
            todo.append(("out", node, keep))
        if tag == "pre":
            pre += 1
        children = node.children
        if tag == "details" and "open" not in _attributes(node.attrs):
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
        if tag == "ol":
            a = _attributes(node.attrs)
            n = int(a["start"]) if a.get("start", "").lstrip("-").isdecimal() and len(a["start"]) < 9 else 1
            steps = []
            for c in children:
                if isinstance(c, Node) and c.tag == "li" and not _hidden(c):
                    steps.append(("in", c, f"{n}. "))
                    n += 1
                else:
                    steps.append(("in", c, None))
            todo.extend(reversed(steps))
        else:
            todo.extend([("in", c, None) for c in reversed(children)])
    out.end()
    while out.lines and not out.lines[-1]:
        out.lines.pop()
    return "\n".join(out.lines)


def render(source: str | None) -> str:
    """The visible text of a page."""
    return _render(build(source.replace("\r\n", "\n").replace("\0", ""))) if source else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row for each page: its id and visible text."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "h"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([render(x) for x in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("h")).mapInArrow(run, f"id {id_type}, text string").withColumnRenamed("id", id_col)
