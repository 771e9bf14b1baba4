"""HTML extraction by layout-aware rendering.

A tokeniser and tree builder with the usual implied tags (``p``, ``li``, ``dt``/``dd``,
``option``, table parts) makes a tree; a renderer then emits all visible text: blocks on lines
of their own with a blank line around paragraphs, list items with marks and indentation, table
cells padded to the width of their columns. Invisible are ``head`` parts, scripts, styles,
templates, form values, ``hidden`` elements and elements whose style says ``display:none`` or
``visibility:hidden``.

Tables are laid out from the innermost outwards, at any depth; cells may span columns and rows.

Defined results: a null, empty or tagless page gives its own text (empty for null); an
unclosed tag or comment lasts to the end; nesting is followed to any depth without recursion;
pages of any length are rendered whole; an empty table gives an empty result; repeated rows are rendered
one by one; of repeated attributes the first holds; input columns named like the results are replaced.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe embed canvas datalist input audio video map".split())
#: Elements whose tags may close themselves.
FOREIGN = frozenset("svg math".split())
BLOCK = frozenset("address article aside blockquote body center details dd dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure".split())
CLOSES_P = BLOCK - {"body", "html", "dd", "dt", "li"} | {"li", "dd", "dt"}
#: A start tag closes these open elements, up to the nearest element of the scope.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: An end tag never closes an element outside the nearest of these.
SCOPES = frozenset("table td th caption body html".split())
#: Except these end tags.
CLOSES_SCOPES = frozenset("table tr tbody thead tfoot body html".split())
#: A block's start tag closes no paragraph outside the nearest of these.
P_SCOPES = SCOPES | {"button"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_INTEGER = re.compile(r"\s*([+-]?\d{1,9})")
# The largest spans that browsers take.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "lines")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []
        #: Of a table, its lines.
        self.lines: list[str] = []


def parse(page: str) -> Node:
    """The tree of a page; text children are strings with references resolved."""
    root = Node("#root")
    stack = [root]
    #: Of each tag, the places of its open elements in the stack, so that no step searches the stack.
    places: dict[str, list[int]] = {}
    at, end = 0, len(page)

    def text(upto: int) -> None:
        if upto > at:
            raw = page[at:upto]
            stack[-1].children.append(html.unescape(raw) if "&" in raw else raw)

    def nearest(tags) -> int:
        """The innermost open element of these tags; 0: none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text(end)
            break
        text(m.start())
        at = m.end()
        if m.group(1):
            tag = m.group(1).lower()
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not places.get("p"):
                stack[-1].children.append(Node("p"))
            else:
                k = nearest((tag,))
                if k and (tag in CLOSES_SCOPES or k >= nearest(SCOPES)):
                    close(k)
        elif m.group(2):
            tag, attrs = m.group(2).lower(), m.group(3) or ""
            if tag in IMPLIED:
                closes, scope = IMPLIED[tag]
                within = nearest(scope)
                if within:
                    inner = [held[i] for held in map(places.get, closes) if held and (i := bisect_right(held, within)) < len(held)]
                    if inner:
                        close(min(inner))
                elif k := nearest(closes):
                    close(k)
            if tag in CLOSES_P:
                k = nearest(("p",))
                if k > nearest(P_SCOPES):
                    close(k)
            if tag in ("html", "body") and places.get(tag):
                continue
            if tag == "body" and stack[-1].tag == "head":
                close(len(stack) - 1)
            node = Node(tag, attrs)
            stack[-1].children.append(node)
            if tag in VOID or attrs.endswith("/") and (tag in UNSEEN or (tag in FOREIGN or nearest(FOREIGN))):
                continue
            if tag in RAW:
                closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                stop = closing.start() if closing else end
                node.children.append(html.unescape(page[at:stop]) if tag == "textarea" else page[at:stop])
                at = closing.end() if closing else end
                continue
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    return root


def width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text) if not text.isascii() else len(text)


class Flow:
    """Lines under construction: blocks, blank lines and collapsed spaces."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.space = False
        self.lead: list[str] = []
        self.mark = ""

    def text(self, s: str) -> None:
        words = _SPACES.sub(" ", s)
        if words == " " or not words:
            self.space |= bool(words)
            return
        if self.now and (self.space or words[0] == " "):
            self.now.append(" ")
        self.now.append(words.strip(" "))
        self.space = words[-1] == " "

    def verbatim(self, s: str) -> None:
        for k, line in enumerate(s.replace("\r\n", "\n").split("\n")):
            if k:
                self.line(True)
            if line:
                self.now.append(line)

    def line(self, keep_blank: bool = False) -> None:
        if self.now or keep_blank:
            if self.gap and self.lines and self.lines[-1] != "":
                self.lines.append("")
            lead = "".join(self.lead)
            if self.mark:
                lead = lead[: len(lead) - len(self.mark)] + self.mark
                self.mark = ""
            self.lines.append((lead + "".join(self.now)).rstrip() if self.now else "")
            self.now, self.gap = [], False
        self.space = False

    def block(self, spaced: bool) -> None:
        self.line()
        self.gap |= spaced and bool(self.lines)


def visible(node: Node) -> bool:
    if node.tag in UNSEEN:
        return False
    if not node.attrs:
        return True
    found = attributes(node)
    return "hidden" not in found and not _HIDDEN.search(html.unescape(found.get("style", "")))


def attributes(node: Node) -> dict[str, str]:
    """Names in lower case; of repeated ones the first holds."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(node.attrs):
        found.setdefault(name.lower(), "".join(values))
    return found


def number(node: Node, name: str, default: int) -> int:
    m = _INTEGER.match(attributes(node).get(name, "")) if name in node.attrs.lower() else None
    return int(m.group(1)) if m else default


def chosen(select: Node) -> list[Node]:
    """The options that are selected; without one the first, unless several may be."""
    options, todo = [], [select]
    while todo:
        n = todo.pop()
        if n.tag == "option":
            options.append(n)
        else:
            todo += [c for c in reversed(n.children) if not isinstance(c, str)]
    picked = [o for o in options if "selected" in attributes(o)]
    several = "multiple" in attributes(select)
    return picked if several else picked[-1:] or options[:1]


def render(root: Node) -> str:
    flow = Flow()
    # Inner tables come after the ones that hold them, so the last is laid out first: none waits for another.
    tables, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.tag == "table":
            tables.append(x)
        todo += [c for c in x.children if isinstance(c, Node)]
    for table in reversed(tables):
        table.lines = table_lines(table)
    _fill(flow, root)
    flow.line()
    return "\n".join(flow.lines).strip("\n")


def _fill(flow: Flow, root: Node) -> None:
    # Entries: a node or text to show, or what to do when a node ends.
    todo: list = [root]
    lists: list[list] = []
    pre = 0
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if pre:
                flow.verbatim(x)
            else:
                flow.text(x)
            continue
        if isinstance(x, tuple):
            kind, node = x
            if node.tag == "pre":
                pre -= 1
            if kind == "list":
                lists.pop()
            if kind in ("li", "indent"):
                flow.line()
                flow.lead.pop()
                flow.mark = ""
            flow.block(node.tag in SPACED and (kind != "list" or not lists))
            continue
        if x.tag == "#root":
            todo += reversed(x.children)
            continue
        if not visible(x):
            continue
        tag = x.tag
        if tag == "select":
            todo += reversed(chosen(x))
            continue
        if tag == "br":
            flow.line(True)
        elif tag == "hr":
            flow.block(False)
        elif tag == "img":
            continue
        elif tag == "table":
            flow.block(True)
            for line in x.lines:
                flow.now = [line]
                flow.line()
            flow.block(True)
        elif tag in BLOCK:
            kind = "block"
            flow.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
            if tag in ("ul", "ol", "menu"):
                lists.append([tag, number(x, "start", 1)])
                kind = "list"
            elif tag == "li":
                if lists and lists[-1][0] == "ol":
                    flow.mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                else:
                    flow.mark = "- "
                flow.lead.append(" " * len(flow.mark))
                kind = "li"
            elif tag in ("dd", "blockquote"):
                flow.lead.append("  ")
                kind = "indent"
            elif tag == "pre":
                pre += 1
            todo.append((kind, x))
            todo += reversed(x.children)
        else:
            todo += reversed(x.children)


def _rows(table: Node) -> tuple[list[Node], list[list[Node]]]:
    """Captions and rows of cells, in order. Content outside cells becomes a cell of its own row."""
    before, rows = [], []
    todo = list(reversed(table.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                loose = Node("td")
                loose.children.append(x)
                rows.append([loose])
        elif not visible(x) or x.tag in ("colgroup", "col"):
            continue
        elif x.tag in ("thead", "tbody", "tfoot"):
            todo += reversed(x.children)
        elif x.tag == "caption":
            before.append(x)
        elif x.tag == "tr":
            rows.append([c if isinstance(c, Node) else _cell(c) for c in x.children if (isinstance(c, Node) and visible(c)) or (isinstance(c, str) and c.strip())])
        else:
            rows.append([x])
    return before, rows


def _cell(text: str) -> Node:
    cell = Node("td")
    cell.children.append(text)
    return cell


def placed(rows: list[list[Node]]) -> list[list[tuple[int, list[str], int]]]:
    """(column, lines, columns spanned) of the cells of each row; cells that span rows keep their columns in those below."""
    out, busy = [], {}
    for k, row in enumerate(rows):
        cells, at = [], 0
        for cell in row:
            while busy.get(at, 0) > k:
                at += 1
            across = max(1, min(number(cell, "colspan", 1), MOST_COLUMNS))
            down = number(cell, "rowspan", 1)
            cells.append((at, cell_lines(cell) or [""], across))
            if down != 1:
                # A span of 0 lasts to the end of the table.
                until = k + (min(down, MOST_ROWS) if down > 0 else MOST_ROWS)
                busy |= {c: until for c in range(at, at + across)}
            at += across
        out.append(cells)
    return out


def table_lines(table: Node) -> list[str]:
    captions, rows = _rows(table)
    lines = [line for c in captions for line in cell_lines(c)]
    grid = placed(rows)
    widths: dict[int, int] = {}
    for row in grid:
        for at, cell, across in row:
            if across == 1:
                widths[at] = max(widths.get(at, 0), *(width(x) for x in cell))
    # Columns that no cell stands in alone take no room.
    begin, due = {}, 0
    for at in range(max((at for row in grid for at, _, _ in row), default=-1) + 1):
        begin[at] = due
        due += widths[at] + 2 if at in widths else 0
    for row in grid:
        for k in range(max((len(cell) for _, cell, _ in row), default=0)):
            out, at_width = "", 0
            for at, cell, _ in row:
                part = cell[k] if k < len(cell) else ""
                if part:
                    gap = max(begin[at] - at_width, 2 if out else 0)
                    out += " " * gap + part
                    at_width += gap + width(part)
            if out.strip():
                lines.append(out.rstrip())
    return lines


def cell_lines(cell: Node) -> list[str]:
    flow = Flow()
    inner = Node("#root")
    inner.children = cell.children
    _fill(flow, inner)
    flow.line()
    return [x for x in flow.lines if x]


def extract(page: str | None) -> tuple[str, str | None]:
    """Visible text and title."""
    if not page:
        return "", None
    title = re.search(r"<title[^>]*>(.*?)</title", page, re.I | re.S)
    # A null character would be lost between engines; browsers show U+FFFD.
    text = render(parse(page.replace("\x00", "�")))
    return text, _SPACES.sub(" ", html.unescape(title.group(1))).strip() if title else None


def extracted(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``title``."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        got = [extract(t) for t in texts]
        return [pa.array([t.encode("utf-8", "replace").decode() for t, _ in got], pa.string()), pa.array([t for _, t in got], pa.string())]

    return add_columns(pages, column, {"text": T.StringType(), "title": T.StringType()}, make)


def extract_all(pages: DataFrame) -> DataFrame:
    return extracted(pages.select("page_id", "url", "html")).drop("html")
