"""HTML to text by layout: a tree with implied tags, then all visible text with block spacing, lists and aligned table cells."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.llm.common import ship_package, tidy
from episodica.llm.tokens import slices

#: Elements nested deeper than this are put into the one at that depth, so that no text is lost and no stack overflows.
MOST_DEPTH = 200
#: Columns that a cell takes by colspan at most, and rows by rowspan (HTML's bounds).
MOST_SPAN, MOST_ROWS = 1_000, 65_534
#: A table that needs more blanks than this to align is padded to WIDEST_PAD a column, without columns that hold no text; if that needs more
#: blanks too, its cells are parted by two blanks alone.
MOST_PADDING, WIDEST_PAD = 4_000_000, 40
#: HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes datalist object audio video canvas".split())
#: What drawings and formulas hold without showing it, and the elements of these that hold HTML.
FOREIGN_UNSEEN = frozenset("desc metadata defs symbol clippath mask marker pattern annotation annotation-xml".split())
HTML_POINTS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: HTML that ends a drawing or formula it begins in.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset menu".split())
BLOCK = SPACED | frozenset("html body div article section nav aside header footer main address form li dt dd tr td th thead tbody tfoot caption figcaption details summary center legend dir hgroup search".split())
#: Lines of their own that end no paragraph.
LINES = frozenset("option optgroup".split())
#: An open element of the second set, or of the last, is closed by the first's start; search goes up to an element of the third set.
CLOSES: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table", "thead", "tbody", "tfoot"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
#: A paragraph ends where one of these begins, and nothing ends it from outside these.
P_SCOPE = frozenset(["td", "th", "caption", "table", "button", "html"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Types of input that show no text of the page's.
BLANK_INPUTS = frozenset("hidden password checkbox radio file color range image".split())
HEAD_ONLY = frozenset("meta link base title style script template noscript".split())

_NAME = r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+"
_VALUE = r"[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:\"{0}[^\"]*+{1}(?:\"|\Z)|'{0}[^']*+{1}(?:'|\Z)|{0}[^ \t\n\f\r>\"'][^ \t\n\f\r>]*+{1})?+"
#: By HTML's rules a quote opens a string only where a value begins; possessive, so that no tag is read twice.
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^ \t\n\f\r/>]*+)((?:[ \t\n\f\r/]++|{_NAME}(?:{_VALUE.format('', '')})?+)*+)(?:>|\Z)", re.S)
_PAIR = re.compile(rf"({_NAME})(?:{_VALUE.format('(', ')')})?+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_INTEGER = re.compile(r"[ \t\n\f\r]*([+-]?\d{1,9})")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """unseen: taken away with all it holds. veiled: its own text is not shown, but elements in it may be visible again."""

    __slots__ = ("attrs", "depth", "foreign", "kids", "tag", "unseen", "veiled")

    def __init__(self, tag: str, attrs: str = "", depth: int = 0, foreign: bool = False, veiled: bool = False):
        self.tag, self.attrs, self.kids, self.depth, self.foreign = tag, attributes(attrs), [], depth, foreign
        gone, visibility = _display(self.attrs.get("style", ""))
        self.unseen = tag in UNSEEN or (foreign and tag in FOREIGN_UNSEEN) or "hidden" in self.attrs or (tag == "dialog" and "open" not in self.attrs) or gone
        self.veiled = VISIBILITY.get(visibility, veiled)

    def shown(self) -> list:
        return [k for k in self.kids if not isinstance(k, str)] if self.veiled else self.kids


def attributes(source: str) -> dict[str, str]:
    """Names, in lower case, and values of a tag's attributes; the first of a name counts."""
    out: dict[str, str] = {}
    if source:
        for m in _PAIR.finditer(source):
            value = m.group(2) or m.group(3) or m.group(4) or ""
            out.setdefault(m.group(1).lower(), html.unescape(value) if "&" in value else value)
    return out


#: What the property says of an element's own text; other values leave it as its parent's.
VISIBILITY = {"hidden": True, "collapse": True, "visible": False, "initial": False}


def _display(style: str) -> tuple[bool, str]:
    """Whether declarations, of which the last important or else the last counts, take an element away, and the visibility they give."""
    own: dict[str, tuple[bool, str]] = {}
    for part in _COMMENT.sub("", style).lower().split(";") if style else ():
        name, _, value = part.partition(":")
        value, mark, _ = value.partition("!")
        if bool(mark) >= own.get(name.strip(), (False, ""))[0]:
            own[name.strip()] = (bool(mark), value.strip())
    return own.get("display", (False, ""))[1] == "none", own.get("visibility", (False, ""))[1]


def parse(source: str) -> Node:
    """The tree of a page. Tags that HTML implies are closed or opened; end tags without a start, and stray markup, are dropped; text is not."""
    root = Node("html")
    stack, at, n = [root], 0, len(source)

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and not s.isspace():
                stack.pop()
            stack[-1].kids.append(html.unescape(s) if "&" in s else s)

    def close(tags: frozenset[str], scope: frozenset[str]) -> None:
        cut = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                cut = i
            elif stack[i].tag in scope:
                break
        if cut:
            del stack[cut:]

    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if not m.group(2):
            if stack[-1].foreign and source.startswith("<![CDATA[", m.start()):
                end = source.find("]]>", m.start())
                stack[-1].kids.append(source[m.start() + 9 : end if end >= 0 else n])
                at = end + 3 if end >= 0 else n
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if tag == "br":
                stack[-1].kids.append(Node("br", veiled=stack[-1].veiled))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag or (tag in HEADINGS and stack[i].tag in HEADINGS):
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if tag == "html":
            continue
        if stack[-1].foreign and stack[-1].tag not in HTML_POINTS:
            if tag not in BREAKOUT:
                closed = m.group(3).endswith("/") and max((p.end() for p in _PAIR.finditer(m.group(3))), default=0) < len(m.group(3))
                node = _open(stack, tag, m.group(3), True)
                if not closed:
                    stack.append(node)
                continue
            while stack[-1].foreign and stack[-1].tag not in HTML_POINTS:
                stack.pop()
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            stack.pop()
        if tag in BLOCK and tag not in ("html", "body"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in P_SCOPE:
                    break
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            stack.pop()
        if tag in CLOSES:
            close(*CLOSES[tag])
            if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                stack.append(_open(stack, "tr", ""))
        foreign = tag in ("svg", "math")
        node = _open(stack, tag, m.group(3), foreign)
        if foreign and m.group(3).endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            body = source[at : end.start() if end else n]
            node.kids.append(html.unescape(body) if tag == "textarea" else body)
            at = end.end() if end else n
        elif tag == "input":
            if node.attrs.get("type", "").strip().lower() not in BLANK_INPUTS and node.attrs.get("value"):
                node.kids.append(f" {node.attrs['value']} ")
        elif tag not in VOID:  # a slash before the end means nothing in HTML
            stack.append(node)
    return root


def _open(stack: list[Node], tag: str, attrs: str, foreign: bool = False) -> Node:
    while stack[-1].depth >= MOST_DEPTH:
        stack.pop()
    node = Node(tag, attrs, stack[-1].depth + 1, foreign, stack[-1].veiled)
    stack[-1].kids.append(node)
    return node


class Page:
    """Lines under construction: runs of white space become one space, blocks start lines, and margins between blocks do not add up."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.run: list[str] = []
        self.gap, self.indent, self.mark = 0, "", ""

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s[:1] == " " and (not self.run or self.run[-1].endswith((" ", "\n"))):
            s = s[1:]
        if s:
            self.run.append(s)

    def flush(self) -> None:
        s = "".join(self.run).rstrip(" ").removesuffix("\n")  # a break at a block's end makes no line
        self.run = []
        if s:
            self.put(s.split("\n"))

    def put(self, rows: list[str]) -> None:
        if self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 1
        for row in rows:
            head = self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent
            self.mark = ""
            self.lines.append((head + row).rstrip(" "))

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)


def _number(name: str, attrs: dict[str, str], default: int) -> int:
    m = _INTEGER.match(attrs[name]) if name in attrs else None
    return int(m.group(1)) if m else default


def _render(node: Node, page: Page, ordinal: list[int]) -> None:
    tag = node.tag
    if node.unseen:
        return
    if tag == "br":
        page.run += [] if node.veiled else ["\n"]
        return
    if tag == "wbr":
        return
    gap = 2 if tag in SPACED else 1 if tag in BLOCK or tag in LINES or (node.foreign and tag == "text") else 0
    if tag in ("ul", "ol", "menu") and page.indent:
        gap = 1  # a list in a list stays close
    if gap:
        page.block(gap)
    if tag == "hr":
        if not node.veiled:
            page.put(["---"])
    elif tag == "pre":
        body = _plain(node)
        body = body[1:] if body.startswith("\n") else body
        if body.strip():
            page.put(body.rstrip("\n").split("\n"))
    elif tag == "table":
        _table(node, page)
    elif tag == "li":
        mark = "- "
        if ordinal:
            ordinal[0] = _number("value", node.attrs, ordinal[0])
            mark = f"{ordinal[0]}. "
            ordinal[0] += 1
        old = page.indent
        page.indent, page.mark = old + " " * len(mark), "" if node.veiled else mark
        _children(node, page, [])
        page.flush()
        page.indent, page.mark = old, ""
    elif tag in ("blockquote", "dd"):
        old, page.indent = page.indent, page.indent + "  "
        _children(node, page, [])
        page.flush()
        page.indent = old
    else:
        _children(node, page, [_number("start", node.attrs, 1)] if tag == "ol" else [])
    if gap:
        page.block(gap)


def _children(node: Node, page: Page, ordinal: list[int]) -> None:
    for kid in node.shown():
        if isinstance(kid, str):
            page.text(kid)
        else:
            _render(kid, page, ordinal)


def _plain(node: Node) -> str:
    if node.unseen:
        return ""
    if node.tag == "br":
        return "" if node.veiled else "\n"
    return "".join(k if isinstance(k, str) else _plain(k) for k in node.shown())


class Grid:
    """Cells of a table in the making: of each row the columns that hold text, and the runs of columns that cells from above still take."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.held: list[tuple[int, int, int]] = []  # (first column, column after, row from which they are free), by first column
        self.row = 0

    def group(self) -> None:
        """No cell reaches beyond its group of rows."""
        self.held = []

    def add(self, cells: list[tuple[list[str], int, int]]) -> None:
        """A row: of each cell its lines, and the columns and rows that it takes."""
        self.row += 1
        if any(free <= self.row for _, _, free in self.held):
            self.held = [h for h in self.held if h[2] > self.row]
        row: list[tuple[int, list[str]]] = []
        new: list[tuple[int, int, int]] = []
        at = seen = 0
        for lines, across, down in cells:
            while seen < len(self.held) and self.held[seen][0] <= at:
                at, seen = max(at, self.held[seen][1]), seen + 1
            if any(lines):
                row.append((at, lines))
            if down > 1:
                if new and new[-1][1:] == (at, self.row + down):
                    new[-1] = (new[-1][0], at + across, self.row + down)
                else:
                    new.append((at, at + across, self.row + down))
            at += across
        if new:
            self.held = sorted(self.held + new)
        if row:
            self.rows.append(row)

    def _starts(self) -> dict[int, int]:
        """Where each column that holds text begins."""
        widths: dict[int, int] = {}
        for row in self.rows:
            for c, lines in row:
                widths[c] = max(widths.get(c, 0), *map(len, lines))
        for widest, empty in ((None, 2), (WIDEST_PAD, 0)):
            starts, at, before = {}, 0, 0
            for c in sorted(widths):
                at += empty * (c - before)
                starts[c], before = at, c + 1
                at += (widths[c] if widest is None else min(widest, widths[c])) + 2
            if sum(max(len(lines) for _, lines in row) * starts[row[-1][0]] for row in self.rows) <= MOST_PADDING:
                return starts
        return dict.fromkeys(widths, 0)

    def lines(self) -> Iterator[str]:
        starts = self._starts()
        for row in self.rows:
            for k in range(max(len(lines) for _, lines in row)):
                parts, n = [], 0
                for c, lines in row:
                    if k < len(lines) and lines[k]:
                        pad = max(starts[c], n + 2 if n else 0) - n
                        parts += [" " * pad, lines[k]]
                        n += pad + len(lines[k])
                yield "".join(parts)


def _table(table: Node, page: Page) -> None:
    """Rows of cells under one another; what stands in a table outside its cells comes before it."""
    grid = Grid()
    todo: list = list(reversed(table.shown()))
    while todo:
        kid = todo.pop()
        if kid is None:
            grid.group()
        elif isinstance(kid, str):
            page.text(kid)
        elif kid.unseen:
            continue
        elif kid.tag in ("thead", "tbody", "tfoot"):
            grid.group()
            todo.append(None)
            todo += reversed(kid.shown())
        elif kid.tag == "tr":
            cells: list[tuple[list[str], int, int]] = []
            for cell in kid.shown():
                if isinstance(cell, str):
                    if not cell.isspace():
                        cells.append(([_SPACE.sub(" ", cell).strip()], 1, 1))
                elif not cell.unseen:
                    own = Page()
                    _children(cell, own, []) if cell.tag in ("td", "th") else _render(cell, own, [])
                    own.flush()
                    down = _number("rowspan", cell.attrs, 1)
                    cells.append((own.lines, max(1, min(MOST_SPAN, _number("colspan", cell.attrs, 1))), MOST_ROWS if down == 0 else min(MOST_ROWS, down)))
            grid.add(cells)
        else:
            _render(kid, page, [])
    page.flush()
    for line in grid.lines():
        page.put([line])


def render(source: str) -> str:
    """All visible text of a page."""
    page = Page()
    _children(parse(source), page, [])
    page.flush()
    return "\n".join(page.lines).replace("\xa0", " ")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, text and n_chars of every page.

    Null HTML has null text and 0 characters, empty HTML empty text. Markup of any kind is taken, broken or cut off too. Rows are kept as they
    are, repeated and null ids too; other columns are ignored. No shuffle; a worker holds one slice of pages and one tree at once.
    """
    ship_package(pages.sparkSession)
    schema = T.StructType([pages.schema[id_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sources in slices(batch.column(1)):
                null = batch.column(1).slice(first, len(sources)).is_null().to_pylist()
                texts = [None if no else render(s.decode("utf-8", "replace")) for s, no in zip(sources, null, strict=True)]
                cols = [batch.column(0).slice(first, len(sources)), pa.array(texts, pa.string()), pa.array([len(t or "") for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
            tidy()

    return pages.select(id_col, F.col(html_col).cast("string")).mapInArrow(run, schema)
