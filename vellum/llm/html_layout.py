"""Layout-aware text of HTML pages: a tree builder with implied tags, visibility rules, and a renderer for blocks, lists and tables.

The builder follows the usual repairs: void elements, end tags implied by what follows (p, li, dt, dd, option, table parts), table parts
closed only within their table, stray end tags ignored, open elements closed at the end, formatting elements closed with their block.
Nothing is rendered of head, script, style, template, noscript, of form controls' hidden values, of elements with the ``hidden`` attribute, an inline
``display:none`` or ``visibility:hidden`` (a descendant may be visible again), or of closed ``details`` beyond their summary. Nor is what
stands in for frames, audio, video and canvas, and in svg and math what describes or defines (title, desc, defs, annotation). Other text of svg,
math and object is rendered, and all options of a select.
White space collapses except in pre and textarea. Blocks stand on lines of their own, paragraphs and headings are set off by a blank line. List items
carry their marker (bullets, or numbers from ``start``/``value``) and hang; table cells are padded to their columns, with column
and row spans, and parted by " | ". Text and elements in a table that are in no cell stand on lines before it; rows and cells are found within
forms and other elements between them and their table.

A null page has an empty text, as has one without visible text. Elements may be nested to any
depth (the renderer has a stack of its own); indentation ends at ``MAX_INDENT``. Repeated rows are rendered alike; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Generator, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_INDENT = 240
MAX_COLUMN = 80
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes template".split())
SILENT = frozenset("head script style template noscript title iframe embed noembed noframes datalist audio video canvas".split())
BLOCK = frozenset("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr menu".split())
CLOSES_P = BLOCK - frozenset("body html tbody td tfoot th thead tr caption option optgroup legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: start tag -> (elements it closes, elements beyond which it does not look)
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "table"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])), "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])), "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])), "tbody": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])), "body": (frozenset(["head"]), frozenset()),
}
#: elements that are never shown within an outer one
UNSHOWN = {"svg": frozenset("desc defs metadata symbol".split()), "math": frozenset("annotation annotation-xml".split())}
SECTIONS = frozenset("colgroup thead tbody tfoot".split())
TABLE_PARTS = frozenset("caption colgroup thead tbody tfoot tr td th".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "rows")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.rows = False  # whether rows or cells of the table around it are within


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if source and not source.isspace():
        for m in ATTRIBUTE.finditer(source):
            out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


class Tree:
    """Stack of open elements over the tree built so far."""

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = defaultdict(list)  # tag -> where it is on the stack

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.open))
        self.open.append(node)

    def pop(self, down: int) -> None:
        while len(self.open) > down:
            self.at[self.open.pop().tag].pop()

    def last(self, tags: frozenset[str]) -> int:
        return max((x[-1] for t in tags if (x := self.at.get(t))), default=0)

    def close(self, tags: frozenset[str], stop: frozenset[str]) -> None:
        k = self.last(tags)
        if k and k >= self.last(stop):
            self.pop(k)

    def start(self, tag: str, attrs: dict[str, str], empty: bool) -> None:
        if tag == "html":
            for k, v in attrs.items():
                self.root.attrs.setdefault(k, v)
            return
        if tag in CLOSES_P:
            self.close(frozenset(["p"]), frozenset(["table", "td", "th", "caption", "li", "div", "button", "object"]))
        if self.open[-1].tag == "head" and tag not in ("base", "link", "meta", "noscript", "script", "style", "template", "title"):
            self.pop(len(self.open) - 1)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.pop(len(self.open) - 1)
        if tag in IMPLIED:
            self.close(*IMPLIED[tag])
        if tag in TABLE_PARTS:
            if not self.at["table"]:
                return  # a table part outside a table: its content stays, the tag does not
            want = {"td": "tr", "th": "tr", "tr": "tbody"}.get(tag)
            if want == "tr" and self.open[-1].tag != "tr":
                self.start("tr", {}, False)
            elif want == "tbody" and self.open[-1].tag == "table":
                self.start("tbody", {}, False)
            for n in reversed(self.open):
                if n.tag == "table" or n.rows:
                    break
                n.rows = True
        node = Node(tag, attrs)
        if any(self.at.get(outer) and tag in inner for outer, inner in UNSHOWN.items()):
            attrs["hidden"] = ""
        self.open[-1].children.append(node)
        if tag not in VOID and not empty:
            self.push(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {}, True)
            return
        stop = frozenset() if tag == "table" else frozenset(["table"]) if tag in TABLE_PARTS else frozenset(["td", "th", "caption", "table"])
        if tag in HEADINGS:
            self.close(HEADINGS, stop)
        elif tag not in ("html", "body"):
            if tag == "p" and not self.at["p"]:
                self.start("p", {}, True)
            self.close(frozenset([tag]), stop)

    def text(self, data: str) -> None:
        if self.open[-1].tag == "head" and not data.isspace():
            self.pop(len(self.open) - 1)
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    tree, at, n = Tree(), 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            tree.text(unescape(html[at:]))
            break
        if m.start() > at:
            tree.text(unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            tree.end(tag)
            continue
        source = m[3]
        empty = source.endswith("/") and (tag in ("svg", "math", "path") or bool(tree.at["svg"] or tree.at["math"]))
        tree.start(tag, attributes(source), empty)
        if tag in RAW and not empty:
            e = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            data = html[at : e.start() if e else n]
            if tag in ("title", "textarea"):
                data = unescape(data)
            if tree.open[-1].tag == tag:
                tree.open[-1].children.append(data)
                tree.pop(len(tree.open) - 1)
            at = e.end() if e else n
    return tree.root


def styled(attrs: dict[str, str]) -> tuple[bool, bool | None]:
    """Whether the element makes no box; visibility it sets (None: as inherited)."""
    if "hidden" in attrs:
        return True, None
    style = attrs.get("style")
    if not style:
        return False, None
    rules = {k.strip().lower(): v.replace("!important", "").strip().lower() for k, _, v in (x.partition(":") for x in style.split(";"))}
    seen = rules.get("visibility")
    return rules.get("display") == "none", None if seen is None or seen == "inherit" else seen == "visible"


class Out:
    """Lines written so far; ``gap`` blank lines are due before the next one."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.indent, self.marker = "", ""

    def text(self, data: str, keep: bool) -> None:
        if keep:
            first, *more = data.split("\n")
            self.line.append(first)
            for x in more:
                self.flush(True)
                self.line.append(x)
            return
        data = SPACE.sub(" ", data)
        if data.startswith(" ") and (not self.line or self.line[-1].endswith(" ")):
            data = data[1:]
        if data:
            self.line.append(data)

    def flush(self, force: bool = False) -> None:
        line = "".join(self.line).rstrip(" ")
        self.line = []
        if line or force:
            if self.lines and self.gap:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            self.lines.append((self.indent[: max(0, len(self.indent) - len(self.marker))] + self.marker + line).rstrip(" "))
            self.marker = ""

    def space(self, n: int) -> None:
        self.flush()
        self.gap = max(self.gap, n)


def number(text: str | None, default: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", text or "")
    return int(m[1]) if m else default


#: a piece of rendering that yields the pieces it waits for
Work = Generator["Work", None, None]


def run(work: Work) -> None:
    stack = [work]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def render(node: Node, out: Out, keep: bool = False, shown: bool = True) -> Work:
    for child in node.children:
        if isinstance(child, str):
            if shown:
                out.text(child, keep)
            continue
        tag = child.tag
        if tag in SILENT:
            continue
        gone, seen = styled(child.attrs)
        if gone:
            continue
        visible = shown if seen is None else seen
        if tag == "br":
            if visible:
                out.flush(True)
        elif tag == "hr":
            out.space(1)
            if visible:
                out.line.append("----")
            out.space(1)
        elif tag == "input":
            if visible and child.attrs.get("type", "").lower() in ("button", "submit", "reset") and child.attrs.get("value"):
                out.text(child.attrs["value"], False)
        elif tag == "table":
            out.space(1)
            yield table(child, out, visible)
            out.space(1)
        elif tag in ("ul", "ol", "menu"):
            out.space(0 if out.indent else 1)
            yield items(child, out, visible)
            out.space(0 if out.indent else 1)
        elif tag == "details" and "open" not in child.attrs:
            out.space(0)
            for x in child.children:
                if isinstance(x, Node) and x.tag == "summary":
                    yield render(x, out, keep, visible)
                    break
            out.space(0)
        elif tag in BLOCK or tag == "text":
            gap = 1 if tag in SPACED else 0
            out.space(gap)
            indent = out.indent
            if tag in ("blockquote", "dd"):
                out.indent = (out.indent + "  ")[:MAX_INDENT]
            yield render(child, out, keep or tag in ("pre", "xmp"), visible)
            out.flush()
            out.indent = indent
            out.space(gap)
        else:
            yield render(child, out, keep or tag == "textarea", visible)


def items(node: Node, out: Out, shown: bool) -> Work:
    ordered, at = node.tag == "ol", number(node.attrs.get("start"), 1)
    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            if isinstance(child, Node) or not child.isspace():
                one = Node("", {})
                one.children.append(child)
                yield render(one, out, False, shown)
            continue
        gone, seen = styled(child.attrs)
        if gone:
            continue
        at = number(child.attrs.get("value"), at)
        mark = f"{at}. " if ordered else "- "
        at += 1
        out.flush(len(out.marker) >= MAX_INDENT)  # so many markers stand on a line of their own
        indent, marker = out.indent, out.marker
        # an item that opens with a list keeps both markers on its first line
        out.indent = (out.indent + " " * len(mark))[:MAX_INDENT]
        out.marker = marker + mark
        yield render(child, out, False, shown if seen is None else seen)
        out.flush()
        out.indent, out.marker = indent, ""


def parts_of(node: Node, shown: bool) -> Iterator[tuple[str, Node | str, bool]]:
    """A table's parts in their order: ("row", row, visible), ("cell", cell, visible), ("stray", what is in no cell, visible)."""
    # what is left of an element, whether it shows, whether it is in a row, whether its first row goes on with the one around it
    stack = [[iter(node.children), shown, False, False]]
    while stack:
        frame = stack[-1]
        child = next(frame[0], None)
        if child is None:
            stack.pop()
            continue
        if isinstance(child, str):
            if not child.isspace():
                yield "stray", child, frame[1]
            continue
        if not (child.tag in ("td", "th", "tr") or child.tag in SECTIONS or child.rows and child.tag not in SILENT):
            yield "stray", child, frame[1]
            continue
        gone, seen = styled(child.attrs)
        if gone:
            continue
        visible = frame[1] if seen is None else seen
        if child.tag in ("td", "th"):
            yield "cell", child, visible
            continue
        if child.tag == "tr":
            if not frame[3]:
                yield "row", child, visible
            frame[3] = False
        stack.append([iter(child.children), visible, frame[2] or child.tag == "tr", frame[2] and child.tag != "tr"])


def table(node: Node, out: Out, shown: bool) -> Work:
    rows: list[list[tuple[Node, bool]]] = []
    for kind, part, visible in parts_of(node, shown):
        if kind == "row":
            rows.append([])
        elif kind == "cell":
            rows[-1].append((part, visible))
        else:
            one = Node("", {})
            one.children.append(part)
            yield render(one, out, False, visible)
            out.flush()
    grid: list[dict[int, tuple[list[str], int]]] = []
    busy: dict[int, int] = {}  # column -> rows that a row span still covers
    for row in rows:
        cells: dict[int, tuple[list[str], int]] = {}
        taken = {c for c, k in busy.items() if k > 0}
        for c in taken:
            busy[c] -= 1
        at = 0
        for cell, visible in row:
            while at in taken:
                at += 1
            inner = Out()
            yield render(cell, inner, False, visible)
            inner.flush()
            wide = max(1, min(1000, number(cell.attrs.get("colspan"), 1)))
            cells[at] = (inner.lines, wide)
            for c in range(at, at + wide):
                busy[c] = max(busy.get(c, 0), max(1, min(65534, number(cell.attrs.get("rowspan"), 1))) - 1)
            at += wide
        if any(lines for lines, _ in cells.values()):
            grid.append(cells)
    width: dict[int, int] = {}
    for cells in grid:
        for c, (lines, wide) in cells.items():
            if wide == 1:
                width[c] = max(width.get(c, 0), min(MAX_COLUMN, max(map(len, lines), default=0)))
    # columns that only spans cover, or that hold nothing anywhere, take no room
    used = sorted({c for c, w in width.items() if w} | {c for cells in grid for c, (lines, wide) in cells.items() if lines and not any(width.get(k) for k in range(c, c + wide))})
    for cells in grid:
        high = max(len(lines) for lines, _ in cells.values())
        for k in range(high):
            parts, skip = [], -1
            for c in used:
                if c <= skip:
                    continue
                start = c if c in cells else next((s for s in range(c - 1, -1, -1) if s in cells and s + cells[s][1] > c), None)
                lines, wide = cells[start] if start is not None else ([], 1)
                covered = [x for x in used if c <= x < (start if start is not None else c) + wide] or [c]
                skip = covered[-1]
                room = sum(width.get(x, 0) for x in covered) + 3 * (len(covered) - 1)
                parts.append((lines[k] if k < len(lines) else "").ljust(room))
            out.line.append(" | ".join(parts).rstrip(" "))
            out.flush(True)


def page_text(html: str | None) -> str:
    if not html:
        return ""
    out = Out()
    run(render(parse(html.replace("\r\n", "\n").replace("\r", "\n")), out))
    out.flush()
    return "\n".join(out.lines).strip("\n")


def extract(pages: DataFrame, *, html_col: str = "html", out: str = "text") -> DataFrame:
    """The pages' columns other than the HTML, and their text (in place of a column of that name)."""
    rest = [c for c in pages.columns if c not in (html_col, out)]
    schema = pages.select(*rest, F.lit("").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([page_text(x.as_py()) for x in batch.column(html_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), texts], names=[*rest, out])

    return pages.select(*rest, html_col).mapInArrow(run, schema)
