"""Layout-aware text of HTML pages.

A tolerant tree builder closes tags as HTML implies (p before blocks, li, dt/dd,
option, rows and cells, rows made for cells without one, the head before what can't be in it), takes script, style
and other raw text as such, and never fails. A renderer walks the tree with a stack of
its own, so that depth is no limit, and writes what a reader would see:

* not the head, scripts, styles, templates, frames, ``hidden`` elements, ``display:none``,
  closed details or dialogs, nor ``visibility:hidden`` unless a child is visible again;
* blocks on lines of their own, with the larger of two adjoining margins between them;
* list items with bullets or numbers and hanging indents;
* table cells aligned in columns, with colspan and rowspan. A column is as wide as its widest line that keeps the
  table's area within ``PADDING`` times its text, so that padding never outgrows the text; a wider line
  runs on, and the cells to its right follow it after two blanks on that line alone;
* the texts of buttons and fields, of graphics (``svg``), and what an ``object`` has in its place;
* white space collapsed, but kept in pre and textarea.

Not visible, as pages are taken to run with scripts and media: noscript, and what canvas, audio, video and frames
have in their place. Null and empty pages give an empty text, an empty table no rows. Very long pages are rendered
whole. Each row is rendered on its own, so ties and repeated rows need no rule; columns other than page_id and html aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import pieces, strings

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
NEVER = frozenset("head script style template noscript iframe noembed noframes canvas audio video datalist title map rp defs symbol desc metadata".split())
#: Fields that show no text.
TEXTLESS = frozenset("hidden password checkbox radio file image color range".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary svg table text ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "li", "dd", "dt", "legend", "option", "optgroup", "svg", "text"}
#: All that a head can hold; any other start tag or text ends it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
MARGIN = dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre figure table hr fieldset".split(), 1)
LISTS = frozenset("ul ol menu dir".split())
SECTIONS = frozenset("thead tbody tfoot".split())
#: start tag: (tags that it closes, tags beyond which it closes nothing)
IMPLIED = {
    "li": ({"li"}, LISTS | {"table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "thead": ({"tr", "td", "th", "caption", *SECTIONS}, {"table"}),
    "tbody": ({"tr", "td", "th", "caption", *SECTIONS}, {"table"}),
    "tfoot": ({"tr", "td", "th", "caption", *SECTIONS}, {"table"}),
}
#: A table's area by its text without blanks.
PADDING = 16
#: The largest spans that HTML allows; a rowspan of 0 goes on to the table's end.
MOST = {"colspan": 1000, "rowspan": 65534}

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
SPACE = re.compile(r"[ \t\n\r\f]+")
HIDDEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None) -> None:
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        value = m[2] or ""
        if value[:1] in "\"'":
            value = value[1:-1]
        out.setdefault(m[1].lower(), unescape(value))
    return out


class Builder:
    """The open elements, and how tags change them."""

    def __init__(self) -> None:
        self.root = Node("#root")
        self.stack, self.open = [self.root], Counter()

    def pop(self) -> None:
        self.open[self.stack.pop().tag] -= 1

    def close(self, tags: set[str] | frozenset[str], beyond: set[str] | frozenset[str]) -> None:
        """Close the outermost open element of ``tags`` above the nearest of ``beyond``."""
        if not any(self.open[t] for t in tags):
            return
        at = None
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in beyond:
                break
            if self.stack[i].tag in tags:
                at = i
        if at is not None:
            while len(self.stack) > at:
                self.pop()

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "head" and (self.open["head"] or self.open["body"]):
            return
        if tag not in HEAD:
            self.end_head()
        if tag in CLOSES_P and self.open["p"]:
            self.close({"p"}, {"table", "td", "th", "button"})
        if tag in IMPLIED:
            self.close(*IMPLIED[tag])
            if tag in ("td", "th") and self.stack[-1].tag in {"table", *SECTIONS}:
                self.push(Node("tr"))
        node = Node(tag, attrs)
        if tag in VOID:
            self.stack[-1].children.append(node)
        else:
            self.push(node)

    def end_head(self) -> None:
        if self.stack[-1].tag == "head":
            self.pop()

    def push(self, node: Node) -> None:
        self.stack[-1].children.append(node)
        self.stack.append(node)
        self.open[node.tag] += 1

    def end(self, tag: str) -> None:
        if not self.open[tag]:
            return
        beyond = {"table"} if tag in ("td", "th", "tr", "li", "p") else {"td", "th"} if tag not in {"table", "body", "html", *SECTIONS} else set()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i].tag in beyond:
                return

    def text(self, data: str) -> None:
        if data.strip(" \t\n\r\f"):
            self.end_head()
        self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    """The tree of a page; every input gives one."""
    build, at, n, lowered = Builder(), 0, len(html), html.lower()
    if len(lowered) != n:  # a few letters change their number of code points
        lowered = "".join(c.lower() if c < "\x80" else c for c in html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            build.text(unescape(html[at:]))
            break
        if lt > at:
            build.text(unescape(html[at:lt]))
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif html[lt + 1 : lt + 2] in ("!", "?"):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
        elif m := TAG.match(html, lt):
            at, tag = m.end(), m[2].lower()
            if m[1]:
                if tag == "br":
                    build.start("br", {})
                else:
                    build.end(tag)
                continue
            build.start(tag, attributes(m[3]))
            if tag in RAW:
                end = lowered.find(f"</{tag}", at)
                end = n if end < 0 else end
                build.text(unescape(html[at:end]) if tag in ("textarea", "title") else html[at:end])
                build.end(tag)
                end = html.find(">", end)
                at = n if end < 0 else end + 1
        elif html[lt + 1 : lt + 2].isalpha() or html[lt + 1 : lt + 2] == "/":
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
        else:
            build.text("<")
            at = lt + 1
    return build.root


class Canvas:
    """Lines of text with margins, indents and bullets."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.margin = 0
        self.indents: list[str] = []
        self.bullet: str | None = None
        self.space = True  # the line ends with white space, or is empty

    def write(self, data: str, keep: bool = False) -> None:
        if keep:
            first, *rest = data.split("\n")
            self._add(first)
            for x in rest:
                self.newline()
                self._add(x)
            return
        data = SPACE.sub(" ", data)
        if self.space and data[:1] == " ":
            data = data[1:]
        self._add(data)

    def _add(self, data: str) -> None:
        if data:
            self.line.append(data)
            self.space = data[-1] == " "

    def newline(self) -> None:
        """End the line, even if it is empty."""
        self._put("".join(self.line).replace("\xa0", " ").rstrip())
        self.line, self.space = [], True

    def _put(self, text: str) -> None:
        if self.lines:
            self.lines += [""] * self.margin
        self.margin = 0
        indent = "".join(self.indents)
        if self.bullet is not None and text:
            indent = "".join(self.indents[:-1]) + self.bullet
            self.bullet = None
        self.lines.append((indent + text).rstrip() if text else "")

    def block(self, margin: int) -> None:
        """A block's border: end a line that has text, and keep the larger margin."""
        if "".join(self.line).strip():
            self.newline()
        self.line, self.space = [], True
        self.margin = max(self.margin, margin)

    def put_lines(self, lines: list[str]) -> None:
        for x in lines:
            self._put(x)

    def done(self) -> list[str]:
        self.block(0)
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        return lines


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.captions: list[str] = []

    def layout(self) -> list[str]:
        """Aligned lines."""
        rows = [row for row in self.rows if row]
        grid: list[list[tuple[int, list[str], int]]] = []  # (column, lines, colspan)
        taken: dict[int, int] = {}
        for row in rows:
            at, placed = 0, []
            for lines, across, down in row:
                while taken.get(at, 0):
                    at += 1
                placed.append((at, lines, across))
                for c in range(at, at + across):
                    taken[c] = down
                at += across
            grid.append(placed)
            taken = {c: left - 1 for c, left in taken.items() if left > 1}
        widths = self.widths(grid)
        used = sorted(c for c, w in widths.items() if w)
        start, starts = 0, {}
        for c in used:
            starts[c] = start
            start += widths[c] + 2
        out = []
        for placed in grid:
            for i in range(max((len(lines) for _, lines, _ in placed), default=0)):
                line = ""
                for at, lines, across in placed:
                    if i < len(lines) and lines[i]:
                        column = next((starts[c] for c in range(at, at + across) if c in starts), 0)
                        line = line.ljust(max(column, len(line) + 2 if line else 0)) + lines[i]
                out.append(line.rstrip())
        return self.captions + out

    @staticmethod
    def widths(grid: list[list[tuple[int, list[str], int]]]) -> dict[int, int]:
        """Width by column: of its widest line that isn't too wide for the table's area; a cell across several columns widens the last of them."""
        sizes: dict[int, set[int]] = {}
        lines_of, text = sum(max((len(lines) for _, lines, _ in placed), default=0) for placed in grid), 0
        for placed in grid:
            for at, lines, across in placed:
                text += sum(len(x) - x.count(" ") for x in lines)
                if across == 1:
                    sizes.setdefault(at, set()).update(map(len, lines))
        most = PADDING * text // max(1, lines_of * len(sizes))
        widths = {c: max((w for w in own if w <= most), default=0) or int(any(own)) for c, own in sizes.items()}
        for placed in grid:
            for at, lines, across in placed:
                if across > 1:
                    room = sum(widths.setdefault(c, 0) for c in range(at, at + across)) + 2 * (across - 1)
                    wide = max((len(x) for x in lines if len(x) <= most), default=0)
                    widths[at + across - 1] += max(0, wide - room)
        return widths


def shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """(whether the element is rendered at all, whether its own text is visible)."""
    attrs = node.attributes
    if node.tag in NEVER or "hidden" in attrs or (node.tag == "dialog" and "open" not in attrs):
        return False, False
    style = attrs.get("style", "")
    if style:
        if HIDDEN.search(style):
            return False, False
        if m := VISIBILITY.search(style):
            visible = m[1].lower() == "visible"
    return True, visible


def field_text(attrs: dict[str, str]) -> str:
    """What an input shows: its value or else its placeholder; submit and reset have texts of their own."""
    kind = attrs.get("type", "text").strip().lower()
    if kind in TEXTLESS:
        return ""
    return attrs.get("value") or ({"submit": "Submit", "reset": "Reset", "button": ""}[kind] if kind in ("submit", "reset", "button") else attrs.get("placeholder", ""))


def number(text: str | None, default: int) -> int:
    return int(text) if text and text.strip().lstrip("-").isascii() and text.strip().lstrip("-").isdigit() and len(text) < 10 else default


def render(root: Node) -> str:
    canvas = Canvas()
    canvases: list[Canvas] = []
    tables: list[Table] = []
    lists: list[list] = []  # [ordered, next number]
    #: (node or text, visible, keep white space) to enter; (closing function,) to leave
    waiting: list[tuple] = [(root, True, False)]
    while waiting:
        item = waiting.pop()
        if len(item) == 1:
            item[0]()
            continue
        node, visible, keep = item
        if isinstance(node, str):
            if visible:
                canvas.write(node, keep)
            continue
        tag = node.tag
        if tag != "#root":
            there, visible = shown(node, visible)
            if not there:
                continue
        children = node.children
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        if tag == "br":
            canvas.newline()
            continue
        if tag == "input":
            if visible and (said := field_text(node.attributes)):
                canvas.write(f" {said} ")
            continue
        if tag == "hr":
            canvas.block(1)
            canvas.put_lines(["---"] if visible else [])
            canvas.block(1)
            continue
        leave = None
        if tag == "table":
            canvas.block(1)
            tables.append(Table())
            parent = canvas

            def leave(parent=parent):
                parent.block(0)
                parent.put_lines(tables.pop().layout())
                parent.block(1)

        elif tag == "tr" and tables:
            tables[-1].rows.append([])
        elif tag in ("td", "th", "caption") and tables:
            if tag != "caption" and not tables[-1].rows:
                tables[-1].rows.append([])
            canvases.append(canvas)
            canvas = Canvas()
            across, down = (max(1, min(MOST[x], number(node.attributes.get(x), 1) or (MOST[x] if x == "rowspan" else 1))) for x in MOST)

            def leave(tag=tag, across=across, down=down, kept=lists):
                nonlocal canvas, lists
                lines = canvas.done()
                if tag == "caption":
                    tables[-1].captions += lines
                else:
                    tables[-1].rows[-1].append((lines, across, down))
                canvas, lists = canvases.pop(), kept

            lists = []
        elif tag in LISTS:
            outer = not lists
            canvas.block(int(outer))
            lists.append([tag == "ol", number(node.attributes.get("start"), 1)])

            def leave(outer=outer):
                lists.pop()
                canvas.block(int(outer))

        elif tag == "li":
            canvas.block(0)
            if lists and lists[-1][0]:
                at = number(node.attributes.get("value"), lists[-1][1])
                mark, lists[-1][1] = f"{at}. ", at + 1
            else:
                mark = "- "
            canvas.indents.append(" " * len(mark))
            canvas.bullet = mark

            def leave():
                canvas.block(0)
                canvas.indents.pop()
                canvas.bullet = None

        elif tag in ("blockquote", "dd"):
            canvas.block(MARGIN.get(tag, 0))
            canvas.indents.append("  ")

            def leave(tag=tag):
                canvas.block(MARGIN.get(tag, 0))
                canvas.indents.pop()

        elif tag in BLOCKS:
            margin = MARGIN.get(tag, 0)
            canvas.block(margin)
            if tag == "optgroup" and visible and (said := node.attributes.get("label")):
                canvas.write(said)
                canvas.block(0)

            def leave(margin=margin):
                canvas.block(margin)

        if leave:
            waiting.append((leave,))
        inner = keep or tag in ("pre", "textarea")
        if tag == "pre" and children and isinstance(children[0], str) and children[0].startswith("\n"):
            children = [children[0][1:], *children[1:]]
        in_table = tag in ("table", "tr", *SECTIONS) and tables
        for child in reversed(children):
            if in_table and isinstance(child, str) and not child.strip():
                continue
            waiting.append((child, visible, inner))
    return "\n".join(canvas.done())


def extract(html: str) -> str:
    """All visible text of a page."""
    return render(parse(html))


def pages_text(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines: a row for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = [extract(x) for x in strings(batch.column(1))]
            counts = ([len(x) for x in out], [x.count("\n") + 1 if x else 0 for x in out])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), *(pa.array(x, pa.int64()) for x in counts)], ["page_id", "text", "n_chars", "n_lines"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, text string, n_chars long, n_lines long")
