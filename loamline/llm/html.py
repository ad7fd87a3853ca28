"""Layout-aware text of HTML pages: a tree builder with implied tags, visibility rules, and a block renderer.

Every visible text of a page is in its output once. Blocks stand on lines of their own, with a blank line around those that
have margins; list items have bullets or numbers and hanging indents; table cells are aligned in columns.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import slices, tidy

#: Fixed values of HTML: kinds of elements and what they close.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE = {"title", "textarea"}
HIDDEN = set("head title script style template noscript noembed noframes iframe object video audio canvas datalist rp area param".split())
IN_HEAD = set("base basefont bgsound link meta title style script noscript template noframes".split())
MARGIN = set("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote figure pre table hr fieldset listing xmp".split())
BLOCK = MARGIN | set(
    "html body div section article aside nav header footer main address center details dialog dd dt li figcaption form hgroup legend summary search option optgroup tr caption".split()
)
CLOSE_P = BLOCK - {"html", "body", "option", "optgroup", "tr", "caption", "legend"}
SCOPE = set("html table td th caption button object template marquee applet".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
SECTIONS = {"thead", "tbody", "tfoot"}
STRUCTURE = {"table", "tr", "colgroup", *SECTIONS}
#: Opening a tag closes these open ones, no further out than the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"} | SCOPE),
    "dt": ({"dt", "dd"}, {"dl"} | SCOPE),
    "dd": ({"dt", "dd"}, {"dl"} | SCOPE),
    "option": ({"option"}, {"select", "datalist", "optgroup"} | SCOPE),
    "optgroup": ({"option", "optgroup"}, {"select"} | SCOPE),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "template"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table", "template"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table", "template"}),
    "caption": ({"caption", "colgroup"}, {"table", "template"}),
    "rt": ({"rt", "rp"}, {"ruby"} | SCOPE),
    "rp": ({"rt", "rp"}, {"ruby"} | SCOPE),
} | {name: ({"tr", "td", "th", "caption", "colgroup", *SECTIONS}, {"table", "template"}) for name in SECTIONS}
DEPTH = 400  #: elements below are siblings of it, as in browsers; no text is lost

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!\s*important\s*)?(?:;|$)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    @property
    def hidden(self) -> bool:
        if self.tag in HIDDEN or "hidden" in self.attrs and self.attrs["hidden"].lower() != "until-found":
            return True
        if self.tag == "input":
            return self.attrs.get("type", "text").lower() not in ("submit", "button", "reset")
        return self.tag == "dialog" and "open" not in self.attrs or bool(NOT_SHOWN.search(self.attrs.get("style", "")))


def parse(source: str) -> Element:
    """The tree of a page. Every text is in it; tags that make no sense are passed over."""
    root = Element("html")
    stack, body = [root], False

    def insert(node) -> None:
        where = stack[-1]
        if where.tag in STRUCTURE:  # text and other content there stands before the table
            k = len(stack) - 1
            while stack[k].tag in STRUCTURE and k:
                k -= 1
            siblings = stack[k].children
            siblings.insert(next((i for i in range(len(siblings) - 1, -1, -1) if siblings[i] is stack[k + 1]), len(siblings)), node)
            return
        where.children.append(node)

    def push(tag: str, attrs: dict[str, str] | None = None, foster: bool = False) -> None:
        node = Element(tag, attrs)
        insert(node) if foster else stack[-1].children.append(node)
        if len(stack) < DEPTH:
            stack.append(node)

    def close(tags: set[str], scope: set[str]) -> None:
        """Pop up to the outermost open element of ``tags`` inside the scope."""
        found = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                found = k
            elif stack[k].tag in scope:
                break
        if found:
            del stack[found:]

    def text(value: str) -> None:
        nonlocal body
        if value:
            blank = not value.strip(" \t\n\r\f")
            if stack[-1].tag == "head" and not blank:
                stack.pop()
                body = True
            if blank:
                stack[-1].children.append(value)
            else:
                insert(value)

    at, end = 0, len(source)
    while at < end:
        found = TOKEN.search(source, at)
        if not found:
            text(unescape(source[at:]))
            break
        if found.start() > at:
            text(unescape(source[at : found.start()]))
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag == "br":
                insert(Element("br"))
            elif tag == "p" and not any(x.tag == "p" for x in stack):
                insert(Element("p"))
            elif tag in HEADINGS:
                close(HEADINGS, SCOPE) if not any(x.tag == tag for x in stack) else close({tag}, SCOPE)
            elif tag in ("table", "tr", "td", "th", "caption") or tag in SECTIONS:
                close({tag}, {"table"} - {tag} | {"template"})
            elif tag not in ("html", "body"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                    if stack[k].tag in SCOPE and tag not in SCOPE:
                        break
            continue
        attrs = {m[1].lower(): unescape(next((x for x in m.groups()[1:] if x is not None), "")) for m in reversed(list(ATTRIBUTE.finditer(found[3])))} if found[3] else {}
        if tag in ("html", "body"):
            if tag == "body" and stack[-1].tag == "head":
                stack.pop()
            body = body or tag == "body"
            if attrs:
                root.attrs = attrs | root.attrs
            continue
        if tag == "head":
            if not body and len(stack) == 1:
                push("head")
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            stack.pop()
            body = True
        if tag == "table" and stack[-1].tag in STRUCTURE:  # a table cannot be there: it ends the one before
            close({"table"}, {"td", "th", "caption"})
        if tag in CLOSE_P:
            close({"p"}, SCOPE)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            stack.pop()
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", *SECTIONS):
            push("tr")
        table_part = tag in ("tr", "td", "th", "caption", "col", "colgroup") or tag in SECTIONS
        if table_part and stack[-1].tag not in ("table", "tr", *SECTIONS, "colgroup") and not any(x.tag == "table" for x in stack):
            continue  # a part of a table outside any table: its content is ordinary
        if tag in VOID:
            insert(Element(tag, attrs)) if not table_part else None
        elif tag in RAW or tag in ESCAPABLE:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            value = source[at : stop.start() if stop else end]
            at = stop.end() if stop else end
            node = Element(tag, attrs)
            node.children.append(unescape(value) if tag in ESCAPABLE else value)
            insert(node)
        else:
            push(tag, attrs, foster=not table_part)
    return root


def width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines under way: inline text gathers in a line, blocks end it, margins join into one blank line."""

    def __init__(self, listed: bool = False):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.gap = False
        self.listed = listed  # inside of an item, where lists have no margin

    def text(self, value: str) -> None:
        value = SPACE.sub(" ", value)
        if value.startswith(" ") and (not self.now or self.space):
            value = value[1:]
        if value:
            self.now.append(value)
            self.space = value.endswith(" ")

    def end_line(self) -> None:
        if self.now:
            line = "".join(self.now).rstrip(" ")
            self.now, self.space = [], False
            if line:
                self.put([line])

    def put(self, lines: list[str]) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        self.lines += lines

    def line_break(self) -> None:
        if self.now:
            self.end_line()
        elif self.lines:
            self.gap = True

    def edge(self, margin: bool) -> None:
        self.end_line()
        self.gap |= margin

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def rendered(step):
    """Result of a renderer. Renderers are generators that yield the renderers of what they hold and get their results, on a
    stack of their own, so that no depth of nesting meets the interpreter's limit."""
    stack, value = [step], None
    while stack:
        try:
            step = stack[-1].send(value)
        except StopIteration as end:
            value = end.value
            stack.pop()
        else:
            stack.append(step)
            value = None
    return value


def lines_of(node: Element, listed: bool = False):
    flow = Flow(listed)
    yield fill(node, flow)
    return flow.done()


def literal(node: Element) -> str:
    """Text of a preformatted element, as it stands."""
    out, rest = [], [iter(node.children)]
    while rest:
        child = next(rest[-1], None)
        if child is None:
            rest.pop()
        elif isinstance(child, str):
            out.append(child)
        elif not child.hidden:
            if child.tag == "br":
                out.append("\n")
            else:
                rest.append(iter(child.children))
    return "".join(out)


def fill(node: Element, flow: Flow):
    closed = node.tag == "details" and "open" not in node.attrs
    for child in node.children:
        if isinstance(child, str):
            if not closed:
                flow.text(child)
            continue
        if child.hidden or closed and child.tag != "summary":
            continue
        tag = child.tag
        if tag == "br":
            flow.line_break()
        elif tag == "hr":
            flow.edge(True)
        elif tag == "input":
            flow.text(child.attrs.get("value", ""))
        elif tag in ("pre", "textarea", "listing"):
            flow.edge(tag != "textarea")
            value = literal(child).replace("\r\n", "\n").replace("\r", "\n")
            lines = [x.rstrip() for x in (value[1:] if value.startswith("\n") else value).split("\n")]
            while lines and not lines[-1]:
                lines.pop()
            if lines:
                flow.put(lines)
            flow.edge(tag != "textarea")
        elif tag == "table":
            flow.edge(True)
            flow.put((yield table_lines(child))) if child.children else None
            flow.edge(True)
        elif tag in ("ul", "ol", "menu", "dir"):
            flow.edge(not flow.listed)
            if lines := (yield list_lines(child)):
                flow.put(lines)
            flow.edge(not flow.listed)
        elif tag in ("blockquote", "dd"):
            flow.edge(tag == "blockquote")
            if lines := (yield lines_of(child)):
                flow.put([("  " + x) if x else x for x in lines])
            flow.edge(tag == "blockquote")
        elif tag == "li":
            flow.edge(False)
            if lines := (yield item_lines(child, "- ")):
                flow.put(lines)
        elif tag == "q":
            flow.text('"')
            yield fill(child, flow)
            flow.text('"')
        elif tag in BLOCK:
            flow.edge(tag in MARGIN)
            yield fill(child, flow)
            flow.edge(tag in MARGIN)
        else:
            yield fill(child, flow)


def item_lines(item: Element, mark: str):
    lines = yield lines_of(item, True)
    return [(mark if not k else " " * len(mark)) + x if x else x for k, x in enumerate(lines)]


def number(value: str | None, default: int, most: int = 10**6) -> int:
    found = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return min(int(found[1]), most) if found else default


def list_lines(node: Element):
    """Items in order; content outside of items stands as a block between them."""
    out, ordered = [], node.tag == "ol"
    items = [x for x in node.children if not isinstance(x, str) and x.tag == "li" and not x.hidden]
    down = ordered and "reversed" in node.attrs
    count = number(node.attrs.get("start"), len(items) if down else 1)
    loose = Element("div")

    def flush():
        nonlocal loose
        if loose.children:
            lines = yield lines_of(loose)
            out.extend("  " + x if x else x for x in lines)
            loose = Element("div")

    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            loose.children.append(child)
        elif not child.hidden:
            yield flush()
            count = number(child.attrs.get("value"), count) if ordered else count
            out += yield item_lines(child, f"{count}. " if ordered else "- ")
            count += -1 if down else 1
    yield flush()
    return out


def table_lines(table: Element):
    """Caption, then rows: columns are as wide as their widest cell, two spaces apart; cells of several lines stay in their column."""
    rows: list[Element] = []
    caption: list[str] = []
    by = {"thead": [], "tfoot": [], "": []}
    for part in table.children:
        if isinstance(part, str) or part.hidden:
            continue
        if part.tag == "caption":
            caption += yield lines_of(part)
        elif part.tag == "tr":
            by[""].append(part)
        elif part.tag in SECTIONS:
            by[part.tag if part.tag in by else ""] += [x for x in part.children if not isinstance(x, str) and x.tag == "tr" and not x.hidden]
    rows = [*by["thead"], *by[""], *by["tfoot"]]
    held: list[tuple[int, int, int]] = []  # columns from first to before past that a cell above takes, up to before a row
    grid: list[list[tuple[int, int, list[str]]]] = []
    for r, row in enumerate(rows):
        at, cells, new = 0, [], []
        held = [h for h in held if h[2] > r]
        place = 0
        for cell in row.children:
            if isinstance(cell, str) or cell.tag not in ("td", "th") or cell.hidden:
                continue
            while place < len(held) and held[place][0] <= at:
                at = max(at, held[place][1])
                place += 1
            span = max(1, number(cell.attrs.get("colspan"), 1, 1000))
            deep = max(1, number(cell.attrs.get("rowspan"), 1, 65534))
            cells.append((at, span, (yield lines_of(cell))))
            if deep > 1:
                new.append((at, at + span, min(r + deep, len(rows))))
            at += span
        if new:
            both, held = sorted(held + new), []
            for h in both:  # what touches and ends with the same row is one
                if held and held[-1][2] == h[2] and h[0] <= held[-1][1]:
                    held[-1] = (held[-1][0], max(held[-1][1], h[1]), h[2])
                else:
                    held.append(h)
        grid.append(cells)
    # only columns that a cell begins in, or a spanning one ends with, can have a width
    columns = sorted({at for cells in grid for at, _, _ in cells} | {at + span - 1 for cells in grid for at, span, _ in cells})
    wide: dict[int, int] = dict.fromkeys(columns, 0)
    for cells in grid:
        for at, span, lines in cells:
            if span == 1:
                wide[at] = max(wide[at], max(map(width, lines), default=0))
    for cells in grid:
        for at, span, lines in cells:
            need = max(map(width, lines), default=0) - 2 * (span - 1)
            if span > 1 and need > 0:  # the last column that it spans takes what the others leave
                own = columns[bisect_left(columns, at) : bisect_left(columns, at + span)]
                wide[at + span - 1] += max(0, need - sum(wide[k] for k in own))
    start, sofar = {}, 0
    for k in columns:
        start[k] = sofar
        sofar += wide[k] + (2 if wide[k] else 0)
    out = list(caption)
    for cells in grid:
        for n in range(max((len(lines) for _, _, lines in cells), default=0)):
            line, used = "", 0
            for at, _, lines in cells:
                if n < len(lines) and lines[n]:
                    line += " " * (start[at] - used) + lines[n]
                    used = start[at] + width(lines[n])
            out.append(line.rstrip())
    return out


def extract_text(source: str) -> str:
    """Visible text of a page; no blank lines at the edges or more than one in a row outside of preformatted text."""
    lines = rendered(lines_of(parse(source.replace("\x00", ""))))
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines).replace("\xa0", " ")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row of ``pages`` (page_id, url, html).

    Null html gives null text, an empty page empty text; null ids and urls stay null; repeated rows are rendered each;
    an empty table gives no rows; other columns are ignored. Malformed pages never fail: unclosed comments, tags and raw
    text end with the page."""

    def run(batches):
        for batch in batches:
            for some in slices(batch, "html"):
                texts = [None if x is None else extract_text(x) for x in some.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(tidy(run), "page_id long, url string, text string")
