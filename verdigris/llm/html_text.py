"""All visible text of HTML pages, laid out: blocks apart, list items marked and indented, table cells aligned.

A scan yields tags and text; a tree builder closes elements that end tags leave out; the renderer follows what is open.
Nothing recurses, and open elements are counted by name, so depth is no matter, and each page is read once. Style sheets in
the page hide and show by simple selectors, as they would on a screen.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style head title template noscript iframe object audio video canvas svg math datalist noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup html li legend main menu nav ol option p pre section summary table caption ul optgroup select".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table pre blockquote figure".split())
LISTS = frozenset("ul ol menu".split())
INDENTED = LISTS | {"blockquote", "dd"}
CELLS = frozenset("td th caption".split())
#: Elements out of which only the end tags of the second set reach.
SCOPES = CELLS | {"table"}
OUTWARD = frozenset("tr table thead tbody tfoot body html".split())
ENDS_P = BLOCK - frozenset("body html option optgroup select legend".split()) | {"hr"}
#: A start tag ends these open elements, up to the nearest of the second set.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset({"dl"})),
    "dd": (frozenset("dt dd".split()), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset("select datalist".split())),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tr": (frozenset("td th tr caption colgroup".split()), frozenset({"table"})),
    "thead": (frozenset("td th tr thead tbody tfoot caption colgroup".split()), frozenset({"table"})),
    "tbody": (frozenset("td th tr thead tbody tfoot caption colgroup".split()), frozenset({"table"})),
    "tfoot": (frozenset("td th tr thead tbody tfoot caption colgroup".split()), frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset()),
}
#: A cell wider than this is shown whole but doesn't widen its column.
WIDEST = 60

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_DECLARATION = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?")
_SIMPLE = re.compile(r"(?:[a-z][\w-]*|\*)?(?:[.#][\w-]+)*")
_PART = re.compile(r"[.#]?[\w-]+|\*")
_COMMENT_END = re.compile(r"--!?>")
_SPACES = re.compile(r"[ \t\n\r\f]+")


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): text, start with its attributes' source, or end. Comments and declarations are skipped; a tag that
    isn't closed by > is text, and so is a < that begins none."""
    at, n = 0, len(page)
    unclosed = False
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        following = page[lt + 1 : lt + 2]
        if following in ("!", "?"):
            empty = next((e for e in ("<!-->", "<!--->") if page.startswith(e, lt)), None)
            if empty:
                at = lt + len(empty)
            elif page.startswith("<!--", lt):
                closing = _COMMENT_END.search(page, lt + 4)
                at = closing.end() if closing else n
            else:
                at = page.find(">", lt + 2) + 1 or n
            continue
        tag = None if unclosed else _TAG.match(page, lt)
        if tag is None and (following.isalpha() or following == "/"):
            # Quotes that don't pair: the tag ends at the next >. Once there is none, none is looked for again.
            unclosed = unclosed or page.find(">", lt) < 0
            tag = None if unclosed else _LOOSE.match(page, lt)
        if tag is None:
            yield "text", "", "<"
            at = lt + 1
            continue
        at, name = tag.end(), tag[2].lower()
        yield ("end" if tag[1] else "start"), name, tag[3]
        if not tag[1] and name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            end = close.start() if close else n
            yield "raw", name, page[at:end]
            at = end


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


@dataclass
class Canvas:
    """Lines of text under construction, with white space collapsed and the widest gap between blocks kept."""

    lines: list[str] = field(default_factory=list)
    line: list[str] = field(default_factory=list)
    gap: int = 0
    space: bool = False
    indent: int = 0
    mark: str = ""

    def write(self, text: str) -> None:
        words = _SPACES.sub(" ", text)
        if not words:
            return
        if words[0] == " ":
            self.space, words = True, words[1:]
        if not words:
            return
        trailing = words[-1] == " "
        self._begin()
        self.line.append((" " if self.space and self.line[-1] not in ("", self.mark) else "") + (words[:-1] if trailing else words))
        self.space = trailing

    def _begin(self) -> None:
        if not self.line:
            if self.lines and self.gap > 1:
                self.lines.append("")
            self.gap, self.space = 0, False
            pad = "  " * self.indent
            self.line = [pad[: max(0, len(pad) - len(self.mark))] + self.mark] if self.mark else [pad]
            self.mark = ""
            self.line.append("")

    def stop(self, gap: int = 1) -> None:
        """End the line; the next text is at least ``gap`` lines below."""
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.gap, self.space = max(self.gap, gap), False

    def keep(self, text: str) -> None:
        """Preformatted text."""
        for i, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self._begin()
                self.stop(0)
            if part:
                self._begin()
                self.line.append(part)

    def block(self, lines: list[str], gap: int) -> None:
        self.stop(gap)
        for text in lines:
            self._begin()
            self.line.append(text)
            self.stop(1)
        self.stop(gap)

    def text(self) -> list[str]:
        self.stop()
        return self.lines


@dataclass
class Cell:
    lines: list[str]
    columns: int
    rows: int


@dataclass
class Table:
    outer: Canvas
    rows: list[list[Cell]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def _placed(self) -> list[list[tuple[int, int, list[str]]]]:
        """(first column, column after the last, lines) of each row's cells; columns that a cell of a row above still takes are
        passed over."""
        out, taken = [], {}
        for row in self.rows:
            column, placed, below = 0, [], {c: n - 1 for c, n in taken.items() if n > 1}
            for cell in row:
                while column in taken:
                    column += 1
                placed.append((column, column + cell.columns, cell.lines))
                if cell.rows > 1:
                    below.update(dict.fromkeys(range(column, column + cell.columns), cell.rows - 1))
                column += cell.columns
            out.append(placed)
            taken = below
        return out

    def lines(self) -> list[str]:
        """Columns begin where cells begin; a cell over several of them takes their room and widens none."""
        placed = self._placed()
        edges = sorted({first for row in placed for first, _, _ in row})
        widths = [0] * len(edges)
        for row in placed:
            for first, after, cell in row:
                i = bisect_left(edges, first)
                if bisect_left(edges, after) == i + 1:
                    widths[i] = max([widths[i], *(len(x) for x in cell if len(x) <= WIDEST)])
        offsets = list(accumulate((w + 2 for w in widths), initial=0))
        out = list(self.notes)
        for row in placed:
            for k in range(max((len(cell) for _, _, cell in row), default=0)):
                line = ""
                for n, (first, _, cell) in enumerate(row):
                    at = offsets[bisect_left(edges, first)]
                    line = (line.ljust(at) if len(line) + 2 <= at or not n else line + "  ") + (cell[k] if k < len(cell) else "")
                out.append(line.rstrip())
        return out


@dataclass
class Open:
    """An open element; what it doesn't have itself it has from the element above it."""

    name: str
    hidden: bool
    invisible: bool
    canvas: Canvas
    table: Table | None
    pre: bool
    listed: "Open | None"  # the innermost list, itself included
    in_item: bool
    count: int | None = None  # of an ordered list: the next number
    spans: tuple[int, int] = (1, 1)  # of a cell: columns and rows


@dataclass
class Sheet:
    """Rules on display and visibility, by one part of their selectors, which are a tag, classes and an id of one element.
    Selectors with combinators, pseudo-classes or attributes are left out."""

    rules: dict[str, list[tuple[frozenset[str], tuple, str, str]]] = field(default_factory=dict)
    count: int = 0

    def add(self, css: str) -> None:
        css, shown, at = _COMMENT.sub(" ", css).lower(), [True], 0
        for brace in re.finditer(r"[{};]", css):
            head, at = css[at : brace.start()], brace.end()
            if brace[0] == "{":
                head = head.strip()
                if head.startswith("@"):  # a block of rules for some media, or one that has no rules
                    media = re.match(r"@media\s+(.*)", head, re.S)
                    fits = head.startswith("@supports") or (media is not None and any(not re.match(r"\s*(only\s+)?(print|speech)\b|\s*not\s+(all|screen)\b", m) for m in media[1].split(",")))
                    shown.append(shown[-1] and fits)
                    self._head = None
                else:
                    shown.append(shown[-1])
                    self._head = head if shown[-1] else None
                    self._body: list[str] = []
            elif brace[0] == ";":
                if getattr(self, "_head", None):
                    self._body.append(head)
            else:
                if getattr(self, "_head", None):
                    self._rule(self._head, [*self._body, head])
                self._head = None
                if len(shown) > 1:
                    shown.pop()

    def _rule(self, selectors: str, body: list[str]) -> None:
        stated = [m for d in body if (m := _DECLARATION.fullmatch(d.strip()))]
        for selector in (x.strip() for x in selectors.split(",")) if stated else ():
            if not selector or not _SIMPLE.fullmatch(selector):
                continue
            parts = frozenset(_PART.findall(selector))
            weight = sum(p[0] == "#" for p in parts), sum(p[0] == "." for p in parts), sum(p[0] not in "#.*" for p in parts)
            self.count += 1
            for m in stated:
                self.rules.setdefault(max(parts), []).append((parts, (bool(m[3]), *weight, self.count), m[1], m[2]))

    def value(self, own: set[str], name: str) -> tuple[tuple, str] | None:
        """The strongest rule's weight and value for an element of these parts."""
        fitting = [(weight, value) for part in own for parts, weight, what, value in self.rules.get(part, ()) if what == name and parts <= own]
        return max(fitting, default=None)


def _styled(sheet: Sheet, own: set[str], style: str, name: str) -> str | None:
    """The value of a property after the cascade; the style attribute wins over all rules that aren't important."""
    inline = None
    for m in (m for d in style.split(";") if (m := _DECLARATION.fullmatch(d.strip()))):
        if m[1] == name and (m[3] or inline is None or not inline[0]):
            inline = bool(m[3]), m[2]
    ruled = sheet.value(own, name) if sheet.rules else None
    if inline is not None and (ruled is None or inline[0] or not ruled[0][0]):
        return inline[1]
    return ruled[1] if ruled is not None else None


def _span(given: str | None, most: int) -> int:
    return min(most, max(1, int(given))) if given and re.fullmatch(r"\d{1,9}", given.strip()) else 1


def render(page: str | None) -> str:
    """The visible text of one page; null and empty pages give an empty text."""
    stack: list[Open] = []
    root = Canvas()
    sheet = Sheet()
    scopes: list[Counter[str]] = [Counter()]  # open elements by name, in the page and in each open table and cell
    total: Counter[str] = Counter()

    def canvas() -> Canvas:
        return stack[-1].canvas if stack else root

    def close(at: int) -> None:
        while len(stack) > at:
            o = stack.pop()
            if o.name in SCOPES:
                scopes.pop()
            scopes[-1][o.name] -= 1
            total[o.name] -= 1
            above = stack[-1] if stack else None
            c = canvas()
            if o.name in CELLS:
                if above is not None and above.table is not None and not o.hidden:
                    if o.name == "caption":
                        above.table.notes += o.canvas.text()
                    else:
                        if not above.table.rows:
                            above.table.rows.append([])
                        above.table.rows[-1].append(Cell(o.canvas.text(), *o.spans))
            elif o.name == "table":
                if not o.hidden and o.table is not None:
                    c.block(o.table.lines(), 2)
            elif o.name in BLOCK:
                c.stop(gap(o.name, above is not None and above.in_item))
                if o.name in INDENTED:
                    c.indent -= 1
                if o.name == "li":
                    c.mark = ""

    def gap(name: str, in_item: bool) -> int:
        return 2 if name in SPACED and not (in_item and name in LISTS) else 1

    def find(names: frozenset[str], until: frozenset[str]) -> int | None:
        found = None
        if not any(total[n] for n in names):
            return None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in until:
                break
            if stack[i].name in names:
                found = i
        return found

    limits = frozenset("table td th caption button".split())
    for kind, name, rest in scan(page or ""):
        if kind == "text":
            if stack and (stack[-1].hidden or stack[-1].invisible):
                continue
            if stack and stack[-1].name in ("table", "tr", "thead", "tbody", "tfoot") and not rest.strip():
                continue
            text = html.unescape(rest) if "&" in rest else rest
            c = canvas()
            if stack and stack[-1].pre:
                c.keep(text)
            else:
                c.write(text)
        elif kind == "raw":
            if name == "style":
                sheet.add(rest)
            elif name == "textarea" and not stack[-1].hidden:
                canvas().keep(html.unescape(rest))
        elif kind == "end":
            if name == "br":
                canvas().stop(1)
                continue
            if not (total if name in OUTWARD else scopes[-1])[name] and not (stack and stack[-1].name == name):
                continue
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name or (stack[i].name in SCOPES and name not in OUTWARD)), None)
            if at is not None and stack[at].name == name:
                close(at)
        else:
            if name in ENDS_P:
                at = find(frozenset({"p"}), limits)
                if at is not None:
                    close(at)
            if name in IMPLIED:
                at = find(*IMPLIED[name])
                if at is not None:
                    close(at)
            above = stack[-1] if stack else None
            given = attributes(rest) if rest.strip(" /\n\t") else {}
            style = given.get("style", "").lower()
            own = {name, "*", "#" + given.get("id", "").lower(), *("." + x.lower() for x in given.get("class", "").split())} if sheet.rules else set()
            display = _styled(sheet, own, style, "display") if style or own else None
            hidden = name in UNSEEN or bool(above and above.hidden) or (display == "none" if display else "hidden" in given)
            visibility = _styled(sheet, own, style, "visibility") if style or own else None
            invisible = visibility in ("hidden", "collapse") if visibility and visibility != "inherit" else bool(above and above.invisible)
            c = canvas()
            if name in VOID:
                if not hidden and name == "br":
                    if not c.line:
                        c.gap = max(c.gap, 2)
                    c.stop(1)
                elif not hidden and name == "hr":
                    c.stop(2)
                continue
            table = above.table if above else None
            if name in CELLS and table is None:  # a browser ignores the tag and shows the text
                continue
            new = Open(name, hidden, invisible, c, table, name == "pre" or bool(above and above.pre), above.listed if above else None, name == "li" or bool(above and above.in_item))
            if name == "table":
                new.table = Table(c)
                c.stop(2)
            elif name in CELLS:
                new.canvas = Canvas()
                new.spans = _span(given.get("colspan"), 1000), _span(given.get("rowspan"), 65534)
                new.in_item = False
                new.listed = None
            elif name == "tr":
                if table is not None and not hidden:
                    table.rows.append([])
            elif name in BLOCK and not hidden:
                c.stop(gap(name, bool(above and above.in_item)))
            if name in INDENTED:
                c.indent += 1
            if name in LISTS:
                new.listed = new
                if name == "ol":
                    start = given.get("start", "1")
                    new.count = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
            if name == "li" and not hidden:
                c.mark = "- "
                if new.listed is not None and new.listed.count is not None:
                    c.mark, new.listed.count = f"{new.listed.count}. ", new.listed.count + 1
            stack.append(new)
            scopes[-1][name] += 1
            total[name] += 1
            if name in SCOPES:
                scopes.append(Counter())
    close(0)
    return "\n".join(root.text()).strip("\n")


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Add ``text_col``, the laid-out visible text of every page; a column of that name is replaced, all others stay.

    A null page has a null text, an empty one an empty text. Malformed pages give what a browser would about show: end tags
    that are missing are implied, ones that match nothing are ignored, and an unclosed tag is text.
    """
    kept = pages.drop(text_col)
    names = kept.columns
    at = names.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                text = [None if p is None else render(p) for p in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], [*names, text_col])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(text_col, StringType())]))
