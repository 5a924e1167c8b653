"""Visible text of web pages, laid out as a reader sees it.

A tree builder closes and opens the elements that HTML implies (paragraphs, list items, rows and
cells). The renderer walks the tree, leaves out what is not shown, collapses white space, separates
blocks by their margins, marks and indents list items, and lays table cells out in aligned columns.
Both use stacks of their own, so the depth of a page does not matter, and read a page once.

A null page gives an empty text. Pages are rendered one by one, so repeated rows give repeated
results; only the named columns are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no markup.
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset(
    "head script style template noscript iframe noembed noframes title datalist canvas audio video object meta link".split()
)
# Lines before and after: 2 leaves a blank line, 1 starts a new line.
MARGINS = dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset form".split(), 2) | dict.fromkeys(
    "html body div section article aside header footer nav main address li dt dd tr caption figcaption details summary "
    "legend option optgroup center menu thead tbody tfoot".split(),
    1,
)
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul li dd dt summary".split()
)
# For a start tag: the elements it closes, and those beyond which it does not look.
_LISTS, _TABLE = frozenset(["ul", "ol", "menu"]), frozenset(["table"])
IMPLIED_END = {
    "li": (frozenset(["li"]), _LISTS),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), _TABLE),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), _TABLE),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), _TABLE),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), _TABLE),
    "body": (frozenset(["head"]), frozenset()),
}
HEAD_ONLY = frozenset("head title base link meta style script template noscript html".split())
# An end tag does not reach out of a cell or a table, but for that of the table's own parts.
BARRIERS = frozenset(["table", "td", "th", "caption"])
# The end of these does not close a block that was opened inside.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
TABLE_PARTS = frozenset("table tr td th thead tbody tfoot caption".split())

WIDEST_ALIGNED = 40
# The limits of HTML.
MOST_COLUMNS = 1000
MOST_ROWS = 65_534

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []


def _tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, name or text, attributes); kinds are text, start and end."""
    at, n = 0, len(page)
    closing = {}  # quotes that do not occur any more
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            tag = n
        if tag > at:
            yield "text", html.unescape(page[at:tag]), {}
        if tag >= n:
            return
        at = tag
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        is_end = page.startswith("</", at)
        name = _NAME.match(page, at + 1 + is_end)
        if not name:
            yield "text", "<", {}
            at += 1
            continue
        end = name.end()
        while end < n and page[end] != ">":
            quote = page[end]
            if quote in "\"'" and page[max(name.end(), end - 8) : end].rstrip()[-1:] == "=" and not closing.get(quote):
                close = page.find(quote, end + 1)
                if close < 0:
                    closing[quote] = True
                else:
                    end = close
            end += 1
        source = page[name.end() : end]
        at = end + 1
        tag_name = name[0].lower()
        if is_end:
            yield "end", tag_name, {}
            continue
        attributes = {}
        if source and source != "/":
            for key, double, single, bare in _ATTRIBUTE.findall(source):
                attributes.setdefault(key.lower(), html.unescape(double or single or bare))
        yield "start", tag_name, attributes
        if tag_name in RAW:
            close = re.compile(rf"</{re.escape(tag_name)}(?=[\s/>])", re.I).search(page, at)
            end = close.start() if close else n
            if end > at:
                raw = page[at:end]
                yield "text", html.unescape(raw) if tag_name in ("textarea", "title") else raw, {}
            at = end
            if not close:
                yield "end", tag_name, {}


def tree(page: str) -> Node:
    """The page as a tree below an element `#root`."""
    root = Node("#root", {})
    stack = [root]
    count: dict[str, int] = {}  # open elements by name

    def push(tag: str, attributes: dict[str, str]) -> None:
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        stack.append(node)
        count[tag] = count.get(tag, 0) + 1

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            count[stack.pop().tag] -= 1

    def close(names: frozenset, barrier: frozenset) -> None:
        if not any(count.get(x) for x in names):
            return
        found = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                found = i
            elif stack[i].tag in barrier:
                break
        if found is not None:
            pop_to(found)

    def innermost(names: frozenset) -> str | None:
        if not any(count.get(x) for x in names):
            return None
        return next((x.tag for x in reversed(stack) if x.tag in names), None)

    for kind, value, attributes in _tokens(page):
        if kind == "text":
            if value.strip(" \t\n\r\f") and stack[-1].tag in ("head", "html"):
                close(frozenset(["head"]), frozenset())
            stack[-1].children.append(value)
        elif kind == "start":
            if count.get("head") and value not in HEAD_ONLY:
                close(frozenset(["head"]), frozenset())
            if value in CLOSES_P and count.get("p"):
                close(frozenset(["p"]), BARRIERS)
            if value in ("html", "body") and count.get(value):
                continue
            if value in IMPLIED_END:
                close(*IMPLIED_END[value])
            if value in ("td", "th"):
                if innermost(frozenset(["tr", "table"])) == "table":
                    push("tr", {})
            elif value == "tr" and stack[-1].tag == "table":
                push("tbody", {})
            if value in VOID:
                stack[-1].children.append(Node(value, attributes))
            else:
                push(value, attributes)
        elif value == "br":
            stack[-1].children.append(Node("br", {}))
        elif value == "p" and not count.get("p"):
            stack[-1].children.append(Node("p", {}))
        elif count.get(value):
            own = TABLE_PARTS if value in TABLE_PARTS else frozenset()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == value:
                    pop_to(i)
                    break
                if stack[i].tag in BARRIERS and (stack[i].tag not in own or stack[i].tag == "table"):
                    break
                if value in FORMATTING and stack[i].tag in MARGINS:
                    break
    return root


class _Page:
    """Lines of text with collapsed white space and margins."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # a space is due before the next word
        self.margin = 0
        self.indents: list[str] = []
        self.marker = ""
        self.has_text = False

    def gap(self, margin: int) -> None:
        """Ends the line; the largest margin between two texts counts."""
        self._end_line()
        self.margin = max(self.margin, margin)

    def _end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def _begin_line(self) -> None:
        if self.margin > 1 and self.has_text:
            self.lines.append("")
        self.margin = 0
        self.line.append("".join(self.indents) + self.marker)
        if self.marker:
            self.indents.append(" " * len(self.marker))
            self.marker = ""

    def text(self, text: str, keep: bool) -> None:
        if keep:
            first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self._put(first)
            for line in rest:
                self.newline()
                self._put(line)
            return
        words = _SPACES.split(text)
        if not words[0] and len(words) > 1 and self.line:
            self.space = True
        said = [w for w in words if w]
        if said:
            self._put(" ".join(said))
            self.space = not words[-1]

    def _put(self, text: str) -> None:
        if not text:
            return
        if not self.line:
            self._begin_line()
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(text.replace("\xa0", " "))
        self.has_text = True

    def newline(self) -> None:
        if self.line:
            self._end_line()
        elif self.has_text:
            self.lines.append("")

    def block(self, lines: list[str]) -> None:
        """Lines that are laid out already."""
        self.gap(2)
        for line in lines:
            if line:
                self._put(line)
                self._end_line()
            elif self.has_text:
                self.lines.append("")
        self.gap(2)

    def finished(self) -> list[str]:
        self._end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _span(attributes: dict[str, str], name: str, most: int) -> int:
    value = attributes.get(name, "")
    return min(max(int(value), 1), most) if value.isascii() and value.isdigit() and len(value) < 9 else 1


def _grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (lines, columns, rows) as lines with aligned columns."""
    placed, held = [], {}  # held: columns that a cell above still covers, with the rows left
    for row in rows:
        cells, column = {}, 0
        covered = {c for c, left in held.items() if left > 0}
        held = {c: left - 1 for c, left in held.items() if left > 1}
        for lines, across, down in row:
            while column in covered:
                column += 1
            cells[column] = (lines, across)
            if down > 1:
                held |= {c: down - 1 for c in range(column, column + across)}
            column += across
        placed.append(cells)
    widths: dict[int, int] = {}
    for cells in placed:
        for column, (lines, across) in cells.items():
            if across == 1:
                widths[column] = max(widths.get(column, 0), min(max(map(len, lines), default=0), WIDEST_ALIGNED))
    out = []
    for cells in placed:
        last = max(cells, default=-1)
        for i in range(max((len(lines) for lines, _ in cells.values()), default=0)):
            line, column = [], 0
            while column <= last:
                lines, across = cells.get(column, ([], 1))
                width = sum(widths.get(c, 0) for c in range(column, column + across)) + 3 * (across - 1)
                line.append((lines[i] if i < len(lines) else "").ljust(width))
                column += across
            while line and not line[-1].strip(" "):
                line.pop()
            out.append(" | ".join(line).rstrip(" "))
    return out


def _shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether the element takes part in the layout, and whether its own text is visible."""
    a = node.attributes
    if node.tag in UNSEEN or (a and ("hidden" in a or node.tag == "dialog" and "open" not in a)) or (
        node.tag == "dialog" and not a
    ):
        return False, False
    if "style" in a:
        for rule in a["style"].lower().split(";"):
            key, _, value = rule.partition(":")
            key, value = key.strip(), value.replace("!important", "").strip()
            if key == "display" and value == "none":
                return False, False
            if key == "visibility":
                visible = value == "visible" or visible and value not in ("hidden", "collapse")
    return True, visible


def rendered(page: str) -> str:
    """The visible text of a page."""
    pages = [_Page()]
    tables: list[list] = []  # rows of the open tables
    lists: list[int | None] = []  # number of the next item, None where items have no numbers
    pre = 0
    # Steps still to do: nodes with their visibility, and functions that close an element.
    steps: list = [(child, True) for child in reversed(tree(page).children)]

    def close(node: Node, state) -> None:
        nonlocal pre
        tag, out = node.tag, pages[-1]
        if tag in ("ul", "ol", "menu"):
            lists.pop()
            out.gap(1 if lists else 2)
        elif tag == "li":
            out._end_line()
            out.marker = ""
            del out.indents[state:]
            out.gap(1)
        elif tag in ("td", "th") and state:
            lines = pages.pop().finished()
            tables[-1][-1].append((lines, _span(node.attributes, "colspan", MOST_COLUMNS), _span(node.attributes, "rowspan", MOST_ROWS)))
        elif tag == "table":
            pages[-1].block(_grid(tables.pop()))
        else:
            if tag == "pre":
                pre -= 1
            if tag in MARGINS:
                out.gap(MARGINS[tag])

    while steps:
        step = steps.pop()
        if len(step) == 3:
            close(step[1], step[2])
            continue
        node, visible = step
        if isinstance(node, str):
            if visible:
                pages[-1].text(node, pre > 0)
            continue
        part, visible = _shown(node, visible)
        if not part:
            continue
        tag, out, state = node.tag, pages[-1], None
        if tag == "br":
            out.newline()
            continue
        if tag == "hr":
            out.gap(2)
            continue
        if tag in VOID:
            continue
        if tag in ("ul", "ol", "menu"):
            out.gap(1 if lists else 2)
            start = node.attributes.get("start", "1").strip()
            number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
            lists.append(number if tag == "ol" else None)
        elif tag == "li":
            out.gap(1)
            state = len(out.indents)
            number = lists[-1] if lists else None
            out.marker = "- " if number is None else f"{number}. "
            if number is not None:
                lists[-1] = number + 1
        elif tag == "table":
            out.gap(2)
            tables.append([])
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag in ("td", "th") and tables:
            if not tables[-1]:
                tables[-1].append([])
            pages.append(_Page())
            state = True
        else:
            if tag in MARGINS:
                out.gap(MARGINS[tag])
            if tag == "pre":
                pre += 1
        steps.append((None, node, state))
        steps += [(child, visible) for child in reversed(node.children)]
    return "\n".join(pages[0].finished())


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, text, n_chars, n_lines) of each page."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [rendered(x.as_py()) if x.is_valid else "" for x in batch.column("html")]
            yield pa.record_batch([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    source = df.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    found = source.mapInArrow(run, f"id {id_type}, text string")
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return found.select(
        F.col("id").alias(id_col), "text", F.length("text").cast("bigint").alias("n_chars"), lines.cast("bigint").alias("n_lines")
    )
