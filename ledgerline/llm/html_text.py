"""Layout-aware text of HTML pages: a tree builder with implied tags, visibility rules and a renderer."""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_SPACES = re.compile(r"[ \t\n\r\f]+")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)

# Fixed values of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
UNSEEN = {"head", "script", "style", "title", "template", "iframe", "noembed", "noframes", "object", "svg", "canvas", "audio", "video", "datalist", "rp", "param"}
HEAD_ONLY = {"base", "link", "meta", "title", "style", "script", "noscript", "template", "head", "html"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup",
    "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "xmp",
}
#: Blocks with a blank line around them.
SPACED = {"blockquote", "dl", "fieldset", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "menu", "ol", "p", "pre", "table", "ul", "xmp"}
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend"}
#: A start tag ends the open elements named, up to the border elements.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
#: End tags do not reach beyond these.
BORDERS = {"table", "td", "th", "caption", "html"}
#: Open elements at most; what lies deeper joins the deepest, as in browsers.
DEPTH = 256
#: Characters to which a column's cells are wrapped if another column follows.
COLUMN = 60


class Node:
    """``hidden``: with all it holds; ``seen``: what its visibility style says of its text, None if nothing."""

    __slots__ = ("tag", "children", "hidden", "attrs", "seen")

    def __init__(self, tag: str, attrs: str = "", hidden: bool = False, seen: bool | None = None):
        self.tag, self.children, self.hidden, self.attrs, self.seen = tag, [], hidden, attrs, seen


def attribute(attrs: str, name: str) -> str | None:
    m = re.search(rf"""(?:^|[\s"'/]){name}(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/]|$))""", attrs, re.I)
    return next((x for x in m.groups() if x is not None), "") if m else None


def _is_hidden(tag: str, attrs: str) -> bool:
    if tag in UNSEEN:
        return True
    if not attrs:
        return tag == "dialog"
    low = attrs.lower()
    if "hidden" in low and ((h := attribute(attrs, "hidden")) is not None and h.lower() != "until-found"):
        return True
    if "style" in low and (s := attribute(attrs, "style")) is not None and _NO_DISPLAY.search(s):
        return True
    return tag == "dialog" and attribute(attrs, "open") is None


def _seen(attrs: str) -> bool | None:
    if "isibility" not in attrs and "ISIBILITY" not in attrs:
        return None
    found = _VISIBILITY.findall(attribute(attrs, "style") or "")
    return found[-1].lower() == "visible" if found else None


def build(page: str) -> Node:
    """The element tree of a page; end tags are implied where HTML lets them be left out."""
    root = Node("html")
    stack = [root]
    at, n, last = 0, len(page), page.rfind(">")

    def close_until(names, borders) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = stack[k].tag
            if tag in names:
                del stack[k:]
                return
            if tag in borders:
                return

    def text(s: str) -> None:
        if not s:
            return
        top = stack[-1]
        if top.tag == "head":
            if s.isspace():
                return
            stack.pop()
            top = stack[-1]
        top.children.append(entities.unescape(s) if "&" in s else s)

    while at < n:
        m = _TAG.search(page, at, last + 1) if at <= last else None
        if not m:  # no tag ends any more; a comment may still begin
            text(page[at:].partition("<!--")[0])
            break
        text(page[at : m.start()])
        at = m.end()
        if at > last and page.startswith("<!--", m.start()) and not page.endswith("-->", m.start() + 4, at):
            break  # a comment that never ends
        end, name, attrs = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        if not name:
            continue
        tag = name.lower()
        if end:
            if tag in ("html", "body"):
                continue
            if tag == "br":
                stack[-1].children.append(Node("br"))
                continue
            borders = {"table"} if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else {"html"} if tag == "table" else BORDERS if tag in BLOCK else BLOCK
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                close_until({"h1", "h2", "h3", "h4", "h5", "h6"}, borders)
            else:
                close_until({tag}, borders)
            continue
        if tag in ("html", "body"):
            if stack[-1].tag == "head":
                stack.pop()
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            stack.pop()
        if tag in IMPLIED:
            close_until(*IMPLIED[tag])
        elif tag in ("tbody", "thead", "tfoot"):  # ends all that is open in the table
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "table"), len(stack))
            del stack[k + 1 :]
        if tag in CLOSES_P:
            close_until({"p"}, BORDERS | {"button"})
        node = Node(tag, attrs, _is_hidden(tag, attrs), _seen(attrs) if attrs else None)
        stack[-1].children.append(node)
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            raw = page[at : close.start() if close else n]
            if not node.hidden:
                node.children.append(entities.unescape(raw) if tag == "textarea" else raw)
            at = close.end() if close else n
            continue
        if len(stack) < DEPTH:
            stack.append(node)
    return root


class Writer:
    """Collects inline text into lines and keeps block spacing."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space, self.blank, self.bol = False, False, True

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self.put(first)
            for x in rest:
                self.newline()
                self.put(x)
            return
        words = _SPACES.split(s)
        if words[0] == "" and len(words) > 1:
            self.space = True
        body = " ".join(w for w in words if w)
        if body:
            self.put((" " if self.space and not self.bol else "") + body)
            self.space = words[-1] == ""

    def put(self, s: str) -> None:
        if s:
            self.line.append(s)
            self.bol = self.space = False

    def newline(self) -> None:
        """A line break that stands even if the line is empty."""
        self.lines.append("".join(self.line).rstrip())
        self.line, self.bol, self.space = [], True, False

    def block(self, spaced: bool) -> None:
        """A block's border: ends the line; one blank line at most comes between spaced blocks."""
        if self.line:
            self.newline()
        self.space = False
        if spaced and self.lines and self.lines[-1] != "":
            self.lines.append("")

    def result(self) -> list[str]:
        self.block(False)
        out = self.lines
        while out and not out[-1]:
            out.pop()
        k = 0
        while k < len(out) and not out[k]:
            k += 1
        return out[k:]


def _flow(node: Node, out: Writer, pre: bool, seen: bool = True) -> None:
    for c in node.children:
        if isinstance(c, str):
            if seen:
                out.text(c, pre)
            continue
        if c.hidden:
            continue
        shown = seen if c.seen is None else c.seen
        if c.tag == "br":
            out.newline()
        elif c.tag == "hr":
            out.block(True)
        elif c.tag == "table":
            out.block(True)
            _indented(out, _table(c, shown), "")
            out.block(True)
        elif c.tag in ("ul", "ol", "menu", "dir"):
            out.block(True)
            _list(c, out, shown)
            out.block(True)
        elif c.tag == "details" and attribute(c.attrs, "open") is None:
            out.block(False)
            for x in c.children:
                if isinstance(x, Node) and x.tag == "summary":
                    _flow(x, out, pre, shown if x.seen is None else x.seen)
                    break
            out.block(False)
        elif c.tag in ("pre", "xmp"):
            out.block(True)
            if c.children and isinstance(c.children[0], str):
                c.children[0] = c.children[0].removeprefix("\r").removeprefix("\n")
            _flow(c, out, True, shown)
            out.block(True)
        elif c.tag in BLOCK:
            spaced = c.tag in SPACED
            out.block(spaced)
            if c.tag in ("blockquote", "dd"):
                inner = Writer()
                _flow(c, inner, pre, shown)
                _indented(out, inner.result(), "    ")
            else:
                _flow(c, out, pre, shown)
            out.block(spaced)
        else:
            _flow(c, out, pre, shown)


def _lines(node: Node, seen: bool) -> list[str]:
    out = Writer()
    _flow(node, out, False, seen)
    return out.result()


def _indented(out: Writer, lines: list[str], by: str, first: str | None = None) -> None:
    out.block(False)
    for k, x in enumerate(lines):
        out.lines.append(((first if k == 0 and first is not None else by) + x).rstrip())


def _list(node: Node, out: Writer, seen: bool) -> None:
    start = attribute(node.attrs, "start") if node.attrs else None
    number = int(start) if start and re.fullmatch(r"-?\d{1,9}", start) else 1
    loose = Node("div")
    for c in [*node.children, None]:
        if isinstance(c, Node) and c.tag == "li" or c is None:
            if loose.children:
                _indented(out, _lines(loose, seen), "")
                loose = Node("div")
            if c is None or c.hidden:
                continue
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            lines = [x for x in _lines(c, seen if c.seen is None else c.seen) if x]
            if lines:
                _indented(out, lines, " " * len(mark), mark)
        else:
            loose.children.append(c)


def _rows(node: Node, seen: bool):
    """The rows of a table's sections with whether their text is seen, and the number of rows left in the section, each itself included."""
    for part in [node, *(x for x in node.children if isinstance(x, Node) and x.tag in ("tbody", "thead", "tfoot") and not x.hidden)]:
        shown = seen if part is node or part.seen is None else part.seen
        own = [c for c in part.children if isinstance(c, Node) and not c.hidden and (c.tag == "tr" or part is node and c.tag in ("tbody", "thead", "tfoot"))]
        if part is node and any(c.tag != "tr" for c in own):  # sections come in their place, below
            own = [c for c in own if c.tag == "tr"]
        for k, r in enumerate(own):
            yield r, shown if r.seen is None else r.seen, len(own) - k


def _span(cell: Node, name: str, most: int, none: int) -> int:
    found = attribute(cell.attrs, name) if cell.attrs else None
    return 1 if not found or not re.fullmatch(r"\d{1,9}", found) else min(int(found), most) or none


def _wrapped(lines: list[str]) -> list[str]:
    """Lines cut at spaces to ``COLUMN`` characters where they can be; a longer word stays whole."""
    out = []
    for x in lines:
        while len(x) > COLUMN:
            lead = len(x) - len(x.lstrip(" "))
            cut = x.rfind(" ", lead, COLUMN + 1)
            cut = cut if cut > lead else x.find(" ", COLUMN)
            if cut < 0:
                break
            out.append(x[:cut])
            x = x[cut + 1 :]
        out.append(x)
    return out


def _table(node: Node, seen: bool) -> list[str]:
    """Lines of a table: what stands outside cells, then its rows, each cell below the others of its column.

    A cell takes its columns and rows by colspan (up to 1,000, as the standard
    has it) and rowspan (up to the end of its section); its text stands in the
    first. Cells that another column follows are wrapped to ``COLUMN``
    characters; a longer word pushes what follows it in its line to the right.
    """
    stray, grid, taken = Node("div"), [], {}
    for part in [node, *(x for x in node.children if isinstance(x, Node) and x.tag in ("tbody", "thead", "tfoot") and not x.hidden)]:
        stray.children += [x for x in part.children if isinstance(x, str) and not x.isspace() or isinstance(x, Node) and x.tag not in ("tr", "tbody", "thead", "tfoot", "colgroup", "col")]
    for r, shown, left in _rows(node, seen):
        row: list = []
        free = {k: n for k, n in taken.items() if n}  # columns that cells from above reach into
        taken = {k: n - 1 for k, n in free.items()}
        for c in r.children:
            if isinstance(c, Node) and c.tag in ("td", "th"):
                if c.hidden:
                    continue
                while len(row) in free:
                    row.append([])
                wide, high = _span(c, "colspan", 1000, 1), min(_span(c, "rowspan", 65534, left), left)
                for k in range(len(row), len(row) + wide):
                    taken[k] = max(taken.get(k, 0), high - 1)
                row.append(_lines(c, shown if c.seen is None else c.seen))
                row += [[]] * (wide - 1)
            elif isinstance(c, Node) or not c.isspace():
                stray.children.append(c)
        if left == 1:
            taken = {}
        while row and not row[-1]:
            row.pop()
        grid.append([_wrapped(cell) for cell in row[:-1]] + row[-1:])
    out = _lines(stray, seen)
    width: list[int] = []
    for row in grid:
        for k, cell in enumerate(row):
            w = min(max(map(len, cell), default=0), COLUMN)
            if k == len(width):
                width.append(w)
            elif w > width[k]:
                width[k] = w
    for row in grid:
        for i in range(max(map(len, row), default=0)):
            line = "  ".join((cell[i] if i < len(cell) else "").ljust(width[k]) for k, cell in enumerate(row)).rstrip()
            if line:
                out.append(line)
    return out


def render(page: str) -> str:
    """All visible text of a page, as laid out without scripts.

    Hidden: head, scripts, styles, templates, embedded documents, closed
    dialogs and details, elements with ``hidden`` or ``display:none``, and text
    under ``visibility:hidden`` but not under ``visibility:visible`` within.
    Paragraphs and other spaced blocks stand between blank lines, other blocks
    on lines of their own; list items get marks, table cells are aligned (see
    ``_table``). Elements nested deeper than ``DEPTH`` join the deepest; their
    text is kept. A tag that never ends is text. Time is in proportion to the
    page's length.
    """
    out = Writer()
    _flow(build(page), out, False)
    return "\n".join(out.result()).replace("\xa0", " ").replace("\x00", "�")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col`` and ``text`` of each page. Null and empty html give empty text; each row keeps its own; other columns are not read. A narrow pass, page by page."""
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        import sys

        import pyarrow as pa

        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEPTH))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([render(x) if x else "" for x in b.column(1).to_pylist()], pa.string())], names=schema.names)

    return pages.select(F.col(id_col), F.col(html_col)).mapInArrow(run, schema)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
