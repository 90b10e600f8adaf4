"""Operator 1, HTML extraction: layout-aware rendering of all visible text.

A tokenizer and a tree builder (void elements, raw-text elements, implied start and end tags) make a
tree; visibility rules drop what a browser would not show; a renderer keeps block spacing, list
markers and indentation, preformatted text, and pads table cells to columns.  All steps are linear in
the page's length; nesting beyond MAX_DEPTH is flattened (no text is lost).
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import pieces

MAX_DEPTH = 200
COLUMN_WIDTH = 40  # cells are padded up to this width; longer ones are whole, only not aligned

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes datalist audio video canvas meta link base area param source track".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr menu dir".split())
BLOCKS = CLOSES_P | SPACED | frozenset("html body caption tr thead tbody tfoot td th legend optgroup option select".split())
CLOSERS = BLOCKS | frozenset("template noscript object svg math foreignobject".split())  # the last ones are no blocks, but their end closes the blocks in them
SCOPE = frozenset("html table td th caption button object template".split())
HEAD = frozenset("title meta link base basefont bgsound style script noscript noframes template head html body".split())
DRAWN = frozenset("svg a g switch text foreignobject".split())  # elements of a drawing that show what is in them
CELLS, SECTIONS = ("td", "th"), ("thead", "tbody", "tfoot")

_TAG = re.compile(
    r"""<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*(?:>|\Z)|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|"""
    r"""(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(?:>|\Z))""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s]*)))?""")
_SPACE = re.compile(r"[ \t\r\n\f]+")
_NONE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "raw", "children")

    def __init__(self, tag: str, raw: str = ""):
        self.tag, self.raw, self.children = tag, raw, []

    def attributes(self) -> dict[str, str]:
        if not self.raw.strip(" /\t\r\n\f"):
            return {}
        out: dict[str, str] = {}
        for name, *values in _ATTRIBUTE.findall(self.raw):
            out.setdefault(name.lower(), unescape(next((v for v in values if v), "")))
        return out


def parse(html: str) -> Node:
    """Tree of a page."""
    root = Node("html")
    stack, too_deep = [root], {}
    at, n = 0, len(html)

    def close(tags, until) -> None:
        """Close the innermost open element of ``tags``, not looking beyond ``until``."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in until:
                return

    def opened(tag: str, raw: str = "") -> None:
        node = Node(tag, raw)
        stack[-1].children.append(node)
        if len(stack) < MAX_DEPTH:
            stack.append(node)
        else:
            too_deep[tag] = too_deep.get(tag, 0) + 1

    def said(text: str) -> None:
        if stack[-1].tag == "head" and text.strip(" \t\r\n\f"):
            stack.pop()
        stack[-1].children.append(text)

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            said(unescape(html[at:]))
            break
        if m.start() > at:
            said(unescape(html[at : m.start()]))
        at = m.end()
        if m["start"]:
            tag = m["start"].lower()
            if tag in ("html", "body"):
                close(("head",), ())
                if m["attrs"].strip() and not root.raw and tag == "body":
                    root.raw = m["attrs"]
                continue
            if tag == "head" and (len(stack) > 1 or any(c.strip(" \t\r\n\f") if isinstance(c, str) else True for c in root.children)):
                continue  # a head comes first and once
            if stack[-1].tag == "head" and tag not in HEAD:
                stack.pop()
            if tag in CLOSES_P:
                close(("p",), SCOPE)
            if tag == "li":
                close(("li",), ("ul", "ol", "menu", "dir", *SCOPE))
            elif tag in ("dd", "dt"):
                close(("dd", "dt"), ("dl", *SCOPE))
            elif tag in ("option", "optgroup"):
                close(("option",), ("select", *SCOPE))
            elif tag in CELLS:
                close(CELLS, ("tr", "table"))
                if stack[-1].tag in ("table", *SECTIONS):
                    opened("tr")
            elif tag == "tr":
                close(("tr",), ("table",))
            elif tag in SECTIONS or tag == "caption":
                close((*SECTIONS, "caption"), ("table",))
                if stack[-1].tag == "tr":
                    stack.pop()
            if tag in VOID:
                stack[-1].children.append(Node(tag, m["attrs"]))
            elif tag in RAW:
                node = Node(tag, m["attrs"])
                stack[-1].children.append(node)
                over = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
                body = html[at : over.start() if over else n]
                node.children.append(unescape(body) if tag in ("textarea", "title") else body)
                at = over.end() if over else n
            else:
                opened(tag, m["attrs"])
        elif m["end"]:
            tag = m["end"].lower()
            if too_deep.get(tag):
                too_deep[tag] -= 1
                continue
            if tag == "br":
                stack[-1].children.append(Node("br"))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag == "template":
                    continue
                if stack[k].tag in BLOCKS and tag not in CLOSERS or stack[k].tag in ("table", *CELLS) and tag not in ("table", "tr", *SECTIONS):
                    break  # an inline end tag does not close blocks, nor anything a table's cell
    return root


def _shown(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    if not node.raw:
        return node.tag != "dialog"
    a = node.attributes()
    if "hidden" in a and a["hidden"].lower() != "until-found" or "style" in a and _NONE.search(a["style"]):
        return False
    return not (node.tag == "dialog" and "open" not in a or node.tag == "input" and a.get("type", "").lower() == "hidden")


class _Page:
    """Lines of output; blocks ask for line breaks, inline text for single spaces."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.blank = False
        self.indent = ""
        self.marker = ""

    def text(self, s: str) -> None:
        if not s:
            return
        words = _SPACE.sub(" ", s)
        if words == " ":
            self.space = True
            return
        if self.line and (self.space or words[0] == " "):
            self.line.append(" ")
        self.line.append(words.strip(" "))
        self.space = words[-1] == " "

    def flush(self) -> None:
        if self.line:
            if self.blank and self.lines:
                self.lines.append("")
            lead = self.indent[: len(self.indent) - len(self.marker)] + self.marker
            self.lines.append(lead + "".join(self.line))
            self.line, self.marker, self.blank = [], "", False
        self.space = False

    def block(self, spaced: bool) -> None:
        self.flush()
        self.blank = self.blank or spaced

    def raw(self, line: str) -> None:
        self.flush()
        self.line = [line]
        self.flush()


def _table(node: Node, page: _Page) -> None:
    rows, stack = [], [(c, False) for c in reversed(node.children)]
    while stack:
        child, in_section = stack.pop()
        if isinstance(child, str):
            if child.strip():
                rows.append([_flat(child)])
        elif not _shown(child):
            continue
        elif child.tag in SECTIONS:
            stack += [(c, True) for c in reversed(child.children)]
        elif child.tag == "tr":
            rows.append([_flat(c) for c in child.children if (c.strip() if isinstance(c, str) else _shown(c))])
        else:
            rows.append([_flat(child)])
    widths: list[int] = []
    for row in rows:
        for k, cell in enumerate(row):
            if k == len(widths):
                widths.append(0)
            widths[k] = max(widths[k], min(len(cell), COLUMN_WIDTH))
    for row in rows:
        line = "  ".join(cell.ljust(w) for cell, w in zip(row, widths, strict=False)).rstrip()
        if line:
            page.raw(line)


def _flat(node) -> str:
    """A cell's text on one line."""
    page = _Page()
    page.text(node) if isinstance(node, str) else _children(node, page, 0)
    page.flush()
    return " ".join(x.strip() for x in page.lines if x)


def _children(node: Node, page: _Page, pre: int) -> None:
    details = node.tag == "details" and "open" not in node.attributes()
    number = 1
    if node.tag == "ol":
        start = node.attributes().get("start", "1")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, str):
            if details and child.strip():
                continue
            if pre:
                first, *rest = child.split("\n")
                page.line.append(first)
                for line in rest:
                    page.line = ["".join(page.line).rstrip()]
                    if page.line[0]:
                        page.flush()
                    else:
                        page.line, page.blank = [], bool(page.lines)
                    page.line = [line] if line else []
            else:
                page.text(child)
            continue
        if details and child.tag != "summary" or not _shown(child):
            continue
        tag = child.tag
        if tag == "br":
            if page.line:
                page.flush()
            else:
                page.blank = bool(page.lines)
        elif tag == "hr":
            page.block(True)
            page.raw("-" * 8)
            page.blank = True
        elif tag == "li":
            page.block(False)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            outer = page.indent
            page.indent, page.marker = outer + " " * len(mark), mark
            _children(child, page, pre)
            page.flush()
            page.indent, page.marker = outer, ""
        elif tag == "table":
            page.block(True)
            _table(child, page)
            page.block(True)
        elif tag in ("blockquote", "dd"):
            page.block(tag in SPACED)
            outer = page.indent
            page.indent = outer + "  "
            _children(child, page, pre)
            page.block(tag in SPACED)
            page.indent = outer
        elif tag in BLOCKS:
            nested = tag in ("ul", "ol", "menu", "dir") and page.indent
            page.block(tag in SPACED and not nested)
            _children(child, page, pre or tag == "pre")
            page.block(tag in SPACED and not nested)
        elif tag == "input":
            value = child.attributes().get("value", "")
            page.text(f" {value} ")
        elif tag == "svg":
            _drawing(child, page, pre)
        elif tag == "annotation" or tag == "annotation-xml":
            continue  # of a formula: another notation for programs
        else:
            _children(child, page, pre)


def _drawing(node: Node, page: _Page, pre: int) -> None:
    """The labels of a drawing: what its text and foreignObject elements hold, each apart from the others."""
    for child in node.children:
        if isinstance(child, str) or not _shown(child) or child.tag not in DRAWN:
            continue
        if child.tag in ("text", "foreignobject"):
            page.space = True
            _children(child, page, pre)
            page.space = True
        else:
            _drawing(child, page, pre)


def visible_text(html: str | None) -> str:
    """All text a reader would see; null and empty pages give ''."""
    if not html:
        return ""
    root = parse(html)
    if not _shown(root):
        return ""
    page = _Page()
    _children(root, page, 0)
    page.flush()
    return "\n".join(page.lines)


def rendered(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of every row: null and empty pages have an empty text, null ids stay null,
    repeated rows are rendered each; other columns are ignored."""
    base = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{html_col}`").alias("html"))

    def run(batches):
        for batch in pieces(batches, "html"):
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([visible_text(h) for h in batch.column("html").to_pylist()], pa.string())], ["page_id", "text"])

    return base.mapInArrow(run, f"page_id {dict(base.dtypes)['page_id']}, text string")
