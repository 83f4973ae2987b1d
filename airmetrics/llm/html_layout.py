"""Visible text of HTML pages, laid out as a browser would stack it.

A tolerant tree builder supplies the tags that authors may leave out (``</li>``, ``</p>``,
``</td>``, ``<tr>`` and so on). Visibility rules drop what a browser does not show: heads, scripts
and other tags that are never drawn, ``hidden`` attributes, inline styles, and simple selectors of
the page's own style sheets. Of drawings the ``text`` elements are shown, where they stand or are
used, and of formulas all but annotations; a ``dialog`` is shown when open. The renderer keeps blocks apart (blank lines around paragraphs,
headings, lists and tables), marks and indents list items, keeps preformatted text, and pads table
cells so that columns are aligned.

Defined results: a null page has null text, an empty page or one without visible text an empty
text. Unclosed tags, stray end tags and broken markup never fail; a ``<`` that opens no tag is
text. An element that a drawing uses several times is drawn once. Tags nested deeper than 200 are drawn flat at that depth, with all their text. Long pages
are read whole. Repeated rows are rendered alike; other columns pass through.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 200

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "head title meta link base script style template noscript iframe object embed audio video canvas map "
    "datalist noembed noframes param source track area rp".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
BLOCK = SPACED | frozenset(
    "html body div section article nav header footer main aside address form li dt dd tr td th thead tbody tfoot "
    "caption figcaption details summary center legend option optgroup hgroup search menu dialog".split()
)
#: A start tag ends open elements of these kinds, unless one of the second set lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
ENDS_PARAGRAPH = BLOCK - {"td", "th", "tr", "option", "optgroup", "html", "body", "thead", "tbody", "tfoot", "caption"}
BOUNDARY = frozenset({"table", "td", "th", "caption", "button", "object"})
HEAD_ONLY = frozenset("title meta link base script style template noscript head".split())

FOREIGN = frozenset({"svg", "math"})
#: Inside these, foreign content holds HTML again.
HTML_AGAIN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: HTML tags that end foreign content which was left open.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta "
    "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
FOREIGN_UNSEEN = {
    "svg": frozenset("title desc metadata defs symbol clippath mask pattern marker script style template".split()),
    "math": frozenset("annotation annotation-xml mphantom script style template".split()),
}
#: Parts of a formula that are drawn apart.
APART = frozenset("mfrac mtable mtr mlabeledtr mtd mspace".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SIMPLE = re.compile(r"([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?", re.I)
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes = tag, attributes or {}
        self.children: list[Node | str] = []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


class Tree:
    """Builds the tree of one page; ``hidden`` collects selectors of its style sheets."""

    def __init__(self, page: str):
        self.root = Node("html")
        self.open = [self.root]
        self.hidden: set[tuple[str, str, str]] = set()
        self.by_id: dict[str, Node] = {}
        self._build(page)

    def foreign(self) -> int:
        """The place among the open elements of the drawing or formula one is in, else 0."""
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in FOREIGN:
                return at
            if self.open[at].tag in HTML_AGAIN:
                break
        return 0

    def _close(self, kinds: set[str] | frozenset[str], between: set[str] | frozenset[str]) -> None:
        """Close the outermost open element of these kinds above the nearest boundary."""
        cut = None
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at].tag
            if tag in between:
                break
            if tag in kinds:
                cut = at
        if cut is not None:
            del self.open[cut:]

    def _start(self, tag: str, attributes: dict[str, str], closed: bool) -> None:
        if at := self.foreign():
            if tag not in BREAKS_OUT:
                self._put(Node(tag, attributes), closed)
                return
            del self.open[at:]
        if tag in ("html", "body"):
            self._close({"head"}, set())
            known = self.root if tag == "html" else next((n for n in self.open if n.tag == "body"), None)
            if known is not None:
                known.attributes = attributes | known.attributes
                return
        elif tag not in HEAD_ONLY:
            self._close({"head"}, set())
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, BOUNDARY)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push(Node("tr"))
        self._put(Node(tag, attributes), tag in VOID or closed and tag not in BLOCK)

    def _put(self, node: Node, closed: bool) -> None:
        if "id" in node.attributes:
            self.by_id.setdefault(node.attributes["id"], node)
        if closed:
            self.open[-1].children.append(node)
        else:
            self._push(node)

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        if len(self.open) < MAX_DEPTH:
            self.open.append(node)

    def _end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br"))
            return
        walls = set() if tag in BOUNDARY or tag in ("tr", "thead", "tbody", "tfoot", "html", "body") else BOUNDARY
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return
            if self.open[at].tag in walls or tag in ("td", "th", "tr") and self.open[at].tag == "table":
                return

    def _style(self, sheet: str) -> None:
        for selectors, body in _RULE.findall(_COMMENT.sub("", sheet)):
            if _HIDES.search(body):
                for selector in selectors.split(","):
                    if (m := _SIMPLE.fullmatch(selector.strip())) and m[0]:
                        self.hidden.add(((m[1] or "").lower(), m[2] or "", m[3] or ""))

    def _build(self, page: str) -> None:
        at = 0
        while at < len(page):
            m = _TOKEN.match(page, at)
            at = m.end()
            tag = m[2]
            if tag is None:
                text = m[0]
                if text.startswith("<![CDATA["):
                    text = text[9:].removesuffix("]]>")
                elif text.startswith(("<!", "<?")):
                    continue
                elif "&" in text:
                    text = html.unescape(text)
                if self.open[-1].tag == "head" and text.strip():
                    self._close({"head"}, set())
                self.open[-1].children.append(text)
                continue
            tag = tag.lower()
            if m[1]:
                self._end(tag)
                continue
            rest = m[3]
            empty = rest.endswith("/") and self.foreign()
            self._start(tag, _attributes(rest) if "=" in rest or rest.strip("/ \n") else {}, rest.endswith("/"))
            if tag in RAW and not empty:
                end = re.compile(rf"</{tag}\s*>|\Z", re.I).search(page, at)
                body, at = page[at : end.start()], end.end()
                if tag == "style":
                    self._style(body)
                self.open[-1].children.append(html.unescape(body) if tag in ("textarea", "title") else body)
                self._end(tag)

    def visible(self, node: Node) -> bool:
        if node.tag in UNSEEN or node.tag == "dialog" and "open" not in node.attributes:
            return False
        return self.styled(node)

    def styled(self, node: Node) -> bool:
        """Whether neither an attribute nor a style sheet hides the node."""
        own = node.attributes
        if own and ("hidden" in own or _HIDES.search(own.get("style", "")) or own.get("type", "").lower() == "hidden"):
            return False
        if self.hidden:
            names = {("", "")} | {(".", c) for c in own.get("class", "").split()} | {("#", own.get("id"))}
            return not any((tag, *name) in self.hidden for tag in ("", node.tag) for name in names)
        return True


class Renderer:
    """Lines of a node; an empty line stands for the space around a block."""

    def __init__(self, tree: Tree):
        self.tree = tree

    def lines(self, node: Node) -> list[str]:
        out: list[str] = []
        flow: list[str] = []

        def flush() -> None:
            for line in "".join(flow).split("\n"):
                if text := _BLANKS.sub(" ", line).strip():
                    out.append(text)
                elif out and out[-1] and len(flow) > 1:
                    out.append("")
            flow.clear()

        def walk(parent: Node) -> None:
            for child in parent.children:
                if isinstance(child, str):
                    flow.append(_BLANKS.sub(" ", child))
                elif not self.tree.visible(child):
                    continue
                elif child.tag == "br":
                    flow.append("\n")
                elif child.tag in FOREIGN:
                    apart = "\n" if child.attributes.get("display", "").lower() == "block" else ""
                    flow.append(apart + self.foreign(child) + apart)
                elif child.tag in BLOCK:
                    if any(not piece.isspace() for piece in flow):
                        flush()
                    flow.clear()
                    self._add(out, self.block(child), child.tag in SPACED)
                elif child.tag == "input" and child.attributes.get("type", "").lower() in ("submit", "button", "reset"):
                    flow.append(child.attributes.get("value", ""))
                else:
                    walk(child)

        walk(node)
        if any(not piece.isspace() for piece in flow):
            flush()
        return out

    def foreign(self, node: Node) -> str:
        """The text of a drawing or formula, in one line but for HTML inside it."""
        return self._drawing(node, False, False, 0, set()) if node.tag == "svg" else self._formula(node)

    def _drawing(self, node: Node, inside: bool, used: bool, depth: int, drawn: set[str]) -> str:
        """``inside`` a text element; ``drawn`` are the names of used elements, each drawn once."""
        pieces = []
        for child in node.children:
            if isinstance(child, str):
                pieces.append(child if inside else "")
                continue
            own = child.attributes
            gone = own.get("display", "") == "none" or own.get("visibility", "") in ("hidden", "collapse")
            if child.tag in FOREIGN_UNSEEN["svg"] or gone or not self.tree.styled(child):
                continue
            if child.tag == "foreignobject" and not used:
                pieces.append("\n" + "\n".join(self.lines(child)) + "\n")
            elif child.tag == "use":
                name = (own.get("href") or own.get("xlink:href", "")).removeprefix("#")
                if name in self.tree.by_id and name not in drawn and depth < 60:
                    drawn.add(name)
                    target, holder = self.tree.by_id[name], Node("g")
                    holder.children = target.children if target.tag == "symbol" else [target]
                    pieces.append(self._drawing(holder, False, True, depth + 1, drawn))
            elif child.tag in ("text", "foreignobject"):
                pieces.append(" " + self._drawing(child, True, used, depth + 1, drawn) + " ")
            else:
                pieces.append(self._drawing(child, inside, used, depth + 1, drawn))
        return "".join(pieces)

    def _formula(self, node: Node) -> str:
        pieces = []
        for child in node.children:
            if isinstance(child, str):
                # White space between elements is not drawn.
                pieces.append("" if child.isspace() else _BLANKS.sub(" ", child))
            elif child.tag == "svg":
                pieces.append(self.foreign(child))
            elif child.tag not in FOREIGN_UNSEEN["math"] and self.tree.styled(child):
                text = self._formula(child)
                pieces.append(f" {text} " if child.tag in APART or node.tag == "mfrac" else text)
        return "".join(pieces)

    def inner(self, node: Node) -> list[str]:
        """The lines without the space above and below them."""
        lines = self.lines(node)
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines

    @staticmethod
    def _add(out: list[str], lines: list[str], spaced: bool) -> None:
        if not lines:
            return
        if spaced and (not out or out[-1]):
            out.append("")
        out += lines
        if spaced:
            out.append("")

    def block(self, node: Node) -> list[str]:
        if node.tag in FOREIGN:
            return [text for line in self.foreign(node).split("\n") if (text := _BLANKS.sub(" ", line).strip())]
        if node.tag in ("ul", "ol", "menu"):
            return self.items(node)
        if node.tag == "table":
            return self.table(node)
        if node.tag == "pre":
            return self.preformatted(node)
        if node.tag == "dd":
            return ["    " + line if line else "" for line in self.inner(node)]
        if node.tag == "blockquote":
            return ["> " + line if line else ">" for line in self.inner(node)]
        if node.tag == "details" and "open" not in node.attributes:
            head = next((c for c in node.children if isinstance(c, Node) and c.tag == "summary"), None)
            return self.lines(head) if head is not None and self.tree.visible(head) else []
        return self.lines(node)

    def items(self, node: Node) -> list[str]:
        start = node.attributes.get("start", "1")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        out: list[str] = []
        for child in node.children:
            if isinstance(child, str):
                if text := _BLANKS.sub(" ", child).strip():
                    out.append(text)
                continue
            if not self.tree.visible(child):
                continue
            lines = self.inner(child) if child.tag == "li" else self.block(child)
            if child.tag == "li":
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += 1
                out += [(mark if k == 0 else " " * len(mark)) + line if line else "" for k, line in enumerate(lines)]
            else:
                out += ["  " + line if line else "" for line in lines]
        return out

    def preformatted(self, node: Node) -> list[str]:
        def text(parent: Node) -> str:
            pieces = []
            for child in parent.children:
                if isinstance(child, str):
                    pieces.append(child)
                elif child.tag in FOREIGN and self.tree.visible(child):
                    pieces.append(self.foreign(child))
                elif self.tree.visible(child):
                    pieces.append("\n" if child.tag == "br" else text(child))
            return "".join(pieces)

        lines = [line.rstrip() for line in text(node).removeprefix("\n").split("\n")]
        while lines and not lines[-1]:
            lines.pop()
        return lines

    def table(self, node: Node) -> list[str]:
        rows: list[Node] = []
        out: list[str] = []

        def gather(parent: Node) -> None:
            for child in parent.children:
                if isinstance(child, str):
                    if text := _BLANKS.sub(" ", child).strip():
                        out.append(text)
                elif not self.tree.visible(child):
                    continue
                elif child.tag == "tr":
                    rows.append(child)
                elif child.tag in ("thead", "tbody", "tfoot"):
                    gather(child)
                elif child.tag not in ("col", "colgroup"):
                    out.extend(self.block(child))

        gather(node)
        taken: dict[int, int] = {}
        grid: list[list[tuple[int, int, list[str]]]] = []
        for row in rows:
            at, line, below = 0, [], {}
            for cell in row.children:
                if isinstance(cell, str):
                    if not (text := _BLANKS.sub(" ", cell).strip()):
                        continue
                    lines, wide, tall = [text], 1, 1
                elif not self.tree.visible(cell):
                    continue
                else:
                    lines = self.inner(cell)
                    wide, tall = (self._span(cell, name) for name in ("colspan", "rowspan"))
                while taken.get(at, 0) > 0:
                    at += 1
                line.append((at, wide, lines))
                below |= {column: tall for column in range(at, at + wide) if tall > 1}
                at += wide
            taken = {c: n - 1 for c, n in taken.items() if n > 1} | {c: n - 1 for c, n in below.items()}
            grid.append(line)
        width: dict[int, int] = {}
        for line in grid:
            for at, wide, lines in line:
                longest = max(map(len, lines), default=0)
                width[at] = max(width.get(at, 0), longest if wide == 1 else 0)
        left, total = {}, 0
        for column in range(max(width, default=-1) + 1):
            left[column] = total
            total += width.get(column, 0) + 2 if width.get(column, 0) else 0
        for line in grid:
            for k in range(max((len(lines) for _, _, lines in line), default=0)):
                text = ""
                for at, _, lines in line:
                    if k < len(lines) and lines[k]:
                        text = text.ljust(max(left[at], len(text) + 2 if text else 0)) + lines[k]
                out.append(text)
        return out

    @staticmethod
    def _span(cell: Node, name: str) -> int:
        value = cell.attributes.get(name, "1")
        return min(max(int(value), 1), 1000) if re.fullmatch(r"\d{1,6}", value) else 1


def visible_text(page: str | None) -> str | None:
    """All visible text of one page."""
    if page is None:
        return None
    tree = Tree(page)
    lines = Renderer(tree).lines(tree.root)
    out: list[str] = []
    for line in lines:
        if line or out and out[-1]:
            out.append(line)
    return "\n".join(out).strip("\n")


def _render(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in pages:
        yield pd.Series([visible_text(page) for page in some], dtype=object)


def extract(pages: DataFrame, column: str | Column = "html") -> DataFrame:
    """Add ``text``, the visible text of every page."""
    return pages.withColumn("text", F.pandas_udf(_render, "string")(column))
