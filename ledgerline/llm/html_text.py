"""HTML extraction with the layout kept: a tree of elements, then a rendering of its visible text.

The tree builder knows void elements, rows that a cell implies, tags that an opening tag ends by itself (``p``, ``li``, ``dt``, ``td``,
``tr``, ``option``, ...), raw text (``script``, ``style``, ...) and closing tags that match no open element. Each page is a
row on its own, so Spark splits the work by rows.

Rendering: what is hidden (script, style, head, ``hidden``, ``display:none``, closed ``details``, and
``visibility:hidden`` where no descendant is made visible again) is left out; ``title`` belongs to the head and is not part of
the page. Text of formulas and drawings stays, without the descriptions and definitions in them. Blocks begin and end lines, paragraphs
and headings stand apart by a blank line, list items get a bullet or their number and an indent for each level,
table rows become lines whose columns start at the same place (what is in a table but in no cell comes before them), ``pre`` keeps its white space, images give their ``alt``.

A null page gives null, an empty one an empty text. Ids may be null or repeated; rows come back one for one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of the HTML standard, by the role they have here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes template xmp".split())
HIDDEN = frozenset("head script style noscript template iframe noframes datalist object audio video canvas title".split())
#: Not shown, and only there: inside svg and inside math.
UNSEEN = {"svg": frozenset("desc defs metadata symbol clippath mask marker pattern".split()), "math": frozenset("annotation annotation-xml".split())}
APART = frozenset("text mtd mtr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
#: An opening tag closes an open element of these names, if none of the limits lies in between.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
#: Parts of a table open right inside the nearest of these, whatever else is open in between.
SECTIONS = frozenset("tbody thead tfoot".split())
INSIDE = {"td": SECTIONS | {"tr", "table"}, "th": SECTIONS | {"tr", "table"}, "tr": SECTIONS | {"table"}} | {n: frozenset({"table"}) for n in SECTIONS}
ENDS_PARAGRAPH = BLOCKS - frozenset("body html option optgroup li dt dd tr tbody thead tfoot".split()) | {"li", "dt", "dd"}
KEEPS_PARAGRAPH = frozenset("table td th li dd dt button caption".split())

DEEPEST = 100
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile("['\">]")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_INVISIBLE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|initial|hidden|collapse)", re.I)
_BLANK = re.compile(r"[ \t\r\n\f]+")


@dataclass
class Element:
    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Element | str] = field(default_factory=list)


def tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """``start, end, slash, name, attributes`` of every tag, with an empty name for comments and declarations.

    A tag ends at the first ``>`` outside quotes; without one it is text. A quote that leads to no end is remembered, and
    no search passes it a second time, so the work is linear in the page whatever stands in it. Sending a number goes on
    from that place.
    """
    special = [m.start() for m in _SPECIAL.finditer(page)]
    last, dead, at = page.rfind(">"), set(), 0

    def end_of_tag(start: int) -> int:
        passed, i = [], bisect_left(special, start)
        while i < len(special) and special[i] not in dead:
            place = special[i]
            if page[place] == ">":
                return place + 1
            passed.append(place)
            closing = page.find(page[place], place + 1)
            if closing < 0:
                break
            i = bisect_left(special, closing + 1)
        dead.update(passed)
        return -1

    while (at := page.find("<", at)) >= 0:
        end, slash, name, attributes = -1, "", "", ""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4) + 3
            end = end if end > 2 else len(page)
        elif at < last:
            if page[at + 1] in "!?":
                end = page.find(">", at) + 1
            elif tag := _NAME.match(page, at):
                slash, name = tag.groups()
                if (end := end_of_tag(tag.end())) > 0:
                    attributes = page[tag.end() : end - 1]
        if end < 0:
            at += 1
            continue
        moved = yield at, end, slash, name, attributes
        at = end
        if moved is not None:
            at = moved
            yield at, at, "", "", ""  # what answers the number


def parse(page: str) -> tuple[Element, int]:
    """The tree of a page, and how deep it is; whatever is open at its end is closed there."""
    root = Element("#root")
    stack, at, deepest = [root], 0, 0

    def close(names: set[str] | frozenset[str], limits: set[str] | frozenset[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name in names:
                del stack[depth:]
                return close(names, limits)
            if stack[depth].name in limits:
                return None
        return None

    found = tokens(page)
    for start, end, slash, name, said in found:
        if start > at:
            stack[-1].children.append(page[at:start])
        at = end
        if not name:
            continue
        name = name.lower()
        if slash:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    del stack[depth:]
                    break
                if stack[depth].name in ("td", "th", "table") and name not in ("tr", "tbody", "thead", "tfoot", "table", "body", "html"):
                    break  # a stray tag inside a cell does not leave it
            continue
        if name in CLOSED_BY:
            close(*CLOSED_BY[name])
        if name in ENDS_PARAGRAPH:
            close({"p"}, KEEPS_PARAGRAPH)
        if name in INSIDE:
            inner = next((d for d in range(len(stack) - 1, 0, -1) if stack[d].name in INSIDE[name] or stack[d].name in ("td", "th")), 0)
            if inner and stack[inner].name in INSIDE[name]:
                del stack[inner + 1 :]
                if name in ("td", "th") and stack[-1].name != "tr":
                    row = Element("tr")
                    stack[-1].children.append(row)
                    stack.append(row)
        attributes = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(said)} if said.strip() else {}
        element = Element(name, attributes)
        stack[-1].children.append(element)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            element.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            found.send(at)
        elif name not in VOID and not said.rstrip().endswith("/"):
            stack.append(element)
            deepest = max(deepest, len(stack))
    stack[-1].children.append(page[at:])
    return root, deepest


def settle(root: Element) -> None:
    """Takes out what is not shown because of where it stands: text under ``visibility:hidden`` that no descendant makes visible again, and definitions in svg and math."""
    work = [(root, True, "")]
    while work:
        element, shown, drawing = work.pop()
        kept: list[Element | str] = []
        for child in element.children:
            if isinstance(child, str):
                kept += [child] if shown else []
                continue
            if child.name in UNSEEN.get(drawing, ()):
                continue
            said = _VISIBILITY.findall(child.attributes.get("style", ""))
            if said and said[-1].lower() == "collapse" and child.name in INSIDE:
                continue  # such rows have no place at all
            own = said[-1].lower() in ("visible", "initial") if said else shown
            if own or child.name not in ("img", "input", "hr"):
                kept.append(child)
            work.append((child, own, child.name if child.name in UNSEEN else "" if child.name == "foreignobject" else drawing))
        element.children = kept


def visible(element: Element) -> bool:
    a = element.attributes
    return not (element.name in HIDDEN or "hidden" in a or element.name == "input" and a.get("type", "").lower() == "hidden" or _INVISIBLE.search(a.get("style", "")))


class _Lines:
    """Text laid out in lines: words flow until a line is ended; blank lines are asked for and come before the next text."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.line = ""
        self.gap = 0
        self.prefix = ""
        self.mark = ""

    def flow(self, text: str) -> None:
        text = _BLANK.sub(" ", text)
        if not self.line or self.line.endswith((" ", "\n")):
            text = text.lstrip(" ")
        if text:
            self.line += text

    def end(self, blank: int = 0) -> None:
        text = self.line.rstrip(" ")
        if text:
            if self.done and self.gap:
                self.done.append("")
            first = self.prefix[: max(0, len(self.prefix) - len(self.mark))] + self.mark
            self.done.append((first if self.mark else self.prefix) + text)
            self.mark, self.gap = "", 0
        self.line = ""
        self.gap = max(self.gap, blank)

    def keep(self, text: str) -> None:
        """Preformatted text, as it is."""
        for line in text.strip("\n").split("\n"):
            self.line = line.rstrip() or self.line
            if line.strip():
                self.end()
            elif self.done:
                self.end(1)


def _text_of(element: Element) -> str:
    return "".join(c if isinstance(c, str) else _text_of(c) if c.name != "br" else "\n" for c in element.children if isinstance(c, str) or visible(c))


def _rows(table: Element) -> list[list[Element]]:
    """Rows of a table without those of tables inside its cells."""
    out: list[list[Element]] = []
    for child in table.children:
        if isinstance(child, str) or not visible(child):
            continue
        if child.name == "tr":
            out.append([c for c in child.children if not isinstance(c, str) and c.name in ("td", "th") and visible(c)])
        elif child.name in SECTIONS:
            out += _rows(child)
    return out


def _strays(part: Element, lines: _Lines) -> None:
    """What stands in a table, a section or a row but in no cell comes before the rows."""
    for child in part.children:
        if isinstance(child, str):
            if child.strip():
                _node(child, lines, 0)
        elif child.name == "caption":
            if visible(child):
                _children(child, lines, 0)
                lines.end()
        elif child.name in SECTIONS or child.name in ("tr", "colgroup"):
            if visible(child):
                _strays(child, lines)
        elif child.name != "col" and not (part.name == "tr" and child.name in ("td", "th")):
            _node(child, lines, 0)


def _table(table: Element, lines: _Lines) -> None:
    _strays(table, lines)
    lines.end()
    rows = [[render(cell).replace("\n\n", "\n").split("\n") for cell in row] for row in _rows(table)]
    width: dict[int, int] = {}
    for row in rows:
        for k, cell in enumerate(row):
            width[k] = max([width.get(k, 0), *map(len, cell)])
    for row in rows:
        for k in range(max([0, *map(len, row)])):
            text = "  ".join((cell[k] if k < len(cell) else "").ljust(width[c]) for c, cell in enumerate(row))
            if text.strip():
                lines.line = text
                lines.end()


def _children(element: Element, lines: _Lines, depth: int) -> None:
    number = int(element.attributes["start"]) if re.fullmatch(r"-?\d{1,9}", element.attributes.get("start", "")) else 1
    for child in element.children:
        if isinstance(child, Element) and child.name == "li" and visible(child):
            mark = f"{number}. " if element.name == "ol" else "- "
            number += 1
            lines.end()
            before = lines.prefix
            lines.prefix, lines.mark = before + " " * len(mark), mark
            _children(child, lines, depth + 1)
            lines.end()
            lines.prefix, lines.mark = before, ""
        elif element.name == "details" and "open" not in element.attributes and (isinstance(child, str) or child.name != "summary"):
            continue
        else:
            _node(child, lines, depth)


def _node(node: Element | str, lines: _Lines, depth: int) -> None:
    if isinstance(node, str):
        lines.flow(unescape(node))
        return
    if not visible(node):
        return
    name = node.name
    if name == "br":
        lines.end()
    elif name == "hr":
        lines.end(1)
    elif name == "img":
        lines.flow(node.attributes.get("alt", ""))
    elif name == "input":
        lines.flow(f" {node.attributes.get('value', '')} " if node.attributes.get("type", "text").lower() in ("submit", "button", "reset") else "")
    elif name == "textarea":
        lines.flow(unescape(_text_of(node)))
    elif name == "pre":
        lines.end(1)
        lines.keep(unescape(_text_of(node)))
        lines.end(1)
    elif name == "table":
        lines.end(1)
        _table(node, lines)
        lines.end(1)
    elif name in BLOCKS or name in ("td", "th", "caption"):
        blank = 1 if name in SPACED and not (name in ("ul", "ol") and lines.prefix) else 0
        lines.end(blank)
        before = lines.prefix
        lines.prefix += "  " if name in ("dd", "blockquote") else ""
        _children(node, lines, depth + 1)
        lines.end(blank)
        lines.prefix = before
    elif name in APART:  # labels of a drawing and cells of a matrix
        lines.flow(" ")
        _children(node, lines, depth + 1)
        lines.flow(" ")
    else:
        _children(node, lines, depth + 1)


def render(element: Element) -> str:
    lines = _Lines()
    _children(element, lines, 0)
    lines.end()
    return "\n".join(lines.done)


def page_text(page: str | None) -> str | None:
    """The visible text of a page; of a very deep tree the lower levels are flattened, so no page overflows the stack."""
    if page is None:
        return None
    tree, depth = parse(page)
    settle(tree)
    return render(tree if depth < DEEPEST else flattened(tree))


def flattened(element: Element, most: int = DEEPEST) -> Element:
    """The same tree; what lies deeper than ``most`` levels is laid side by side on the last one, in order."""
    root = Element(element.name, element.attributes)
    work = [(element, root, 0)]
    while work:
        source, target, depth = work.pop()
        if depth < most:
            for child in source.children:
                if isinstance(child, str):
                    target.children.append(child)
                else:
                    copy = Element(child.name, child.attributes)
                    target.children.append(copy)
                    work.append((child, copy, depth + 1))
            continue
        inner = list(reversed(source.children))
        while inner:
            child = inner.pop()
            if isinstance(child, str):
                target.children.append(child)
            elif visible(child):
                target.children.append(Element(child.name, child.attributes, [] if child.name not in RAW else child.children))
                if child.name not in RAW:
                    inner.extend(reversed(child.children))
    return root


def page_texts(pages: DataFrame) -> DataFrame:
    """``page_id, text`` of every row of ``pages`` (``page_id``, ``html``)."""
    key = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [page_text(p) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {key}, text string")
