"""Text of web pages as a reader would see it.

A tree builder follows HTML's rules for implied and closed tags; a walk over the tree applies
the visibility rules and lays the text out: block elements on lines of their own, paragraphs
and headings with a blank line around them, list items with bullets or numbers and an indent
for each level, and tables with their cells padded to common column widths, spans included.

Hidden are: head, scripts, styles, templates and embedded fallbacks; ``hidden``; elements
whose style attribute, or a rule of the page's own style sheets for their tag, class or id,
says ``display: none``; text under ``visibility: hidden`` or ``collapse`` that isn't set
visible again; closed dialogs, what a closed ``details`` folds away, and unselected options.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .shared import byte_slices, col, frugal, with_fields

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
_NEVER = frozenset("head script style template title meta link base iframe noembed noframes noscript audio video canvas object datalist rp area map param source track".split())
_SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl menu table figure fieldset hr".split())
_BLOCK = _SPACED | frozenset("address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li listing main nav optgroup option plaintext search section summary caption thead tbody tfoot tr td th".split())
_CLOSES_P = _SPACED | frozenset("address article aside center details dialog dir div dd dt figcaption footer form header hgroup li main nav search section summary".split())
_SCOPE = frozenset("table td th caption html template object button body".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")
_ATTRIBUTE = re.compile(r"""([^\s/>="'][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SIMPLE = re.compile(r"(?:[a-zA-Z][\w-]*|[.#][\w-]+)$")
_HIDES = re.compile(r"(?:^|;)\s*(display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_SHOWS = re.compile(r"(?:^|;)\s*visibility\s*:\s*visible\b", re.I)
_PRE_STYLE = re.compile(r"(?:^|;)\s*white-space\s*:\s*(?:pre|pre-wrap|break-spaces)\b", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def _close(stack: list[Node], wanted: frozenset[str] | set[str], until: frozenset[str]) -> bool:
    """Pop through the nearest of ``wanted``, unless one of ``until`` comes first."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in wanted:
            del stack[k:]
            return True
        if stack[k].tag in until:
            return False
    return False


_P, _LI, _LISTS = frozenset(["p"]), frozenset(["li"]), _SCOPE | frozenset("ul ol menu dir".split())
_DD, _DLS = frozenset(["dd", "dt"]), _SCOPE | frozenset(["dl"])
_CELL, _ROW, _GROUP = frozenset(["td", "th"]), frozenset(["tr"]), frozenset(["thead", "tbody", "tfoot"])
_TABLE, _CAPTION = frozenset(["table"]), frozenset(["caption", "colgroup"])


def _table_part(stack: list[Node], tag: str) -> bool:
    """Close and imply what ``tag`` (a part of a table) needs; false if there is no table around."""
    if not any(n.tag == "table" for n in stack):
        return False
    _close(stack, _CAPTION, _TABLE)
    if tag in _CELL:
        _close(stack, _CELL, _TABLE | _ROW)
        if stack[-1].tag != "tr":
            _table_part(stack, "tr")
            _push(stack, "tr", {})
    elif tag == "tr":
        _close(stack, _ROW, _TABLE)
        if not _in(stack, _GROUP):
            while stack[-1].tag != "table":
                stack.pop()
            _push(stack, "tbody", {})
        else:
            while stack[-1].tag not in _GROUP:
                stack.pop()
    else:
        while stack[-1].tag != "table":
            stack.pop()
    return True


def _in(stack: list[Node], tags: frozenset[str]) -> bool:
    for n in reversed(stack):
        if n.tag in tags:
            return True
        if n.tag == "table":
            return False
    return False


def _push(stack: list[Node], tag: str, attrs: dict[str, str]) -> Node:
    node = Node(tag, attrs)
    stack[-1].children.append(node)
    stack.append(node)
    return node


def parse(html: str) -> Node:
    """The tree of a page; any text gives one."""
    root = Node("#root", {})
    stack, at, end = [root], 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            stack[-1].children.append(unescape(html[at:lt]))
        if lt == end:
            break
        nxt = html[lt + 1 : lt + 2]
        if nxt in ("!", "?") or (nxt == "/" and not html[lt + 2 : lt + 3].isalpha()):
            if html.startswith("<!--", lt):
                stop = html.find("-->", lt + 4 if not html.startswith("<!-->", lt) else lt + 2)
                at = end if stop < 0 else stop + 3
            elif nxt == "/" and lt + 2 >= end:
                stack[-1].children.append("</")
                at = end
            else:
                stop = html.find(">", lt)
                at = end if stop < 0 else stop + 1
            continue
        m = _TAG.match(html, lt) or _LOOSE_TAG.match(html, lt)
        if m is None:
            if nxt.isalpha() or nxt == "/":
                break  # a tag that never ends
            stack[-1].children.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            _end(stack, tag)
            continue
        attrs = _attributes(m[3]) if m[3] and not m[3].isspace() and m[3] != "/" else {}
        if not _start(stack, tag, attrs):
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            body = html[at : stop.start() if stop else end]
            stack[-1].children.append(unescape(body) if tag in ("textarea", "title") else body)
            stack.pop()
            gt = html.find(">", stop.end()) if stop else -1
            at = gt + 1 if gt >= 0 else end
        elif tag == "plaintext":
            stack[-1].children.append(html[at:])
            break
    return root


def _start(stack: list[Node], tag: str, attrs: dict[str, str]) -> bool:
    """Add an element; false if it is left out or empty by nature."""
    if tag in ("html", "body"):
        same = next((n for n in stack if n.tag == tag), None)
        if same is not None:
            for k, v in attrs.items():
                same.attrs.setdefault(k, v)
            return False
        if tag == "body":
            _close(stack, frozenset(["head"]), frozenset())
    elif tag == "image":
        tag = "img"
    elif len(stack) > 1 and stack[-1].tag == "head" and tag not in _NEVER:
        stack.pop()  # the body begins
    if tag in _CLOSES_P:
        _close(stack, _P, _SCOPE)
        if tag in _HEADINGS and stack[-1].tag in _HEADINGS:
            stack.pop()
        elif tag == "li":
            _close(stack, _LI, _LISTS)
        elif tag in _DD:
            _close(stack, _DD, _DLS)
    elif tag == "option":
        _close(stack, frozenset(["option"]), frozenset(["select", "datalist"]))
    elif tag == "optgroup":
        _close(stack, frozenset(["option"]), frozenset(["select"]))
        _close(stack, frozenset(["optgroup"]), frozenset(["select"]))
    elif tag in ("rt", "rp"):
        _close(stack, frozenset(["rt", "rp"]), frozenset(["ruby"]))
    elif tag in ("a", "button"):
        _close(stack, frozenset([tag]), _SCOPE - {"button"})
    elif (tag in _CELL or tag in _ROW or tag in _GROUP or tag in _CAPTION) and not _table_part(stack, tag):
        return False
    _push(stack, tag, attrs)
    if tag in _VOID:
        stack.pop()
        return False
    return True


def _end(stack: list[Node], tag: str) -> None:
    if tag == "br":
        stack[-1].children.append(Node("br", {}))
    elif tag == "p":
        if not _close(stack, _P, _SCOPE):
            stack[-1].children.append(Node("p", {}))
    elif tag in _HEADINGS:
        _close(stack, _HEADINGS, _SCOPE)
    elif tag == "li":
        _close(stack, _LI, _LISTS)
    elif tag in ("html", "body"):
        return  # what follows still belongs to the body
    elif tag in _CELL or tag in _ROW or tag in _GROUP or tag == "caption":
        _close(stack, frozenset([tag]), _TABLE)
    elif tag == "table":
        _close(stack, _TABLE, frozenset())
    elif tag in _BLOCK:
        _close(stack, frozenset([tag]), _SCOPE - {tag})
    else:
        _close(stack, frozenset([tag]), _SCOPE | _BLOCK)


class _Sheet:
    """Elements that the page's own style sheets hide, for rules on one tag, class or id."""

    def __init__(self) -> None:
        self.none: set[str] = set()
        self.invisible: set[str] = set()

    def read(self, css: str) -> None:
        for selectors, body in _RULE.findall(re.sub(r"/\*.*?\*/", "", css, flags=re.S)):
            hit = _HIDES.search(body)
            if hit and "@" not in selectors:
                into = self.none if hit[1].lower().startswith("display") else self.invisible
                into.update(s.strip() for s in selectors.split(",") if _SIMPLE.match(s.strip()))

    def hides(self, node: Node, of: set[str]) -> bool:
        if node.tag in of or ("id" in node.attrs and "#" + node.attrs["id"] in of):
            return True
        return "class" in node.attrs and any("." + c in of for c in node.attrs["class"].split())


def width(s: str) -> int:
    """Columns that ``s`` takes in a fixed-width rendering."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class _Out:
    """Lines of one flow: the page, or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0  # blank lines owed before the next text
        self.indent: list[str] = []
        self.mark: str | None = None

    def text(self, s: str, pre: bool) -> None:
        if pre:
            parts = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            for k, part in enumerate(parts):
                if k:
                    self.line(True)
                if part:
                    self.put(part)
            return
        words = _SPACE.split(s)
        if words[0] == "" and self.now:
            self.space = True
        for k, w in enumerate(words):
            if w:
                if k and self.now:
                    self.space = True
                self.put(w)
        if words[-1] == "" and len(words) > 1 and self.now:
            self.space = True

    def put(self, s: str) -> None:
        if self.space and self.now:
            self.now.append(" ")
        self.space = False
        self.now.append(s)

    def line(self, even_empty: bool = False) -> None:
        """End the line."""
        if self.now or even_empty or self.mark is not None:
            if self.gap and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            lead = "".join(self.indent)
            if self.mark is not None:
                lead = "".join(self.indent[:-1]) + self.mark
                self.mark = None
            self.lines.append((lead + "".join(self.now)).rstrip(" "))
        self.now, self.space = [], False

    def block(self, spaced: bool) -> None:
        if self.now:
            self.line()
        if spaced:
            self.gap = max(self.gap, 1)

    def close(self) -> list[str]:
        self.block(False)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        while self.lines and not self.lines[0]:
            del self.lines[0]
        return [x.replace("\xa0", " ") for x in self.lines]


def _number(n: int, kind: str) -> str:
    if kind in ("a", "A") and n > 0:
        s = ""
        while n:
            n, r = divmod(n - 1, 26)
            s = chr(97 + r) + s
    elif kind in ("i", "I") and 0 < n < 4000:
        s = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            while n >= value:
                s, n = s + sign, n - value
    else:
        return str(n)
    return s.upper() if kind.isupper() else s


def _int(s: str | None, default: int, most: int = 10**9) -> int:
    m = re.match(r"\s*([+-]?\d{1,12})", s or "")
    return min(int(m[1]), most) if m else default


def lay_out(rows: list[list[tuple[list[str], int, int, str]]]) -> list[str]:
    """Lines of a table from its cells (lines, colspan, rowspan, align)."""
    taken: set[tuple[int, int]] = set()
    cells: list[tuple[int, int, int, list[str], str]] = []
    for r, row in enumerate(rows):
        c = 0
        for lines, across, down, align in row:
            while (r, c) in taken:
                c += 1
            down = min(down, len(rows) - r) or len(rows) - r
            if down > 1 or across > 1:
                taken.update((r + i, c + j) for i in range(down) for j in range(across))
            else:
                taken.add((r, c))
            cells.append((r, c, across, lines, align))
            c += across
    if not cells:
        return []
    # columns that no cell starts or ends in would only be empty space
    starts = sorted({c for _, c, _, _, _ in cells})
    rank = {c: k for k, c in enumerate(starts)}
    placed = [(r, rank[c], max(1, sum(1 for s in starts if c <= s < c + a)) if a > 1 else 1, lines, align) for r, c, a, lines, align in cells]
    wide = [0] * len(starts)
    for _, c, a, lines, _ in placed:
        if a == 1:
            wide[c] = max([wide[c], *map(width, lines)])
    for _, c, a, lines, _ in sorted(placed, key=lambda x: x[2]):
        if a > 1:
            short = max([0, *map(width, lines)]) - sum(wide[c : c + a]) - 2 * (a - 1)
            if short > 0:
                wide[c + a - 1] += short
    out: list[str] = []
    by_row: dict[int, list[tuple[int, int, list[str], str]]] = {}
    for r, c, a, lines, align in placed:
        by_row.setdefault(r, []).append((c, a, lines, align))
    for r in range(len(rows)):
        own = by_row.get(r, [])
        for k in range(max([0, *(len(lines) for _, _, lines, _ in own)])):
            parts, at = [], 0
            for c, a, lines, align in sorted(own, key=lambda x: x[0]):
                parts.append(" " * (sum(wide[at:c]) + 2 * (c - at)))
                room = sum(wide[c : c + a]) + 2 * (a - 1)
                s = lines[k] if k < len(lines) else ""
                free = room - width(s)
                left = free if align == "right" else free // 2 if align == "center" else 0
                parts.append(" " * left + s + " " * (free - left) + "  ")
                at = c + a
            out.append("".join(parts).rstrip(" "))
    return out


class _Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int, str]]] = []
        self.caption: list[str] = []


def render(html: str) -> str:
    """All visible text of a page."""
    root = parse(html)
    sheet = _Sheet()
    walk = [root]
    while walk:
        n = walk.pop()
        if n.tag == "style":
            sheet.read("".join(x for x in n.children if isinstance(x, str)))
        walk += [x for x in n.children if not isinstance(x, str)]
    flows, tables, lists = [_Out()], [], []
    # entries: (node, visible, preformatted), or a function to call on the way out
    todo: list = [(root, True, False)]
    while todo:
        item = todo.pop()
        if callable(item):
            item()
            continue
        node, visible, pre = item
        out = flows[-1]
        if isinstance(node, str):
            if visible:
                out.text(node, pre)
            continue
        tag, attrs = node.tag, node.attrs
        style = attrs.get("style", "")
        hit = _HIDES.search(style) if style else None
        if tag in _NEVER or "hidden" in attrs or (hit and hit[1].lower().startswith("display")) or (sheet.none and sheet.hides(node, sheet.none)) or (tag == "dialog" and "open" not in attrs):
            continue
        if style or sheet.invisible:
            visible = True if _SHOWS.search(style) else False if hit or sheet.hides(node, sheet.invisible) else visible
            pre = pre or bool(_PRE_STYLE.search(style))
        children = node.children
        if tag == "br":
            if visible:
                out.line(True)
            continue
        if tag == "input":
            kind = attrs.get("type", "text").lower()
            if visible and kind in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number") and attrs.get("value"):
                out.text(attrs["value"], False)
            continue
        if tag in ("img", "hr", "wbr", "col", "embed"):
            if tag == "hr":
                out.block(True)
            continue
        leave: list = []
        if tag == "table":
            out.block(True)
            table = _Table()
            tables.append(table)

            def leave_table(table=table, out=out, visible=visible):
                tables.pop()
                rows = lay_out(table.rows)
                for x in table.caption + rows:
                    out.now = [x] if x else []
                    out.line(True)
                out.block(True)

            leave.append(leave_table)
        elif tag in ("td", "th", "caption") and tables:
            flow = _Out()
            flows.append(flow)
            table = tables[-1]
            held, lists = lists, []

            def leave_cell(flow=flow, table=table, attrs=attrs, tag=tag, held=held):
                nonlocal lists
                lists = held
                flows.pop()
                lines = flow.close()
                if tag == "caption":
                    table.caption += lines
                    return
                align = attrs.get("align", "").lower()
                m = re.search(r"text-align\s*:\s*(right|center)", attrs.get("style", ""), re.I)
                if not table.rows:
                    table.rows.append([])
                table.rows[-1].append((lines, max(1, _int(attrs.get("colspan"), 1, 1000)), max(0, _int(attrs.get("rowspan"), 1, 65534)), m[1].lower() if m else align))

            leave.append(leave_cell)
        elif tag == "tr" and tables:
            tables[-1].rows.append([])
        elif tag in ("ul", "ol", "menu", "dir"):
            out.block(not lists)
            marks = {"kind": tag, "type": attrs.get("type", "1"), "next": _int(attrs.get("start"), 1), "step": 1}
            if tag == "ol" and "reversed" in attrs:
                marks["step"] = -1
                if "start" not in attrs:
                    marks["next"] = sum(1 for x in children if not isinstance(x, str) and x.tag == "li")
            lists.append(marks)

            def leave_list(out=out):
                lists.pop()
                out.block(not lists)

            leave.append(leave_list)
        elif tag == "li":
            out.block(False)
            if out.mark is not None:
                out.line()
            own = lists[-1] if lists else {"kind": "ul", "type": "", "next": 1, "step": 1}
            if own["kind"] == "ol":
                n = _int(attrs.get("value"), own["next"])
                own["next"] = n + own["step"]
                mark = _number(n, own["type"]) + ". "
            else:
                mark = "- "
            out.indent.append(" " * len(mark))
            out.mark = mark if visible else None

            def leave_item(out=out):
                out.block(False)
                out.indent.pop()
                out.mark = None

            leave.append(leave_item)
        elif tag in ("dd", "blockquote"):
            out.block(tag == "blockquote")
            out.indent.append("    " if tag == "dd" else "  ")

            def leave_indent(out=out, tag=tag):
                out.block(tag == "blockquote")
                out.indent.pop()

            leave.append(leave_indent)
        elif tag in ("pre", "listing", "textarea", "xmp", "plaintext"):
            pre = True
            if tag != "textarea":
                out.block(True)
                leave.append(lambda out=out: out.block(True))
            if children and isinstance(children[0], str) and children[0][:1] == "\n":
                children = [children[0][1:], *children[1:]]
        elif tag in _BLOCK:
            spaced = tag in _SPACED
            out.block(spaced)
            leave.append(lambda out=out, spaced=spaced: out.block(spaced))
        elif tag == "q" and visible:
            out.text("“", False)
            leave.append(lambda out=out: out.text("”", False))
        elif tag == "select":
            options = [x for x in _descend(node) if x.tag == "option"]
            chosen = [x for x in options if "selected" in x.attrs]
            if "multiple" not in attrs:
                children = chosen[-1:] or options[:1]
            leave.append(lambda out=out: out.block(False)) if "multiple" in attrs else None
        if tag == "details" and "open" not in attrs:
            children = [x for x in children if not isinstance(x, str) and x.tag == "summary"][:1]
        todo += leave
        todo += [(x, visible, pre) for x in reversed(children)]
    return "\n".join(flows[0].close())


def _descend(node: Node) -> Iterator[Node]:
    walk = [x for x in reversed(node.children) if not isinstance(x, str)]
    while walk:
        n = walk.pop()
        yield n
        walk += [x for x in reversed(n.children) if not isinstance(x, str)]


def extract(pages: DataFrame, *, html: str = "html", carry: tuple[str, ...] = ("page_id", "url"), into: str = "text") -> DataFrame:
    """Columns ``carry``, then the visible text of every page. No shuffle; whole pages.

    Null pages give null, pages without visible text (empty ones too) an empty string;
    repeated rows are each rendered; depth and length of a page are unbounded; a carried
    column keeps its name, and the text's gets underscores if it is the same.
    """
    picked = pages.select(*[col(pages, c) for c in carry], col(pages, html).cast("string").alias("__html"))
    schema = with_fields(pages.select(*[col(pages, c) for c in carry]), **{into: T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column(len(carry))):
                part = batch.slice(a, b - a)
                texts = [None if x is None else render(x) for x in part.column(len(carry)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(carry))], pa.array(texts, pa.string())], names=schema.names)

    return picked.mapInArrow(frugal(run), schema)
