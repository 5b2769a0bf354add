"""Visible text of HTML pages: a tree with implied tags, then rendering by layout."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noframes plaintext".split())
#: Raw content that is shown, and whether references in it are resolved.
RAW_SHOWN = {"textarea": True, "title": True, "xmp": False, "plaintext": False}
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
KEEPS_SPACE = frozenset("pre textarea xmp listing plaintext".split())
HIDDEN = frozenset("head script style template noscript iframe noframes title meta link base datalist object audio video canvas rp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul caption xmp listing plaintext".split())
SPACED = frozenset("p blockquote ul ol dl pre h1 h2 h3 h4 h5 h6 table figure".split())
#: An opening tag ends these open elements, looked for up to one of the limits.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
ENDS["tbody"] = ENDS["tfoot"] = ENDS["thead"]
CELL_WALL = frozenset({"table", "td", "th", "caption", "html", "body"})
#: Parts of a table, and in which of them each may stand; a row around loose cells is implied.
_SECTIONS = frozenset({"table", "thead", "tbody", "tfoot"})
PLACES = {"tr": _SECTIONS, "td": _SECTIONS | {"tr"}, "th": _SECTIONS | {"tr"}, "col": frozenset({"table", "colgroup"})} | dict.fromkeys(("thead", "tbody", "tfoot", "caption", "colgroup"), frozenset({"table"}))
#: Where only parts of a table may stand: anything else moves out, to before the table.
STRICT = _SECTIONS | {"tr"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_UNSEEN = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(hidden|collapse|visible)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


class Open:
    """The open elements, outermost first, and where those of each name are, so that none has to be looked for."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, k: int) -> None:
        for node in self.nodes[k:]:
            self.places[node.tag].pop()
        del self.nodes[k:]

    def last(self, tags) -> int:
        """The place of the innermost element with one of these names, or 0."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def close(self, tags, limits) -> None:
        """Ends the innermost of ``tags`` with all within it, and those of ``tags`` right around it, unless a limit is nearer."""
        k = self.last(tags)
        if k and k > self.last(limits):
            while k > 1 and self.nodes[k - 1].tag in tags:
                k -= 1
            self.cut(k)


def tree(page: str) -> Node:
    """Nodes of a page. End tags without a start are ignored; what is open at the end is closed. Linear in the page, however deep."""
    root = Node("html", {})
    open_ = Open(root)
    nodes = open_.nodes

    def place(child: Node | str) -> None:
        """Below the innermost open element; out of a table, before it, if only parts of a table may stand there."""
        k = open_.last(("table",)) if nodes[-1].tag in STRICT else 0
        if k and (child.strip(" \t\n\r\f") if isinstance(child, str) else child.tag not in PLACES):
            nodes[k - 1].children.insert(-1, child)  # an open table is its parent's last child
        else:
            nodes[-1].children.append(child)

    def text(s: str) -> None:
        if s:
            if nodes[-1].tag == "head" and s.strip(" \t\n\r\f"):
                open_.cut(len(nodes) - 1)
            place(html.unescape(s))

    at = 0
    while found := _TOKEN.search(page, at):
        text(page[at : found.start()])
        at = found.end()
        if end := found[1]:
            end = end.lower()
            wall = ("table",) if end in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption") else () if end == "table" else CELL_WALL
            if end == "br":
                place(Node("br", {}))
            elif end not in ("html", "body") and (k := open_.last((end,))) > (0 if end == "table" else open_.last(t for t in wall if t != end)):
                open_.cut(k)
        elif tag := found[2]:
            tag = tag.lower()
            attributes = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(found[3])} if found[3] else {}
            if tag == "html":
                root.attributes.update(attributes)
                continue
            if nodes[-1].tag == "head" and tag not in IN_HEAD:
                open_.cut(len(nodes) - 1)
            if tag == "body" or tag in BLOCK:
                open_.close(("p",), CELL_WALL | {"li", "div"} if tag == "li" else CELL_WALL)
            if tag == "body":
                open_.close(("head",), ())
                if open_.last(("body",)):
                    continue
            node = Node(tag, attributes)
            in_table = open_.last(("table",))
            if tag == "form" and nodes[-1].tag in STRICT and in_table:
                continue  # stays empty within a table
            if tag == "table" and nodes[-1].tag in STRICT and in_table:
                open_.cut(in_table)  # a table directly in a table ends it
            if tag in PLACES and in_table:
                k = len(nodes)
                while nodes[k - 1].tag not in PLACES[tag]:
                    k -= 1
                open_.cut(k)
                if tag in ("td", "th") and nodes[-1].tag != "tr":
                    nodes[-1].children.append(row := Node("tr", {}))
                    open_.push(row)
            elif tag in ENDS:
                open_.close(*ENDS[tag])
            place(node)
            if tag in RAW:
                stop = None if tag == "plaintext" else re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                stop_at = stop.start() if stop else len(page)
                if tag in RAW_SHOWN:
                    node.children.append(html.unescape(page[at:stop_at]) if RAW_SHOWN[tag] else page[at:stop_at])
                at = stop_at
                if stop:
                    at = page.find(">", stop_at) + 1 or len(page)
            elif tag not in VOID and not (found[3] or "").endswith("/"):
                open_.push(node)
    text(page[at:])
    return root


def _visible(node: Node) -> bool:
    """Whether the element takes part in the layout at all."""
    a = node.attributes
    shut = (node.tag == "dialog" and "open" not in a) or (node.tag == "input" and a.get("type", "").lower() == "hidden")
    return not (node.tag in HIDDEN or "hidden" in a or shut or ("style" in a and _UNSEEN.search(a["style"])))


def _seen(node: Node, inherited: bool) -> bool:
    """``visibility`` is inherited, and a descendant may take it back."""
    found = _VISIBILITY.findall(node.attributes["style"]) if "style" in node.attributes else ()
    return found[-1].lower() == "visible" if found else inherited


def _drawn(svg: Node) -> list[Node]:
    """The text elements of a drawing, in order."""
    out, todo = [], [svg]
    while todo:
        node = todo.pop()
        if node.tag in ("text", "foreignobject"):
            out.append(node)
        elif node.tag in ("svg", "g", "a", "switch"):
            todo += [c for c in reversed(node.children) if not isinstance(c, str) and _visible(c)]
    return out


#: List levels that indent; deeper ones stand as far in as the last of them.
INDENTED = 16
#: A table's cells are aligned, and a table in a list is indented, while that makes at most so many characters of each one
#: of its text, where a cell counts as CELL_CHARS more. A table beyond that has its cells one after another.
BLOAT, CELL_CHARS = 16, 32


class Block:
    """Finished lines, how many characters they have, the longest, and how much text went into them. It is used once, and then changed."""

    __slots__ = ("chars", "raw", "rows", "wide")

    def __init__(self, rows: deque[str] | None = None, chars: int = 0, wide: int = 0, raw: int = 0):
        self.rows, self.chars, self.wide, self.raw = rows if rows is not None else deque(), chars, wide, raw


def _after(rows: deque[str], more: deque[str]) -> deque[str]:
    """``rows`` and then ``more``. The shorter one moves, so that lines nested deep don't move at each level."""
    if len(more) > len(rows):
        more.extendleft(reversed(rows))
        return more
    rows.extend(more)
    return rows


class Lines:
    """Text under construction: words, line breaks and wished-for blank lines."""

    def __init__(self, trim: bool = False):
        self.rows: deque[str] = deque()
        self.line: list[str] = []
        self.begun = False
        self.chars = self.wide = self.raw = 0
        self.wish = 0  # line breaks owed before the next text
        self.space = False
        self.prefix = ""
        self.indent = ""
        self.trim = trim

    def add(self, text: str, keep: bool = False) -> None:
        self.raw += len(text)
        if keep:
            rows = text.split("\n")
            for i, row in enumerate(rows):
                if i:
                    self._break()
                    self._put(self.indent)
                if row:
                    self._start()
                    self._put(row)
            return
        lead, trail = text[:1] in " \t\n\r\f", text[-1:] in " \t\n\r\f"
        words = _SPACE.sub(" ", text).strip(" ")
        if not words:
            self.space = self.space or bool(text)
            return
        fresh = self._start()
        if not fresh and (lead or self.space):
            self._put(" ")
        self._put(words)
        self.space = trail

    def insert(self, block: Block) -> None:
        """A block from here on; its lines stand as far in as this place does, while that is within bounds."""
        self.raw += block.raw
        self._start()
        self._put(block.rows.popleft())
        if not block.rows:
            return
        self._break()
        indent = self.indent if block.chars + len(self.indent) * len(block.rows) <= BLOAT * block.raw else ""
        last = indent + block.rows.pop()
        if indent:
            block.rows = deque(indent + row for row in block.rows)
        self.chars += block.chars + len(indent) * len(block.rows)
        if block.rows:
            self.wide = max(self.wide, block.wide + len(indent))
        self.rows = _after(self.rows, block.rows)
        self._put(last)

    def _start(self) -> bool:
        fresh = not self.begun or self.wish > 0
        if fresh:
            for _ in range(self.wish if self.begun else 0):
                self._break()
            self._put(self.prefix or self.indent)
            self.prefix, self.wish, self.space = "", 0, False
        return fresh

    def _put(self, text: str) -> None:
        if text:
            self.begun = True
            self.line.append(text)

    def _break(self) -> None:
        self.begun = True
        row = "".join(self.line)
        row = row.rstrip() if self.trim else row
        self.line = []
        self.rows.append(row)
        self.chars += len(row)
        self.wide = max(self.wide, len(row))

    def gap(self, lines: int) -> None:
        if self.begun:
            self.wish = max(self.wish, lines)
        self.space = False

    def block(self) -> Block:
        """What was written, without blank lines around it."""
        self._break()
        while self.rows and not self.rows[-1]:
            self.rows.pop()
        while self.rows and not self.rows[0]:
            self.rows.popleft()
        return Block(self.rows, self.chars, self.wide, self.raw)


def _span(node: Node, name: str, most: int) -> int:
    """A cell's colspan or rowspan; 0 rows mean all that are left. The limits are those of HTML."""
    text = node.attributes.get(name, "").strip()
    return min(int(text), most) if re.fullmatch(r"[0-9]{1,9}", text) else 1


def _grid(groups: list[list[list[Node]]]) -> list[list[tuple[int, int, Node]]]:
    """For each row its cells as (first column, columns, cell): spans keep other cells out of the columns they cover."""
    rows = []
    for group in groups:
        held: list[tuple[int, int, int]] = []  # first column, end, end row of what cells above still cover, by column
        for r, cells in enumerate(group):
            at, k, row, new = 0, 0, [], []
            for cell in cells:
                while k < len(held) and held[k][0] <= at:
                    at, k = max(at, held[k][1]), k + 1
                wide, tall = max(_span(cell, "colspan", 1000), 1), _span(cell, "rowspan", 65534)
                tall = min(tall or len(group), len(group) - r)
                row.append((at, wide, cell))
                if tall > 1:
                    if new and new[-1][1:] == (at, r + tall):
                        new[-1] = (new[-1][0], at + wide, r + tall)
                    else:
                        new.append((at, at + wide, r + tall))
                at += wide
            held = [x for x in held if x[2] > r + 1]
            if new:
                held = sorted(held + new)
            if row:
                rows.append(row)
    return rows


def _row(cells: list[tuple[int, Block]]) -> tuple[deque[str], int]:
    """A row of cells (place of its left edge, block) as lines, and the longest of them."""
    heights = sorted(len(b.rows) for _, b in cells)
    first = cells[0][1]
    # where the first cell is the tallest and stands at the edge, its lines below the other cells stay as they are
    whole = cells[0][0] == 0 and len(first.rows) == heights[-1]
    height = max((heights[-2] if len(heights) > 1 else 0) if whole else heights[-1], 0 if whole and first.rows else 1)
    lines: list[str] = []
    for _ in range(height):
        line = ""
        for left, block in cells:
            if block.rows and (text := block.rows.popleft()):
                line = line.ljust(left) + text
        lines.append(line.rstrip())
    wide = max(map(len, lines), default=0)
    if not whole:
        return deque(lines), wide
    first.rows.extendleft(reversed(lines))
    return first.rows, max(wide, first.wide)


def _table(rows: list[list[tuple[int, int, Block]]]) -> Block:
    """Cells (first column, columns, block) aligned by column, two spaces apart; a cell of several lines takes several lines.

    Only columns in which some cell starts take room. Work and result stay in proportion to the text (see BLOAT).
    """
    starts = sorted({at for row in rows for at, _, _ in row})
    need: dict[tuple[int, int], int] = {}
    places = [[(bisect_left(starts, at), bisect_left(starts, at + wide), block) for at, wide, block in row] for row in rows]
    for a, b, block in (c for row in places for c in row):
        need[a, b] = max(need.get((a, b), 0), block.wide)
    width = [0] * len(starts)
    for (a, b), wide in sorted(need.items(), key=lambda x: x[0][1] - x[0][0]):
        width[b - 1] = max(width[b - 1], wide - 2 * (b - a - 1) - sum(width[a : b - 1]))
    left = [0, *accumulate(w + 2 for w in width)]
    cells = [block for row in places for _, _, block in row]
    raw = sum(block.raw + CELL_CHARS for block in cells)
    chars = sum(block.chars + left[a] * max(len(block.rows), 1) for row in places for a, _, block in row)
    out: deque[str] = deque()
    longest = 0
    if chars <= BLOAT * raw:
        for row in places:
            lines, wide = _row([(left[a], block) for a, _, block in row])
            out, longest = _after(out, lines), max(longest, wide)
        return Block(out, chars, longest, raw)
    for row in places:
        short: list[str] = []
        for _, _, block in (*row, (0, 0, None)):
            if block is not None and len(block.rows) < 2:
                short += block.rows
                continue
            if short:
                out.append("  ".join(short))
                longest, short = max(longest, len(out[-1])), []
            if block is not None:
                longest = max(longest, block.wide)
                out = _after(out, block.rows)
    return Block(out, sum(block.chars + 2 for block in cells), longest, raw)


def _cells(table: Node) -> tuple[list[Node], list[list[list[Node]]]]:
    """Captions, and rows of cells by row group: header groups first and footer groups last, as they are laid out."""
    captions, parts = [], {"thead": [], "tbody": [], "tfoot": []}
    loose: list[list[Node]] | None = None
    for child in table.children:
        if isinstance(child, str) or not _visible(child):
            continue
        if child.tag == "tr":
            if loose is None:
                parts["tbody"].append(loose := [])
            loose.append(_cells_of(child))
        elif child.tag in parts:
            parts[child.tag].append([_cells_of(r) for r in child.children if not isinstance(r, str) and r.tag == "tr" and _visible(r)])
            loose = None
        elif child.tag not in ("col", "colgroup"):
            captions.append(child)
    return captions, parts["thead"] + parts["tbody"] + parts["tfoot"]


def _cells_of(tr: Node) -> list[Node]:
    return [c for c in tr.children if not isinstance(c, str) and c.tag in ("td", "th") and _visible(c)]


def _tables(root: Node) -> list[tuple[Node, bool]]:
    """All tables that are laid out, each after those it stands in, with the visibility they inherit."""
    found, todo = [], [(root, True)]
    while todo:
        node, seen = todo.pop()
        seen = _seen(node, seen)
        if node.tag == "table" and node is not root:
            found.append((node, seen))
        todo += [(c, seen) for c in node.children if not isinstance(c, str) and _visible(c)]
    return found


def render(root: Node) -> str:
    """All visible text below a node. Tables are laid out from the innermost to the outermost, so no nesting costs recursion."""
    done: dict[int, Block] = {}
    for table, seen in reversed(_tables(root)):
        captions, groups = _cells(table)
        inherited = {}
        for part in (c for c in table.children if not isinstance(c, str)):
            own = _seen(part, seen)
            for row in [part] if part.tag == "tr" else (r for r in part.children if not isinstance(r, str)):
                inherited |= dict.fromkeys(map(id, row.children), own if row is part else _seen(row, own))
        lines = Lines()
        for c in captions:
            if (shown := _flow(c, seen, done)).rows:
                lines.insert(shown)
                lines.gap(1)
        grid = _table([[(at, wide, _flow(c, inherited[id(c)], done, True)) for at, wide, c in row] for row in _grid(groups)])
        while grid.rows and not grid.rows[0]:
            grid.rows.popleft()
        while grid.rows and not grid.rows[-1]:
            grid.rows.pop()
        if grid.rows:
            lines.insert(grid)
        done[id(table)] = lines.block()
    return "\n".join(_flow(root, True, done).rows)


def _ordinal(text: str | None) -> int | None:
    return int(text) if re.fullmatch(r"\s*[+-]?\d{1,9}\s*", text or "") else None


def _numbers(item: Node) -> list:
    """A list's name, first number and step."""
    back = item.tag == "ol" and "reversed" in item.attributes
    first = _ordinal(item.attributes.get("start"))
    if first is None:
        first = sum(not isinstance(c, str) and c.tag == "li" for c in item.children) if back else 1
    return [item.tag, first, -1 if back else 1]


def _flow(node: Node, seen: bool, done: dict[int, Block], trim: bool = False) -> Block:
    """The text of a node in lines; ``done`` has the tables within it. ``trim`` drops spaces at the ends of lines."""
    lines = Lines(trim)
    todo: list[tuple] = [("in", node, False, seen)]
    lists: list[list] = []
    while todo:
        what, item, pre, seen = todo.pop()
        if what == "text":
            if seen:
                lines.add(item, pre)
        elif what == "out":
            if item.tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                lines.indent = "  " * min(len(lists), INDENTED)
            if item.tag == "li":
                lines.prefix = ""
            if item.tag in BLOCK:
                lines.gap(2 if item.tag in SPACED and not lists else 1)
        elif item is not node and not _visible(item):
            continue
        elif item.tag == "br":
            lines.gap(min(lines.wish + 1, 2) if lines.wish else 1)
        elif item.tag == "table" and item is not node:
            lines.gap(2)
            if done[id(item)].rows:
                lines.insert(done[id(item)])
            lines.gap(2)
        elif item.tag == "svg":
            todo += [("in", x, pre, _seen(item, seen)) for x in reversed(_drawn(item))]
        else:
            seen = _seen(item, seen)
            if item.tag in BLOCK:
                lines.gap(2 if item.tag in SPACED and not lists else 1)
            if item.tag in ("ul", "ol", "menu", "dir"):
                lists.append(_numbers(item))
            elif item.tag == "li":
                kind = lists[-1] if lists else ["ul", 1, 1]
                own = _ordinal(item.attributes.get("value"))
                kind[1] = kind[1] if own is None else own
                bullet = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += kind[2]
                depth = min(max(len(lists) - 1, 0), INDENTED - 1)
                lines.prefix, lines.indent = "  " * depth + bullet, "  " * (depth + 1)
            elif item.tag in ("td", "th") and item is not node:
                lines.add(" ")
            todo.append(("out", item, pre, seen))
            below = pre or item.tag in KEEPS_SPACE
            shut = item.tag == "details" and "open" not in item.attributes
            for child in reversed(item.children):
                if isinstance(child, str):
                    if not shut:
                        todo.append(("text", child, below, seen))
                elif not shut or child.tag == "summary":
                    todo.append(("in", child, below, seen))
    return lines.block()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [render(tree(page)) if page else "" for page in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "t"])


def visible_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col, text, n_chars, n_lines``: the text that a reader of the page would see, a row for each page.

    Null or empty pages give empty text. Rows are independent: repeated rows and null ids pass through. Markup
    that never ends, unknown tags and stray end tags are read as browsers do in spirit: nothing visible is lost.
    Visibility comes from elements and their attributes; style sheets aren't read, so what only a ``<style>`` rule
    hides is shown. A wide character counts as one. Work and text stay in proportion to the page: tables and lists
    that nest or span so far that their alignment would outgrow their text are shown without it.
    """
    base = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("h"))
    kind = pages.schema[id_col].dataType.simpleString()
    out = base.mapInArrow(_extract, f"id {kind}, t string")
    lines = F.when(F.length("t") > 0, F.size(F.split("t", "\n", -1))).otherwise(0).cast("long")
    return out.select(F.col("id").alias(id_col), F.col("t").alias("text"), F.length("t").cast("long").alias("n_chars"), lines.alias("n_lines"))


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return visible_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
