"""HTML documents as content blocks, and HTML tables inside texts as grids.

A tree parser is what SQL lacks here, so pages go through Arrow batches in the tasks of the scan; nothing is shuffled.
The tree has no implied end tags: an element that isn't closed holds what follows it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by what becomes of them.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"script", "style", "noscript"}
PARAGRAPHS = {"p", "blockquote", "figcaption"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}
LINE_BREAKS = {"p", "div", "section", "article", "tr", "h1", "h2", "h3"}
TABLE = re.compile(r"<table\b.*?</table>", re.I | re.S)


def inline(text: str) -> str:
    return re.sub(r"\s+", " ", unescape(text)).strip()


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str | None]) -> None:
        self.name, self.attrs, self.children = name, attrs, []

    def find_all(self, names: set[str]) -> list[Node]:
        found, stack = [], list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, Node):
                if node.name in names:
                    found.append(node)
                stack.extend(reversed(node.children))
        return found

    def text(self) -> str:
        """The stripped pieces of text inside, joined by spaces."""
        pieces, stack = [], list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                if node.strip():
                    pieces.append(node.strip())
            else:
                stack.extend(reversed(node.children))
        return " ".join(pieces)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.dropped = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in DROPPED:
            self.dropped += 1
        if self.dropped:
            return
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.open[-1].children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def pipe_table(rows: list[list[str]]) -> str:
    """Rows as a pipe table, the first as its header; short rows are filled up, bars escaped."""
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(c.replace("|", "\\|").strip() for c in [*row, *[""] * (width - len(row))]) + " |" for row in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def _header_first(rows: list[list[str]], header: int | None) -> list[list[str]]:
    header = header or 0
    return [rows[header], *rows[:header], *rows[header + 1 :]] if rows else []


def table_rows(table: Node) -> list[list[str]]:
    """Cell texts of each row that isn't empty, header row first; spans aren't followed."""
    rows, header = [], None
    for tr in table.find_all({"tr"}):
        cells = [c for c in tr.children if isinstance(c, Node) and c.name in ("th", "td")] or tr.find_all({"th", "td"})
        row = [inline(c.text()) for c in cells]
        if any(row):
            if header is None and tr.find_all({"th"}):
                header = len(rows)
            rows.append(row)
    return _header_first(rows, header)


def _span(cell: Node, name: str) -> int:
    try:
        return max(1, int(cell.attrs.get(name) or 1))
    except ValueError:
        return 1


#: Columns a cell may span by the HTML standard; larger values count as 1, as browsers take them.
MOST_COLUMNS = 1000


def table_grid(table: Node) -> tuple[list[list[str]], list[tuple[int, int, str, str]]]:
    """(rows, header first, with spans spread over the cells they cover; (row, column, value, kind) of those cells).

    The standard's forming of tables: every cell takes the first free slots of its row, and claims the slots below that
    its rowspan covers. Slots are kept as {(row, column): (value, kind)}; kind is null where the cell itself stands. A
    claim that reaches beyond the last row ends there.
    """
    trs = table.find_all({"tr"})
    slots: dict[tuple[int, int], tuple[str, str | None]] = {}
    headed = []
    for at, tr in enumerate(trs):
        column = 0
        for cell in tr.find_all({"th", "td"}):
            while (at, column) in slots:
                column += 1
            value, wide = inline(cell.text()), _span(cell, "colspan")
            wide = wide if wide <= MOST_COLUMNS else 1
            for y in range(at, min(at + _span(cell, "rowspan"), len(trs))):
                for x in range(column, column + wide):
                    slots.setdefault((y, x), (value, "rowspan" if y > at else "colspan" if x > column else None))
            column += wide
        headed.append(bool(tr.find_all({"th"})))
    widths = [0] * len(trs)
    for y, x in slots:
        widths[y] = max(widths[y], x + 1)
    grid = [[slots.get((y, x), ("", None))[0] for x in range(widths[y])] for y in range(len(trs))]
    merged = sorted((y, x, value, kind) for (y, x), (value, kind) in slots.items() if kind)
    kept = [y for y, row in enumerate(grid) if any(row)]
    header = next((i for i, y in enumerate(kept) if headed[y]), None)
    width = max((widths[y] for y in kept), default=0)
    return _header_first([[*grid[y], *[""] * (width - widths[y])] for y in kept], header), merged


def html_blocks(html: str) -> list[tuple[str, str, int | None]]:
    """(type, text, level) of the blocks of a page: headings, tables, paragraphs and list items; other text is passed
    over, and a block that repeats the one before is dropped."""
    root = parse(html)
    body = next(iter(root.find_all({"body"})), root)
    out: list[tuple[str, str, int | None]] = []
    stack = list(reversed(body.children))
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            continue
        level = HEADINGS.get(node.name)
        if level:
            kind, text = "heading", inline(f"{'#' * level} {node.text()}")
        elif node.name == "table":
            kind, text = "table", "\n".join(filter(None, map(inline, pipe_table(table_rows(node)).split("\n"))))
        elif node.name in PARAGRAPHS:
            kind, text = "text", inline(node.text())
        elif node.name == "li":
            kind, text = "list_item", inline(f"- {node.text()}")
        else:
            stack.extend(reversed(node.children))
            continue
        if text and not (out and out[-1][1] == text):
            out.append((kind, text, level))
    return out


def flat_text(html: str) -> tuple[str, list[tuple[str, str]]]:
    """(text of the page with block elements as line breaks, (text, href) of its links)."""
    root, parts, links = parse(html), [], []

    def walk(node: Node, href: str | None) -> None:
        for child in node.children:
            if isinstance(child, str):
                if child.strip():
                    parts.append(child.strip() + " ")
                    if href:
                        links.append((child.strip(), href))
            else:
                if child.name in LINE_BREAKS or child.name == "br":
                    parts.append("\n")
                walk(child, child.attrs.get("href") if child.name == "a" else href)
                if child.name in LINE_BREAKS:
                    parts.append("\n")

    walk(root, None)
    return re.sub(r"\n{3,}", "\n\n", "".join(parts)).strip(), links


def _mapped(df: DataFrame, key: str, html_col: str, ddl: str, rows_of) -> DataFrame:
    src = df.select(F.col(key).alias("doc_id"), F.col(html_col).cast("string").alias("html")).where("html is not null")
    kind = src.schema["doc_id"].dataType.simpleString()
    fields = [f.split() for f in ddl.split(", ")]
    types = {"int": pa.int32(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, own = [], []
            for i, html in enumerate(batch.column(1).to_pylist()):
                found = rows_of(html)
                rows += found
                own += [i] * len(found)
            cols = [pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int32())), *cols], ["doc_id", *(n for n, _ in fields)])

    return src.mapInArrow(run, f"doc_id {kind}, {ddl}")


def read_html_blocks(df: DataFrame, key: str = "doc_id", html_col: str = "html") -> DataFrame:
    """(doc_id, block_idx, type, text, level) of every page; null pages give no row."""
    return _mapped(df, key, html_col, "block_idx int, type string, text string, level int", lambda h: [(i, *b) for i, b in enumerate(html_blocks(h))])


def html_tables(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, table_index, start_line, row_index, column_index, value) of the HTML tables inside texts, spans spread,
    header first."""

    def rows(text: str) -> list[tuple]:
        out = []
        for t, found in enumerate(TABLE.finditer(text)):
            grid, _ = table_grid(parse(found.group()))
            line = text.count("\n", 0, found.start()) + 1
            out += [(t, line, r, c, value) for r, row in enumerate(grid) for c, value in enumerate(row)]
        return out

    held = df.where(F.col(text_col).contains("<table") | F.lower(F.col(text_col)).contains("<table"))
    return _mapped(held, key, text_col, "table_index int, start_line int, row_index int, column_index int, value string", rows)


def html_links(df: DataFrame, key: str = "doc_id", html_col: str = "html") -> DataFrame:
    """(doc_id, link_no, text, href) of the links of every page."""
    return _mapped(df, key, html_col, "link_no int, text string, href string", lambda h: [(i, *x) for i, x in enumerate(flat_text(h)[1])])
