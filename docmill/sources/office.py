"""Word and PowerPoint files as content blocks, read from their XML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.sources.html import inline, pipe_table

# Name spaces of the two formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"

Block = tuple[str, str, int | None, int | None]  # type, text, level, page_idx


def _texts(node: ElementTree.Element, ns: str) -> list[str]:
    return [t.text for t in node.iter(f"{ns}t") if t.text]


def _grid(table: ElementTree.Element, ns: str) -> list[list[str]]:
    rows = [[inline(" ".join(_texts(cell, ns))) for cell in row.iter(f"{ns}tc")] for row in table.iter(f"{ns}tr")]
    return [row for row in rows if any(row)]


def _level(paragraph: ElementTree.Element) -> int | None:
    style = paragraph.find(f"{W}pPr/{W}pStyle")
    name = style.get(f"{W}val", "") if style is not None else ""
    if name.lower() == "title":
        return 1
    found = re.fullmatch(r"heading\s*(\d+)", name.lower())
    return min(6, max(1, int(found.group(1)))) if found else None


def docx_blocks(content: bytes) -> list[Block]:
    """Paragraphs, headings by style and tables of a Word file, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{W}body")
    out: list[Block] = []
    for child in body if body is not None else ():
        if child.tag == f"{W}p":
            text, level = inline("".join(_texts(child, W))), _level(child)
            if text:
                out.append(("heading", f"{'#' * level} {text}", level, None) if level else ("text", text, None, None))
        elif child.tag == f"{W}tbl" and (rows := _grid(child, W)):
            out.append(("table", pipe_table(rows), None, None))
    return out


def pptx_blocks(content: bytes) -> list[Block]:
    """Of each slide, in order of its number: a heading, its text without what its tables hold, and its tables."""
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        found = (re.fullmatch(r"ppt/slides/slide(\d+)\.xml", name) for name in archive.namelist())
        slides = sorted((int(m.group(1)), m.group()) for m in found if m)
        for page, (_, name) in enumerate(slides):
            root = ElementTree.fromstring(archive.read(name))
            grids = list(root.iter(f"{A}tbl"))
            held = {inline(t) for g in grids for t in _texts(g, A)}
            out.append(("heading", f"# Slide {page + 1}", 1, page))
            lines = [inline(t) for p in root.iter(f"{A}p") if (t := "".join(_texts(p, A))) and inline(t) and inline(t) not in held]
            if lines:
                out.append(("text", "\n".join(lines), None, page))
            out += [("table", pipe_table(rows), None, page) for g in grids if (rows := _grid(g, A))]
    return out


READERS = {"docx": docx_blocks, "pptx": pptx_blocks}


def read_office_blocks(files: DataFrame) -> DataFrame:
    """(path, block_idx, type, text, level, page_idx, error) of files (path, content), as the binaryFile reader gives
    them. A file that can't be read gives one row with its error and no block; others than docx and pptx give none."""
    src = files.select("path", "content", F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("suffix")).where(F.col("suffix").isin(*READERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content, suffix in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows += [(path, i, *block, None) for i, block in enumerate(READERS[suffix](content))]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, TypeError) as error:
                    rows.append((path, None, None, None, None, None, f"{type(error).__name__}: {error}"[:300]))
            types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            names = ["path", "block_idx", "type", "text", "level", "page_idx", "error"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return src.mapInArrow(run, "path string, block_idx int, type string, text string, level int, page_idx int, error string")
