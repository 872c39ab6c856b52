"""Oversized texts and page ranges cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 3600
OVERLAP = 200
#: New characters of a piece, at least and at most (the rest is overlap), unless the text ends first.
LEAST = 1200
#: A landmark is where the rolling hash of WINDOW characters is 0 modulo EVERY; it snaps up to SNAP characters away.
WINDOW, EVERY, SNAP = 32, 512, 400
#: Natural boundaries, strongest first, as patterns whose ends are places to cut.
BOUNDARIES = (
    ("paragraph", re.compile(r"\n[ \t]*\n\s*")),
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[”’」』）]*")),
    ("clause", re.compile(r"[,;:]\s+|[，；：、]")),
    ("word", re.compile(r"\s+")),
)
_JOINS = {0x200D, 0xFE0F, 0xFE0E}


def landmarks(text: str) -> np.ndarray:
    """Offsets after which the rolling hash of the last WINDOW characters hits, whatever stands before those."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if len(codes) < WINDOW:
        return np.empty(0, np.int64)
    codes = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    codes ^= codes >> np.uint64(29)
    rolled = np.zeros(len(codes) - WINDOW + 1, np.uint64)
    for i in range(WINDOW):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + codes[i : len(codes) - WINDOW + 1 + i]
    rolled ^= rolled >> np.uint64(32)
    return np.flatnonzero(rolled % np.uint64(EVERY) == 0) + WINDOW


def _whole(text: str, cut: int, least: int) -> int:
    """cut, or the next place before it that doesn't part a character from its marks."""
    at = cut
    while at > least and (0x300 <= ord(text[at]) < 0x370 or ord(text[at]) in _JOINS or ord(text[at - 1]) == 0x200D):
        at -= 1
    return at if at > least else cut


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, str]]:
    """(offset, kind of boundary) of each cut, the last at the end of the text.

    From the cut before, the first landmark between the least and the most is taken and moved to the nearest natural
    boundary of the strongest kind within reach. Without landmark the last boundary before the most is taken, and
    without boundary the text is cut there between two characters. As landmarks depend on nothing but the characters
    just before them, cuts fall into step again soon after an edit.
    """
    if len(text) <= limit:
        return [(len(text), "end")]
    most = limit - overlap
    least = min(least, most)
    places = [(kind, [m.end() for m in pattern.finditer(text)]) for kind, pattern in BOUNDARIES]
    marks, out, at = landmarks(text).tolist(), [], 0
    while len(text) - at > (most if out else limit):
        low, high = at + least, at + most
        i = bisect_left(marks, low)
        found = marks[i] if i < len(marks) and marks[i] <= high else None
        best = None
        for kind, ends in places:
            if found is None:
                j = bisect_right(ends, high) - 1
                if j >= 0 and ends[j] >= low:
                    best = (ends[j], kind)
            else:
                near = ends[bisect_left(ends, max(low, found - SNAP)) : bisect_right(ends, min(high, found + SNAP))]
                if near:
                    best = (min(near, key=lambda e: (abs(e - found), e)), kind)
            if best:
                break
        if best is None:
            best = (_whole(text, found or high, low), "none")
        out.append(best)
        at = best[0]
    out.append((len(text), "end"))
    return out


PIECE = "piece int, pieces int, first_char int, last_char int, boundary string, piece_text string"


def split_texts(df: DataFrame, key: str, text_col: str, *also: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(key, *also, piece, pieces, first_char, last_char, boundary, piece_text) of every text longer than limit.

    Each piece but the first repeats the last `overlap` characters of the one before, none is longer than limit, and
    the pieces without their overlap give the text back. Only oversized texts leave the JVM; nothing is shuffled.
    Null, empty and short texts give no row; repeated rows are cut alike; the columns of also (such as pages) are
    kept on each piece; others aren't read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    text = F.col(text_col).cast("string")
    src = df.where(F.length(text) > limit).select(key, *also, text.alias("text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.drop("text").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, own = [], []
            for i, body in enumerate(batch.column("text").to_pylist()):
                ends, at = cuts(body, limit, overlap, least), 0
                for piece, (end, kind) in enumerate(ends):
                    first = max(0, at - overlap)
                    rows.append((piece, len(ends), first, end, kind, body[first:end]))
                    own.append(i)
                    at = end
            kept = batch.drop_columns(["text"]).take(pa.array(own, pa.int32()))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *cols], [*kept.schema.names, *(x.split()[0] for x in PIECE.split(", "))])

    return src.mapInArrow(run, f"{fields}, {PIECE}")


MOST_PAGES = 20
#: A number above this names no page, whatever stands beside it.
LAST_PAGE = 999_999
#: Pages named by a range: a number, and another after a dash of any kind, dots, a tilde or a word for `to`.
RANGE = r"(?i)(\d+)(?:\s*(?:[-‐-―−~～〜]|\.{2,3}|…|to|bis|à|a|до|至|到)\s*(?:p\.?\s*)?(\d+))?"


def page_spans(page_range: Column) -> Column:
    """Sorted spans (first, last) of the pages a free-text range names, those that meet or overlap joined; a span with a
    number above LAST_PAGE names none."""
    # a number too long for BIGINT counts as one beyond LAST_PAGE
    number = lambda x: F.coalesce(x.try_cast("bigint"), F.lit(LAST_PAGE + 1))
    digits = F.translate(page_range, "０１２３４５６７８９", "0123456789")
    first = F.transform(F.regexp_extract_all(digits, F.lit(RANGE), F.lit(1)), number)
    last = F.transform(F.regexp_extract_all(digits, F.lit(RANGE), F.lit(2)), lambda x: F.when(x != "", number(x)))
    spans = F.zip_with(first, last, lambda a, b: F.struct(F.least(a, b).alias("first"), F.greatest(a, b).alias("last")))
    ordered = F.array_sort(F.filter(spans, lambda s: s["last"].between(1, LAST_PAGE)))
    kind = "array<struct<first:bigint,last:bigint>>"

    def join(done: Column, s: Column) -> Column:
        end = F.get(done, F.size(done) - 1)
        longer = F.struct(end["first"].alias("first"), F.greatest(end["last"], s["last"]).alias("last"))
        meets = (F.size(done) > 0) & (s["first"] <= end["last"] + 1)
        return F.when(meets, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer)).cast(kind)).otherwise(F.concat(done, F.array(s)).cast(kind))

    return F.aggregate(F.coalesce(ordered, F.array().cast(kind)), F.array().cast(kind), join)


def split_ranges(df: DataFrame, key: str, range_col: str, most: int = MOST_PAGES) -> DataFrame:
    """(key, pages, piece, first_page, last_page) of every range that covers more than `most` pages in all.

    Each span is cut into sub-ranges of at most `most` pages that repeat the last page of the one before. Null, empty
    and useless ranges give no row; pages named twice count once; spans written backwards are turned round.
    """
    spans = df.select(key, page_spans(F.col(range_col).cast("string")).alias("spans"))
    pages = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    step = most - 1
    starts = lambda s: F.sequence(s["first"], F.greatest(s["first"], s["last"] - 1), F.lit(step).cast("bigint"))
    parts = F.flatten(F.transform("spans", lambda s: F.transform(starts(s), lambda p: F.struct(p.alias("first_page"), F.least(p + step, s["last"]).alias("last_page")))))
    long = spans.withColumn("pages", pages).where(F.col("pages") > most)
    return long.select(key, "pages", F.posexplode(parts)).select(key, "pages", F.col("pos").alias("piece"), "col.first_page", "col.last_page")
