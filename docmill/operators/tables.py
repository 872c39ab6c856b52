"""Pipe tables in texts: islands of table rows, their cells, filled-down blanks, header levels, and checks of totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions.patterns import NUMBER, TABLE_ROW, TOTAL_WORDS
from docmill.functions.rows import each
from docmill.operators.documents import with_lines


def islands(flags: Column) -> Column:
    """(first, n) of each maximal run of true values."""
    at = lambda i: F.coalesce(F.get(flags, i), F.lit(False))
    spots = F.sequence(F.lit(0), F.greatest(F.size(flags) - 1, F.lit(0)))
    starts = F.filter(spots, lambda i: at(i) & ~at(i - 1))
    ends = F.filter(spots, lambda i: at(i) & ~at(i + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("n")))


def table_count(lines: Column) -> Column:
    """How many tables a document's lines hold, counted inside the row."""
    flags = F.transform(lines, lambda x: x.contains("|") & x.rlike(TABLE_ROW))
    counted = T.bind(flags, lambda f: F.size(F.filter(islands(f), lambda r: r["n"] >= 2)))
    return F.when(F.exists(lines, lambda x: x.contains("|")), counted).otherwise(0)


def cells_of(line: Column) -> Column:
    """Cells of a table row; a bar always parts cells, even an escaped one."""
    return F.transform(F.split(F.btrim(T.strip(line), F.lit("|")), r"\|"), T.strip)


def is_separator(cells: Column) -> Column:
    return F.forall(cells, lambda c: c.rlike("^[-: ]*$"))


def raw_tables(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, table_index, start_line, raw ARRAY<ARRAY<STRING>>): two table lines or more in a row make a table.

    raw are the cells of its lines without separator lines.
    """
    barred = with_lines(df, key, text_col).where(F.col("text").contains("|"))
    found = barred.withColumn("flags", F.transform("lines", lambda x: x.rlike(TABLE_ROW))).withColumn("runs", F.filter(islands(F.col("flags")), lambda r: r["n"] >= 2))
    spans = each(found, ["doc_id", "lines"], "runs")
    rows = F.filter(F.transform(F.slice("lines", F.col("col.first") + 1, F.col("col.n")), cells_of), lambda c: ~is_separator(c))
    return spans.select("doc_id", F.col("pos").alias("table_index"), (F.col("col.first") + 1).alias("start_line"), rows.alias("raw"))


def padded(rows: Column, width: Column) -> Column:
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def filled_down(rows: Column) -> Column:
    """From the third row on an empty cell takes the (filled) one above; the first row is never a source."""
    fill = lambda above, row: F.zip_with(above, row, lambda a, c: F.when(c == "", a).otherwise(c))
    last = lambda done: F.get(done, F.size(done) - 1)
    return F.aggregate(F.slice(rows, F.lit(3), F.greatest(F.size(rows) - 2, F.lit(0))), F.slice(rows, 1, 2), lambda done, row: F.concat(done, F.array(fill(last(done), row))))


def _has_number(cell: Column) -> Column:
    return cell.rlike(NUMBER)


def tables(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, table_index, start_line, headers, body, row_count, column_count, header_levels, filled, raw_body).

    A second row without numbers above rows that hold as many numbers as there are rows is a second header level;
    levels are joined by ` / `. A table of separators only has no headers, no rows and 0 columns.
    """
    raw = raw_tables(df, key, text_col).withColumn("column_count", F.coalesce(F.array_max(F.transform("raw", F.size)), F.lit(0)))
    raw = raw.withColumn("padded", padded(F.col("raw"), F.col("column_count"))).withColumn("filled", filled_down(F.col("padded")))
    second = F.filter(F.coalesce(F.get("filled", F.lit(1)), F.array().cast("array<string>")), lambda c: c != "")
    later = F.slice("filled", F.lit(3), F.greatest(F.size("filled") - 2, F.lit(0)))
    numeric = F.aggregate(later, F.lit(0), lambda n, row: n + F.size(F.filter(row, _has_number)))
    two = (F.size("filled") >= 3) & (F.size(second) > 0) & ~F.exists(second, _has_number) & (numeric >= F.size(later))
    raw = raw.withColumn("header_levels", F.when(F.size("filled") == 0, F.lit(0)).when(two, F.lit(2)).otherwise(F.lit(1)))
    first, under = F.get("filled", F.lit(0)), F.get("filled", F.lit(1))
    both = F.zip_with(first, under, lambda a, b: F.array_join(F.array_distinct(F.filter(F.array(a, b), lambda x: x != "")), " / "))
    headers = F.when(F.col("header_levels") == 2, both).otherwise(F.coalesce(first, F.array().cast("array<string>")))
    rest = lambda name, n: F.slice(name, n + 1, F.greatest(F.size(name) - n, F.lit(0)))
    body = rest("filled", F.col("header_levels"))
    return raw.select(
        "doc_id", "table_index", "start_line", headers.alias("headers"), body.alias("body"), F.size(body).alias("row_count"),
        "column_count", "header_levels", "filled", "padded", rest("raw", F.lit(1)).alias("raw_body"),
    )


def table_cells(tables: DataFrame) -> DataFrame:
    """(doc_id, table_index, row_index, column_index, value): a row for each cell of the body, indices from 0."""
    rows = each(tables, ["doc_id", "table_index"], "body", "row_index", "row")
    return each(rows, ["doc_id", "table_index", "row_index"], "row", "column_index", "value")


def merged_cells(tables: DataFrame) -> DataFrame:
    """(doc_id, table_index, row_index, column_index, value) of each cell that took its value from above; row 0 is the
    header."""
    pairs = F.zip_with("padded", "filled", lambda a, b: F.zip_with(a, b, lambda x, y: F.when((x == "") & (y != ""), y)))
    rows = each(tables, ["doc_id", "table_index"], pairs, "row_index", "row")
    flat = each(rows, ["doc_id", "table_index", "row_index"], "row", "column_index", "value")
    return flat.where("value is not null")


def is_total(row: Column) -> Column:
    joined = F.lower(F.array_join(row, " "))
    return F.exists(F.array(*[F.lit(w) for w in TOTAL_WORDS]), lambda w: joined.contains(w))



def total_checks(tables: DataFrame) -> DataFrame:
    """(doc_id, table_index, row_index, column_index, expected, computed, value_count, outcome) for each numeric cell of
    a total row.

    The cell is held against the sum of the same column over all rows before that aren't total rows. With fewer than two
    numbers there it is `uncompared`; else `verified` within a millionth of it (0.01 at least, 1 at most) or `mismatch`.
    Rows of a table are folded in place with running sums of its columns, without shuffle. Tables without total are left
    out inside the expression: a filter on what was computed would be pushed below its projections and compute it all again.
    """
    marked = F.transform("body", lambda r, i: F.struct(i.alias("row_index"), is_total(r).alias("total"), F.transform(r, T.cell_number).alias("numbers")))
    rows = tables.select("doc_id", "table_index", "column_count", F.when(F.exists("body", is_total), marked).alias("rows"))
    sums, cells = "array<struct<sum:double,n:int>>", "array<struct<row_index:int,numbers:array<double>,sums:" + "array<struct<sum:double,n:int>>>>"
    none = F.array_repeat(F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), F.col("column_count")).cast(sums)
    start = F.struct(none.alias("sums"), F.array().cast(cells).alias("totals"))

    def step(s: Column, r: Column) -> Column:
        grown = F.zip_with(s["sums"], r["numbers"], lambda t, v: F.struct((t["sum"] + F.coalesce(v, F.lit(0.0))).alias("sum"), (t["n"] + v.isNotNull().cast("int")).alias("n")))
        total = F.struct(r["row_index"].alias("row_index"), r["numbers"].alias("numbers"), s["sums"].alias("sums"))
        return F.when(r["total"], F.struct(s["sums"].alias("sums"), F.concat(s["totals"], F.array(total)).cast(cells).alias("totals"))).otherwise(
            F.struct(grown.cast(sums).alias("sums"), s["totals"].alias("totals"))
        )

    totals = each(rows, ["doc_id", "table_index"], F.aggregate("rows", start, step, lambda s: s["totals"]), "at", "total")
    held = each(totals, ["doc_id", "table_index", "total.row_index"], F.arrays_zip("total.numbers", "total.sums"), "column_index", "cell")
    expected, computed, n = F.col("cell.numbers"), F.col("cell.sums.sum"), F.col("cell.sums.n")
    tolerance = F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.abs(expected) * 0.000001))
    outcome = F.when(n < 2, "uncompared").when(F.abs(computed - expected) <= tolerance, "verified").otherwise("mismatch")
    checks = held.select("doc_id", "table_index", "row_index", "column_index", expected.alias("expected"), computed.alias("computed"), n.alias("value_count"), outcome.alias("outcome"))
    return checks.where("expected is not null")


def total_issues(checks: DataFrame) -> DataFrame:
    """(doc_id, table_index, row_index, code, level): what the checks of a total row add up to."""
    n = lambda kind: F.count_if(F.col("outcome") == kind)
    rows = checks.groupBy("doc_id", "table_index", "row_index").agg(n("mismatch").alias("bad"), n("verified").alias("good"))
    code = F.when(F.col("bad") > 0, "numeric_total_mismatch").when(F.col("good") > 0, "numeric_total_verified").otherwise("numeric_total_needs_review")
    return rows.select("doc_id", "table_index", "row_index", code.alias("code"), F.when((F.col("bad") == 0) & (F.col("good") > 0), "info").otherwise("warning").alias("level"))
