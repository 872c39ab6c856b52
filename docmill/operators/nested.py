"""Deeply nested JSON records turned into flat, related tables.

Records are schema-on-read: lists may be single objects, objects may be kept as JSON text, records may be wrapped, and
fields come and go. Everything is one projection per table: nested transforms attach the ancestors' keys and places,
flatten joins the arrays of arrays, and one inline per target table emits its rows. No shuffle, no Python.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.rows import each_struct

#: A number as text: digits with a fraction, and one with an exponent.
PLAIN_NUMBER = r"^[+-]?\d+(\.0*)?$"
SCALED_NUMBER = r"^([+-]?)(\d*)\.?(\d*)[eE]([+-]?\d{1,9})$"
#: Digits of the longest BIGINT.
LONGEST_WHOLE = 19
OPEN_OBJECT = "map<string,variant>"
OPEN_LIST = "array<variant>"

#: White space that JSON allows around a document, and the byte-order mark.
AROUND = " \t\r\n\ufeff"


def bind(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda's variable is not computed again at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def listed(text: Column) -> Column:
    """VARIANT of a list of the JSON value in text and 0. As the parser stops after the first value, what follows the
    value in text shows in the list, or as an error."""
    return F.try_parse_json(F.concat(F.lit("["), F.btrim(text, F.lit(AROUND)), F.lit(",0]")))


def sole_value(pair: Column) -> Column:
    """The value of a list made by listed; null if anything followed it."""
    get = F.try_variant_get
    return F.when((get(pair, "$[1]", "int") == 0) & get(pair, "$[2]", "string").isNull(), get(pair, "$[0]", "variant"))


def text_of(value: Column) -> Column:
    """Text of a VARIANT: a string as it is, anything else as JSON; null for null."""
    return F.try_variant_get(value, "$", "string")


def _held(value: Column) -> Column:
    """The value that a VARIANT's text holds. Texts are rare, and so parsed at each mention rather than bound, which
    would nest another lambda around everything."""
    return sole_value(listed(text_of(value)))


def as_object(value: Column) -> Column:
    """Fields by name of a VARIANT that is an object, or text that holds one; null for anything else."""
    fields = lambda v: F.try_variant_get(v, "$", OPEN_OBJECT)
    return F.coalesce(fields(value), fields(_held(value)))


def as_list(value: Column) -> Column:
    """Items of a VARIANT that is a list (null items stay, so that positions hold); an object counts as a list of one,
    and text as what it holds; empty for anything else."""
    items = lambda v: F.try_variant_get(v, "$", OPEN_LIST)
    fields = lambda v: F.try_variant_get(v, "$", OPEN_OBJECT)
    one = F.when(fields(value).isNotNull() | fields(_held(value)).isNotNull(), F.array(value))
    return F.coalesce(items(value), items(_held(value)), one, F.array().cast(OPEN_LIST))


def field_of(obj: Column, name: str) -> Column:
    return F.try_element_at(obj, F.lit(name))


def whole_number(text: Column) -> Column:
    """BIGINT of a whole number written as 12, 12.0 or 1.2e1; null for anything else, and for what BIGINT can't hold.

    The digits decide, none is rounded off."""
    bare = F.btrim(text, F.lit(AROUND))
    plain = F.regexp_replace(bare, r"\.0*$", "").try_cast("bigint")
    part = lambda i: F.regexp_extract(bare, SCALED_NUMBER, i)

    def moved(p: Column) -> Column:
        digits, point = p["digits"], p["point"]
        before = F.when(point <= 0, F.lit("0")).otherwise(F.rpad(F.substring(digits, F.lit(1), point), point, F.lit("0")))
        zero = F.rtrim(digits, F.lit("0")) == ""
        after = F.when(point <= 0, digits).otherwise(F.substring(digits, point + 1, F.length(digits)))
        fits = (point <= LONGEST_WHOLE) & (F.rtrim(after, F.lit("0")) == "")
        return F.when(zero, F.lit(0)).when(fits, F.concat(part(1), before).try_cast("bigint"))

    led = F.ltrim(part(2), F.lit("0"))
    tail = F.when(led == "", F.ltrim(part(3), F.lit("0"))).otherwise(part(3))
    lost = F.when(led == "", F.length(part(3)) - F.length(tail)).otherwise(0)
    scaled = bind(F.struct(F.concat(led, tail).alias("digits"), (F.length(led) - lost + part(4).cast("int")).alias("point")), moved)
    named = F.length(F.concat(part(2), part(3))) > 0
    return F.when(bare.rlike(PLAIN_NUMBER), plain).when(bare.rlike(SCALED_NUMBER) & named, scaled)


NO_ROWS = "array<struct<parent:string,field:string,count:string>>"


def _none() -> Column:
    return F.array().cast(NO_ROWS)


def _entries(holder: Column, place: Column, groups: Sequence[str]) -> Column:
    """Entries (parent, field, count as text) of the named count groups inside holder, an object's fields.

    A group is an object of counts by name, or a list of objects with `name` and `count`; its place is its holder's
    in either shape. An entry listed twice with one count is one."""

    def entries(group: str) -> Column:
        def row(name: Column, count: Column) -> Column:
            return F.struct(place.alias("parent"), F.concat(F.lit(group + "."), name).alias("field"), text_of(count).alias("count"))

        def of(value: Column) -> Column:
            named = F.transform(F.map_entries(as_object(value)), lambda e: row(e["key"], e["value"]))
            items = F.filter(F.transform(as_list(value), as_object), lambda i: field_of(i, "name").isNotNull())
            counted = F.array_distinct(F.transform(items, lambda i: row(text_of(field_of(i, "name")), field_of(i, "count"))))
            return F.coalesce(named, counted, _none())

        return of(field_of(holder, group))

    return F.concat(*[entries(g) for g in groups])


def _in_each(items: Column, prefix: Column, name: str, inner) -> Column:
    """Rows inner(item as an object, its place) yields for each item of items, in one array."""
    objects = F.transform(items, as_object)
    return F.flatten(F.transform(objects, lambda item, i: inner(item, F.concat(prefix, F.lit(name + "/"), i.cast("string")))))


def _records(df: DataFrame, id_col: str, payload_col: str, wrapper: str, list_name: str) -> DataFrame:
    """(record_id, items): the items of a list of each record that can be read in full."""
    pairs = df.select(F.col(id_col).alias("record_id"), listed(F.col(payload_col).cast("string")).alias("pair"))
    values = pairs.select("record_id", sole_value(F.col("pair")).alias("value"))
    outer = values.select("record_id", as_object(F.col("value")).alias("outer"))
    inner = outer.select("record_id", F.coalesce(as_object(field_of(F.col("outer"), wrapper)), "outer").alias("record"))
    return inner.select("record_id", as_list(field_of(F.col("record"), list_name)).alias("items"))


def _whole_rows(found: DataFrame, rows: Column) -> DataFrame:
    """(record_id, parent, field, n): rows (parent, field, count as text) of each record whose count is a whole number."""
    flat = each_struct(found, ["record_id"], rows, "field").where("count is not null")
    return flat.select("record_id", "parent", "field", whole_number(F.col("count")).alias("n")).where("n is not null")


def trace_counters(trace: DataFrame, id_col: str = "trace_id", payload_col: str = "payload") -> DataFrame:
    """(record_id, parent, field, n): a row for each whole-number counter of a step's or an attempt's detail.

    Null, empty, cut-off and non-object payloads give no row, nor do objects that name a field twice; null list items
    keep their position; a record stored twice gives its rows twice, and no row twice in itself; fields that aren't
    there give no row; other columns aren't read.
    """
    groups = ("source_counts", "semantic_signal_counts")

    def attempt_rows(attempt: Column, place: Column) -> Column:
        return bind(as_object(field_of(attempt, "detail")), lambda detail: _entries(detail, place, groups))

    def step_rows(step: Column, place: Column) -> Column:
        return bind(
            as_object(field_of(step, "detail")),
            lambda detail: F.concat(
                _entries(detail, place, groups),
                _in_each(as_list(field_of(detail, "attempts")), F.concat(place, F.lit("/")), "attempts", attempt_rows),
            ),
        )

    found = _records(trace, id_col, payload_col, "trace", "steps")
    return _whole_rows(found, _in_each(F.col("items"), F.lit(""), "steps", step_rows))


def report_scores(reports: DataFrame, id_col: str = "report_id", payload_col: str = "payload") -> DataFrame:
    """(record_id, parent, field, n): a row for each whole-number quality_score of a pair's baseline and llm.

    The same cases as in trace_counters are defined in the same way.
    """

    def pair_rows(pair: Column, place: Column) -> Column:
        def score(side: str) -> Column:
            value = text_of(field_of(as_object(field_of(pair, side)), "quality_score"))
            return F.struct(place.alias("parent"), F.lit(f"{side}.quality_score").alias("field"), value.alias("count"))

        return F.array(score("baseline"), score("llm"))

    found = _records(reports, id_col, payload_col, "llm_impact_report", "pairs")
    return _whole_rows(found, _in_each(F.col("items"), F.lit(""), "pairs", pair_rows))


def trace_steps(trace: DataFrame, id_col: str = "trace_id", payload_col: str = "payload") -> DataFrame:
    """(record_id, step_no, name, status, started_at, ended_at, n_attempts): the parent table of the counters."""

    def row(step: Column, i: Column) -> Column:
        fields = [text_of(field_of(step, n)).alias(n) for n in ("name", "status", "started_at", "ended_at")]
        attempts = F.size(as_list(field_of(as_object(field_of(step, "detail")), "attempts"))).alias("n_attempts")
        return F.struct(i.alias("step_no"), *fields, attempts, step.isNotNull().alias("is_object"))

    steps = F.transform(F.transform(F.col("items"), as_object), row)
    found = _records(trace, id_col, payload_col, "trace", "steps")
    return each_struct(found, ["record_id"], F.filter(steps, lambda s: s["is_object"]), "is_object").drop("is_object")


def tool_calls(trace: DataFrame, id_col: str = "trace_id", payload_col: str = "payload") -> DataFrame:
    """(record_id, call_no, tool, status, elapsed_seconds): one row for each object of tool_calls."""

    def row(call: Column, i: Column) -> Column:
        seconds = text_of(field_of(call, "elapsed_seconds")).try_cast("double").alias("elapsed_seconds")
        return F.struct(i.alias("call_no"), text_of(field_of(call, "tool")).alias("tool"), text_of(field_of(call, "status")).alias("status"), seconds, call.isNotNull().alias("is_object"))

    calls = F.transform(F.transform(F.col("items"), as_object), row)
    found = _records(trace, id_col, payload_col, "trace", "tool_calls")
    return each_struct(found, ["record_id"], F.filter(calls, lambda s: s["is_object"]), "is_object").drop("is_object")


def nested_counts(trace: DataFrame, reports: DataFrame) -> DataFrame:
    """(tbl, record_id, parent, field, n) of both record tables. Rows are distinct where ids are: a place names each list
    item once, an object each field once, and listed entries are made distinct inside their record."""
    both = trace_counters(trace).withColumn("tbl", F.lit("trace")).unionByName(
        report_scores(reports).withColumn("tbl", F.lit("llm_impact_report"))
    )
    return both.select("tbl", "record_id", "parent", "field", "n")


def leaves(value: object) -> Iterator[str]:
    """Texts, numbers and flags at the leaves of a parsed JSON value, in order; keys and nulls are left out."""
    stack = [value]
    while stack:
        item = stack.pop()
        if isinstance(item, dict):
            stack.extend(reversed(item.values()))
        elif isinstance(item, list):
            stack.extend(reversed(item))
        elif item is not None:
            yield item if isinstance(item, str) else str(item)


def scrubbed(value: object, clean) -> object:
    """A parsed JSON value with clean applied to every text in it; keys, numbers and flags stay."""
    if isinstance(value, dict):
        return {k: scrubbed(v, clean) for k, v in value.items()}
    if isinstance(value, list):
        return [scrubbed(v, clean) for v in value]
    return clean(value) if isinstance(value, str) else value


def scrub_json(df: DataFrame, key: str, json_col: str, clean) -> DataFrame:
    """(key, json): each JSON value with clean, a function from text to text, applied to its texts; null where it can't
    be read."""
    src = df.select(F.col(key).alias("id"), F.col(json_col).cast("string").alias("json"))

    def text_of(value: str | None) -> str | None:
        try:
            return None if value is None else json.dumps(scrubbed(json.loads(value), clean), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([text_of(v) for v in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["id", "json"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, json string").withColumnRenamed("id", key)


def leaf_texts(df: DataFrame, key: str, json_col: str) -> DataFrame:
    """(key, leaf_text): all leaves of each JSON value joined by spaces; null where it can't be read.

    Depth is open, which no SQL expression covers, so values go through Arrow batches; nothing is shuffled.
    """
    src = df.select(F.col(key).alias("id"), F.col(json_col).cast("string").alias("json"))

    def text_of(value: str | None) -> str | None:
        try:
            return None if value is None else " ".join(leaves(json.loads(value)))
        except (ValueError, RecursionError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([text_of(v) for v in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["id", "leaf_text"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, leaf_text string").withColumnRenamed("id", key)
