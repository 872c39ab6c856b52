"""One form for texts that look the same: look-alike mapping, then classes under accent-sensitive Unicode collation."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters of other scripts that look like these Latin letters in common typefaces.
LATIN_LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J", "ɡ": "g", "ɑ": "a", "µ": "μ",
}
#: Characters without width, as ranges of code points.
WITHOUT_WIDTH = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF)]
#: Characters that a collation passes over although they aren't look-alikes: they must agree exactly.
CONTROLS = r"[^\x00-\x08\x0e-\x1f\x7f-\x9f]+"


@cache
def mapping() -> tuple[str, str]:
    """(from, to) for translate: each character and its look-alike; those of from beyond the length of to vanish.

    Built by rule: full-width and ideographic-radical forms by their compatibility mapping, single spaces of any kind
    to the space, the letters of LATIN_LOOKALIKES with or without accents.
    """
    to = dict(LATIN_LOOKALIKES)
    for code in (*range(0xFF01, 0xFF5F), *range(0xFFE0, 0xFFE7), *range(0x2E80, 0x2FD6)):
        same = unicodedata.normalize("NFKC", chr(code))
        if same != chr(code) and len(same) == 1:
            to[chr(code)] = same
    for code in range(0xA0, 0x3001):
        if unicodedata.category(chr(code)) == "Zs":
            to[chr(code)] = " "
    for code in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):  # accented letters whose base has a look-alike
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base in to:
            same = unicodedata.normalize("NFC", to[base] + "".join(marks))
            if len(same) == 1:
                to[chr(code)] = same
    gone = [chr(c) for first, last in WITHOUT_WIDTH for c in range(first, last + 1)]
    return "".join(to) + "".join(gone), "".join(to.values())


def mapped(text: Column) -> Column:
    """text with every look-alike in its mapped form; pure ASCII stays as it is."""
    src, dst = mapping()
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, src, dst)).otherwise(text)


def _present(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(*keys, text.alias("text")).where(text.isNotNull() & text.rlike(r"(?U)[^\s​-‏⁠﻿­]"))


def text_classes(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys[:-1], form, class_id, canonical): each distinct stored text, by its hash, and its class of equal looks.

    Texts are shuffled once to make them distinct and once, mapped, to meet under the collation; hot texts are
    collapsed before the first shuffle. The canonical member is the text most rows store, then the shortest, then the
    first in code point order.
    """
    scope = keys[:-1]
    forms = texts.groupBy(*scope, "form").agg(F.first("text").alias("text"), F.count("*").alias("rows"))
    look = mapped(F.col("text"))
    forms = forms.withColumn("look", F.collate(look, "UNICODE")).withColumn("controls", F.regexp_replace(look, CONTROLS, ""))
    alike = Window.partitionBy(*scope, "controls", "look")
    best = F.min_by("text", F.struct(-F.col("rows"), F.length("text"), F.col("text"))).over(alike)
    return forms.select(*scope, "form", F.min("form").over(alike).alias("class_id"), best.alias("canonical"))


def with_form(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    return _present(df, keys, text_col).withColumn("form", F.unhex(F.md5("text")))


def canonical_texts(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """df's keys with `canonical`: the text in the one form of its class, so that texts that look the same are equal.

    keys are columns naming a row, of which all but the last bound the classes. Null and blank texts keep a null and
    their own text as canonical; repeated rows come out once each; other columns of df aren't read.
    """
    scope = keys[:-1]
    rows = df.select(*keys, F.col(text_col).cast("string").alias("text")).withColumn("form", F.unhex(F.md5("text")))
    classes = text_classes(with_form(df, keys, text_col), keys).drop("class_id")
    joined = rows.join(classes, [*scope, "form"], "left")
    return joined.select(*keys, F.coalesce("canonical", "text").alias("canonical"))


def alike_pairs(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys[:-1], id_a, id_b): rows whose stored texts differ but look the same, id_a < id_b.

    Work follows the output: distinct texts of a class are paired first, and only then their rows, so that rows with
    one and the same text, however many, never meet each other. Null and blank texts give no pair.
    """
    *scope, key = keys
    rows = with_form(df, keys, text_col)
    classes = text_classes(rows, keys).select(*scope, "form", "class_id")
    many = classes.groupBy(*scope, "class_id").agg(F.collect_set("form").alias("forms")).where(F.size("forms") > 1)
    forms = many.select(*scope, F.explode("forms").alias("form_a"), "forms")
    pairs = forms.select(*scope, "form_a", F.explode(F.filter("forms", lambda x: x > F.col("form_a"))).alias("form_b"))
    members = rows.select(*scope, F.col(key).alias("id"), "form")
    left = pairs.join(members.withColumnsRenamed({"form": "form_a", "id": "a"}), [*scope, "form_a"])
    both = left.join(members.withColumnsRenamed({"form": "form_b", "id": "b"}), [*scope, "form_b"])
    return both.select(*scope, F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).where("id_a < id_b").distinct()
