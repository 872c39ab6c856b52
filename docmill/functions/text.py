"""Scalar text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.patterns import LINE_BREAK, NUMBER, SPACES


def bind(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda's variable is not computed again at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """text without Unicode white space at either end."""
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """text with every run of white space as one space, and none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def unescape_entities(text: Column) -> Column:
    """The entities that HTML text nearly always uses, decoded; the ampersand last."""
    for name, char in (("nbsp", "\xa0"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def inline_text(text: Column) -> Column:
    """Entities decoded, white space collapsed."""
    return collapse(unescape_entities(text))


def split_lines(text: Column) -> Column:
    """Lines of text without their ends; no empty line after the last end; an empty array for empty and null text."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_BREAK)
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def clean_chunk_text(text: Column) -> Column:
    """Line ends as \\n, blanks and tabs as one space, at most one empty line in a row, stripped."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n"))


# What recovery removes or puts right, in this order.
NOISE = ("锟斤拷", "����", "�", "Ã", "Â")
MISREAD = (("杳", "查"), ("曰", "日"), ("己完成", "已完成"))


def clean_recovered_text(text: Column) -> Column:
    """Noise removed, misread characters put right, letters repeated four times or more cut to two, each line collapsed."""
    for bad in NOISE:
        text = F.replace(text, F.lit(bad), F.lit(""))
    for bad, good in MISREAD:
        text = F.replace(text, F.lit(bad), F.lit(good))
    text = F.regexp_replace(text, r"([\p{L}])\1{3,}", "$1$1")
    return strip(F.array_join(F.transform(split_lines(text), collapse), "\n"))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def slug(text: Column, default: str = "document") -> Column:
    """text with each run of other characters than letters, digits and _.:- as one underscore."""
    clean = F.btrim(F.regexp_replace(text, r"[^0-9A-Za-z_.:-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(default))


def normalized(text: Column) -> Column:
    return F.lower(collapse(text))


def cell_number(text: Column) -> Column:
    """A table cell as a number: thousands commas, brackets for negatives, one currency sign and one unit are taken off.

    Units don't scale the value. Percentages and anything else give null.
    """

    def signed(clean: Column) -> Column:
        negative = clean.startswith("(") & clean.endswith(")")
        bare = F.when(negative, strip(F.substring(clean, F.lit(2), F.length(clean) - 2))).otherwise(clean)
        bare = F.regexp_replace(F.regexp_replace(bare, "^[￥¥$]", ""), "(?:人民币|元|万元|亿元|万|亿)$", "")
        return bind(strip(bare), lambda x: F.when(x.rlike(r"^[-+]?\d+(?:\.\d+)?$"), F.when(negative, -x.try_cast("double")).otherwise(x.try_cast("double"))))

    plausible = text.rlike("[0-9]") & ~text.contains("%")
    return F.when(plausible, bind(strip(F.replace(text, F.lit(","), F.lit(""))), signed))


def first_number(text: Column) -> Column:
    """The first number anywhere in text."""
    found = F.regexp_extract(text, r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?", 0)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def lexical_tokens(text: Column) -> Column:
    """Distinct lower-case words between white space and bars."""
    return F.array_distinct(F.filter(F.split(F.replace(F.lower(text), F.lit("|"), F.lit(" ")), r"(?U)\s+"), lambda w: w != ""))


def profile_tokens(text: Column) -> Column:
    """Words of Latin letters and digits, ideographs, and pairs of neighbouring ideographs."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    return bind(
        F.regexp_extract_all(low, F.lit("[一-鿿]"), F.lit(0)),
        lambda chars: F.concat(words, chars, F.zip_with(F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))),
    )


# What is masked, in this order.
SECRETS = (
    (r"Bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer ***"),
    (r"(?i)((?:api[_-]?key|access[_-]?token|token|secret|signature)=)[^&\s]+", "$1***"),
    (r"(X-Amz-[A-Za-z-]+=)[^&\s]+", "$1***"),
    (r"(?i)(Authorization:\s*)[^\r\n]+", "$1***"),
)


def redact(text: Column) -> Column:
    """Bearer tokens, keys, signatures and authorization headers masked."""
    for pattern, mask in SECRETS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def preview(text: Column, limit: int) -> Column:
    """The first limit characters, and the full length where there is more."""
    cut = F.concat(F.substring(text, 1, limit), F.lit("... ["), F.length(text).cast("string"), F.lit(" chars]"))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def parse_object(text: Column) -> Column:
    """The JSON object in a reply, as VARIANT: as it stands, inside a code fence, or from the first to the last brace."""
    bare = F.regexp_replace(F.regexp_replace(strip(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    whole = F.when(bare.startswith("{"), F.try_parse_json(bare))
    return F.coalesce(whole, F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))))


def ratio(a: Column, b: Column, default: float) -> Column:
    return F.when(b == 0, F.lit(default)).otherwise(a / b)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def page_number(page_no: Column, page_idx: Column) -> Column:
    """One-based page: as given, but 1 at least, or from a zero-based index, or 1."""
    return F.coalesce(F.greatest(page_no, F.lit(1)), page_idx + 1, F.lit(1))


def int_or(text: Column, default: int = 0, least: int | None = 0) -> Column:
    """text as a whole number, or default where it isn't one; least clamps it from below."""
    value = F.coalesce(text.try_cast("int"), F.lit(default))
    return value if least is None else F.greatest(value, F.lit(least))


def truth(text: Column) -> Column:
    """Whether text says yes: 1, true, yes, on, in any case."""
    return F.coalesce(F.lower(strip(text)).isin("1", "true", "yes", "on"), F.lit(False))


def choice(text: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(text.isin(*allowed), text).otherwise(F.lit(default))


def relative_path(path: Column, root: str) -> Column:
    """path without root and the slash after it; other paths stay as they are."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)


def is_confined(path: Column, root: str) -> Column:
    """Whether path lies in root and doesn't climb out of it."""
    base = root.rstrip("/") + "/"
    return path.startswith(base) & ~path.rlike(r"(^|/)\.\.(/|$)")
