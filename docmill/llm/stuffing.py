"""Keyword-stuffed pages, link lists and product tags: phrases stuffed on many hosts, joined with list density.

Each page is parted into sentences and the lines outside them. The phrases of those lines are exploded and counted by
distinct hosts and contents; phrases that pages of several hosts repeat over and over, and seldom hold once, are
stuffed ones. Pages that lie outside sentences for the larger part and are stitched of such phrases are flagged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.prose import CJK, SENTENCE_END, WORD, common_sets, readable
from docmill.session import cut_lineage

#: Occurrences in a page from which on it repeats a phrase, and hosts and contents that must repeat it.
REPEATED, HOSTS = 3, 3
#: Least share of the contents that hold a phrase at all which repeat it.
RATE = 0.4
#: Least share of a page outside its sentences, and of stuffed phrases in it.
LIST_SHARE, STUFFED = 0.6, 0.15
#: Parts that a phrase's rows are split into for the join: a phrase may stand on a third of all pages.
SALTS = 16
LINK = re.compile(r"(?:https?://|www\.)[^\s\"'<>)\]|]+|</?(?:a|li|ul|ol|p|div)\b[^>]*>", re.I)
#: An address with the tag it stands in, other tags, and signs before a hashtag.
ADDRESS = re.compile(r"<[^<>]*(?:https?://|www\.)[^<>]*>|(?:https?://|www\.)[^\s\"'<>)\]|]+", re.I)
TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
TAG_SIGN = re.compile(r"#(?=[^\W\d])")
#: A row of a table, which tells something and is no list of keywords.
TABLE_LINE = re.compile(r"\s*\|.*\|\s*$")
HASHTAG = re.compile(r"#\w+")
#: What stands for an address, a code of letters and digits, and the sign of a hashtag in a page's words.
ADDRESS_MARK, CODE_MARK, TAG_MARK = "\x01", "\x02", "\x03"
MARKS = re.compile("[\x01-\x03]")
MARKED_WORD = re.compile(f"[\x01\x03]|{WORD.pattern}")
#: Words of a title between two addresses or two hashtags that make a template.
TITLE = 8
#: Kinds of phrases: templates, pairs of words, single words.
TEMPLATE, PAIR, SINGLE = 0, 1, 2
#: Ideographs set apart by spaces, as keywords are and sentences aren't.
SPACED = re.compile(f"[{CJK}] +(?=[{CJK}])")
#: A wrapped sentence goes on over a line break only after a line of at least so many characters.
WRAP = 40
_FUNCTION = frozenset(w for known in common_sets().values() for w in known if len(w) > 1 or w > "\x7f")


def _solid(text: str) -> int:
    return len("".join(text.split()))


def _tells(segment: str) -> bool:
    """Whether a segment that ends as sentences do is one: enough words, function words among them, few signs."""
    if "#" in segment and len(HASHTAG.findall(segment)) > 2 or "|" in segment or segment.count(";") > 4:
        return False
    if "www." in segment or "http" in segment or "</" in segment:
        segment = LINK.sub(" ", segment)
    words = WORD.findall(segment.lower())
    size = sum(map(len, words))
    if len(words) < 5 or size < 0.5 * _solid(segment):
        return False
    common = len([w for w in words if w in _FUNCTION])
    ideographs = len([w for w in words if len(w) == 1 and w >= "㐀"])
    if ideographs > len(words) / 2:
        return (common > 0 or ideographs >= 8) and len(SPACED.findall(segment)) <= ideographs / 20
    return common > 0 and common * 16 >= len(words)


def parts_of(text: str) -> tuple[int, list[list[str]]]:
    """(characters in sentences, the runs of consecutive lines outside them). Blank lines don't part a run."""
    inside, others, at = 0, [], 0
    for end in SENTENCE_END.finditer(text):
        if end.group().startswith("...."):
            continue  # dots that lead to a figure
        stop = end.end()
        start = text.rfind("\n", at, stop - 1 if text[stop - 1] == "\n" else stop) + 1
        start = max(start, at)
        while start > at and start - 1 - (before := max(at, text.rfind("\n", at, start - 1) + 1)) >= WRAP:
            start = before  # the line before is long enough to have been wrapped
        if _tells(text[start:stop]):
            if start > at:
                others.append(text[at:start].split("\n"))
            inside += _solid(text[start:stop])
            at = stop
    others.append(text[at:].split("\n"))
    return inside, [kept for run in others if (kept := [x for x in run if x and not x.isspace()])]


def _masked(word: str) -> str:
    """word without a number at its end; a code of letters and digits as its mark; nothing for a figure."""
    if word.isalpha():
        return word
    if not any(map(str.isalpha, word)):
        return ""
    bare = word.rstrip("0123456789")
    return CODE_MARK if bare != word and (bare[-1] == "-" or len(bare) < 4) or any(map(str.isdigit, bare)) else bare


def masked_words(line: str) -> tuple[list[str], list[int]]:
    """(words of a line with addresses, codes and hashtag signs as marks and figures left out, sizes of the addresses)."""
    line = MARKS.sub(" ", line)
    sizes: list[int] = []
    if "://" in line or "www." in line.lower():
        sizes = [len(x) for x in ADDRESS.findall(line)]
        line = ADDRESS.sub(f" {ADDRESS_MARK} ", line)
    if "<" in line:
        line = TAG.sub(" ", line)
    if "#" in line:
        line = TAG_SIGN.sub(f" {TAG_MARK} ", line)
    return [m for w in MARKED_WORD.findall(line.lower()) if (m := _masked(w) if w not in (ADDRESS_MARK, TAG_MARK) else w)], sizes


def _templates(words: list[str], sizes: list[int], mark: str) -> tuple[int, int]:
    """(times a mark follows a mark with a title of up to TITLE words between, characters from the one to the other)."""
    n = chars = held = 0
    last, lengths = None, iter(sizes)
    for at, word in enumerate(words):
        held += next(lengths, 0) if word == ADDRESS_MARK else 0 if word == TAG_MARK else len(word)
        if word == mark:
            if last is not None and at - last <= TITLE:
                n, chars = n + 1, chars + held
            last, held = at, 0
    return n, chars


def page_phrases(text: str) -> tuple[float, int, list[tuple[int, int, int, float]]]:
    """(share of the page outside its sentences and rows of tables, characters of its words, its phrases outside sentences as (hash, kind,
    times, characters)).

    Phrases are pairs of words in a row, over line breaks but not over a sentence, single words that aren't function
    words or ideographs, and templates: an address after an address or a hashtag after a hashtag, whatever their titles.
    Numbers, codes and addresses are masked, so that what recurs but for them is one phrase.
    """
    text = readable(text)
    inside, runs = parts_of(text)
    body = size = 0
    pairs: Counter = Counter()
    singles: Counter = Counter()
    templates: dict[str, list[int]] = {}
    for run in runs:
        words, sizes = [], []
        for line in run:
            if "|" in line and TABLE_LINE.match(line):
                inside += _solid(line)
                continue
            body += _solid(line)
            more, lengths = masked_words(line)
            words += more
            sizes += lengths
        for mark in (ADDRESS_MARK, TAG_MARK):
            if mark in words:
                n, chars = _templates(words, sizes, mark)
                before = templates.setdefault(mark, [0, 0])
                before[0], before[1] = before[0] + n, before[1] + chars
        plain = [w for w in words if w != TAG_MARK]
        size += sum(map(len, plain)) + sum(sizes)
        pairs.update(zip(plain, plain[1:]))
        singles.update(plain)
    found = [(mark, TEMPLATE, n, float(chars)) for mark, (n, chars) in templates.items() if n]
    found += [(f"{a} {b}", PAIR, n, n * (len(a) + len(b)) / 2) for (a, b), n in pairs.items() if a != ADDRESS_MARK and b != ADDRESS_MARK]
    found += [(w, SINGLE, n, float(n * len(w))) for w, n in singles.items() if w != ADDRESS_MARK and w < "㐀" and w not in _FUNCTION]
    rows = [(xxhash.xxh3_64_intdigest(name) - (1 << 63), kind, n, chars) for name, kind, n, chars in found]
    return body / max(1, body + inside), size + inside, rows


PAGE_DDL = "list_share double, size bigint, content bigint, phrase array<bigint>, kind array<tinyint>, repeated array<boolean>, chars array<float>"


def pages(df: DataFrame, key: str, text_col: str, url_col: str) -> DataFrame:
    """(id, host, list_share, size, content, and of each phrase, in arrays, phrase, kind, repeated, chars) of every page
    that isn't blank; content is a hash of the four least phrases."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][\w+.-]*://([^/?#:]+)", 1)), F.lit(""))
    src = df.select(F.col(key).alias("id"), F.xxhash64(host).alias("host"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            kept = [i for i, x in enumerate(texts) if x and not x.isspace()]
            found = [page_phrases(texts[i]) for i in kept]
            own = batch.select(["id", "host"]).take(pa.array(kept, pa.int32()))
            flat = [row for f in found for row in f[2]]
            ends = [0]
            for f in found:
                ends.append(ends[-1] + len(f[2]))
            lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
            content = [xxhash.xxh3_64_intdigest(repr(nsmallest(4, [row[0] for row in f[2]]))) - (1 << 63) for f in found]
            cols = [
                pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64()), pa.array(content, pa.int64()),
                lists([r[0] for r in flat], pa.int64()), lists([r[1] for r in flat], pa.int8()),
                lists([r[2] >= REPEATED for r in flat], pa.bool_()), lists([r[3] for r in flat], pa.float32()),
            ]
            yield pa.RecordBatch.from_arrays([*own.columns, *cols], ["id", "host", *(x.split()[0] for x in PAGE_DDL.split(", "))])

    kind = src.schema["id"].dataType.simpleString()
    return src.where(F.col("text").isNotNull()).mapInArrow(run, f"id {kind}, host bigint, {PAGE_DDL}")


def stuffed_phrases(found: DataFrame, hosts: int = HOSTS, rate: float = RATE) -> DataFrame:
    """(id, kind, chars): the phrases of each page (of pages) that are stuffed ones.

    Those are repeated by pages of at least `hosts` hosts and as many contents, and by at least `rate` of the contents
    that hold them at all. Copies of a page are one content, and so are most pages that agree in nearly all phrases: a
    content is told by its four least phrase hashes, which two pages with a share J of their phrases in common have
    alike with a probability of about J^4. Phrases are counted once a page where they are made, then once a host and
    once a content before they meet by phrase, so that a phrase that a third of all pages hold makes no more rows there
    than there are hosts and contents; where pages meet phrases, a phrase's rows are split by salt.
    """
    arrays = F.arrays_zip("phrase", "kind", "repeated", "chars")
    held = found.select("id", "host", "content", F.inline(arrays))
    on_hosts = held.where("repeated").groupBy("phrase").agg(F.count_distinct("host").alias("hosts")).where(F.col("hosts") >= hosts)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = held.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    some = cut_lineage(salted.join(on_hosts.select("phrase", salts), ["phrase", "salt"]).select("phrase", "salt", "id", "content", "kind", "repeated", "chars"))
    by_content = some.groupBy("phrase", "content").agg(F.bool_or("repeated").alias("repeated"))
    rates = by_content.groupBy("phrase").agg(F.count("*").alias("contents"), F.count_if("repeated").alias("repeating"))
    stuffed = rates.where((F.col("repeating") >= hosts) & (F.col("repeating") >= rate * F.col("contents"))).select("phrase", salts)
    return some.join(stuffed, ["phrase", "salt"]).select("id", "kind", "chars")


def page_spam(df: DataFrame, key: str, text_col: str = "text", url_col: str = "url", hosts: int = HOSTS, rate: float = RATE) -> DataFrame:
    """(key, list_share, stuffed_share, spam) of every page that isn't blank.

    list_share is the share of its characters outside sentences and rows of tables, stuffed_share that of its words in stuffed phrases
    (see stuffed_phrases): of pairs and templates or of single words and templates, whichever is more. A page is spam
    where the first is at least LIST_SHARE and the second at least STUFFED; neither decides without the other. Null,
    empty and blank texts give no row; copies give a row each; a null url counts as one host; other columns aren't read.
    """
    found = cut_lineage(pages(df, key, text_col, url_col))
    of = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("chars"))), F.lit(0.0))
    covered = stuffed_phrases(found, hosts, rate).groupBy("id").agg(F.greatest(of(TEMPLATE, PAIR), of(TEMPLATE, SINGLE)).alias("covered"))
    share = F.coalesce("covered", F.lit(0.0)) / F.greatest("size", F.lit(1))
    joined = found.select("id", "list_share", "size").join(covered, "id", "left").withColumn("stuffed_share", share)
    spam = (F.col("list_share") >= LIST_SHARE) & (F.col("stuffed_share") >= STUFFED)
    return joined.select(F.col("id").alias(key), "list_share", "stuffed_share", spam.alias("spam"))
