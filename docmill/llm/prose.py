"""Per-document text statistics, their quantile sketches per language, and the tails that aren't prose."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.lookalike import LATIN_LOOKALIKES, WITHOUT_WIDTH
from docmill.llm.mojibake import repair, suspicious
from docmill.session import cut_lineage

#: Frequent function words by language.
COMMON_WORDS = {
    "en": (
        "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "with", "as", "by", "at", "be", "this", "from", "are", "or", "an",
        "which", "not", "has", "have", "had", "were", "been", "its", "their", "but", "no", "if", "after", "before", "while", "than", "into", "more",
        "each", "so", "until", "once",
    ),
    "de": (
        "der", "die", "das", "und", "in", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als",
        "auch", "es", "an", "werden", "aus", "er", "hat", "dass", "sie", "nach", "wird", "bei", "um", "am", "sind", "noch", "wie", "einem", "über",
        "einen", "so", "zum", "vor", "bis", "ohne", "gegen",
    ),
    "fr": (
        "le", "la", "les", "de", "des", "et", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "sur", "pas", "par", "au", "avec", "plus",
        "ce", "il", "se", "ne", "sont", "cette", "aux", "ou", "son", "sa", "ses", "à", "l", "d", "qu", "sans", "après", "avant", "hors",
    ),
    "es": (
        "el", "la", "los", "las", "de", "y", "en", "un", "una", "del", "que", "es", "por", "para", "con", "se", "no", "al", "su", "lo", "como", "más",
        "sin", "sobre", "entre", "este", "esta", "son", "después", "antes", "durante", "según", "fuera",
    ),
    "pt": (
        "o", "a", "os", "as", "de", "e", "em", "um", "uma", "do", "da", "dos", "das", "que", "é", "por", "para", "com", "se", "não", "ao", "à", "no",
        "na", "nos", "nas", "mais", "sem", "sobre", "entre", "este", "esta", "são", "após", "antes", "durante", "segundo", "até", "fora",
    ),
    "ru": (
        "и", "в", "не", "на", "с", "что", "по", "из", "за", "к", "у", "о", "от", "до", "для", "как", "это", "но", "а", "так", "же", "или", "при",
        "без", "после", "во", "со", "над", "под", "все", "его", "ее", "был", "была", "были", "вне", "сверх",
    ),
    "zh": (
        "的", "了", "在", "和", "是", "有", "不", "由", "为", "与", "或", "于", "及", "对", "中", "上", "下", "个", "这", "那", "将", "已", "把", "被", "从", "到", "并", "若",
        "则", "按", "因", "未", "需", "应", "经", "其", "以", "之", "后", "前",
    ),
}
CJK = "㐀-䶿一-鿿豈-﫿぀-ヿ"
#: A word: an ideograph or kana on its own, or a run of other letters, marks and digits.
WORD = re.compile(rf"[{CJK}]|[^\W_{CJK}]+(?:['’\-][^\W_{CJK}]+)*")
#: Where a sentence ends: a full stop, question or exclamation mark with what may close it, before white space, an
#: ideograph or the end.
SENTENCE_END = re.compile(rf"[.!?…]+[\"'”’»)\]]*(?=\s|$|[{CJK}])|[。！？]+[”’」』）]*")
CLOSING = tuple(".!?。！？…:;；：”»\"'’)）」』")
STATS = ("words", "mean_word_length", "symbol_share", "closed_line_share", "common_share", "sentence_strength", "sentence_share")


@cache
def common_sets() -> dict[str, frozenset[str]]:
    return {lang: frozenset(words) for lang, words in COMMON_WORDS.items()}


@cache
def _plain_table() -> dict[int, str | None]:
    return {ord(a): b for a, b in LATIN_LOOKALIKES.items()} | {c: None for first, last in WITHOUT_WIDTH for c in range(first, last + 1)}


@cache
def _plain_chars() -> re.Pattern:
    return re.compile("[" + "".join(map(chr, _plain_table())) + "]")


@cache
def _widthless() -> re.Pattern:
    return re.compile("[" + "".join(f"{chr(first)}-{chr(last)}" for first, last in WITHOUT_WIDTH) + "]")


def readable(text: str) -> str:
    """text as a reader takes it: decoding errors undone, compatibility forms and characters without width resolved."""
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return text
    if suspicious(text):
        text = repair(text)[0]
    return unicodedata.normalize("NFKC", _widthless().sub("", text))


@cache
def _languages_of() -> dict[str, tuple[str, ...]]:
    words = frozenset().union(*common_sets().values())
    return {w: tuple(lang for lang, known in common_sets().items() if w in known) for w in words}


def language_of(words: list[str]) -> tuple[str, int]:
    """(language, number of its common words) that most words speak for; und without any."""
    counts, spoken, hits = Counter(words), _languages_of(), Counter()
    for word in counts.keys() & spoken.keys():
        for lang in spoken[word]:
            hits[lang] += counts[word]
    if not hits:
        return "und", 0
    lang = max(hits, key=lambda x: (hits[x], x))
    return lang, hits[lang]


#: What a list, a form, a contents line or a table has and a sentence hasn't: leaders, cells, several semicolons.
NOT_A_SENTENCE = re.compile(r"\.{4,}|…{2,}|·{3,}|( \. ?){3,}|\t|\||<t[dhr]|;[^;]*;[^;]*;|[=_~#*^]{3,}")
#: One of these is in whatever NOT_A_SENTENCE matches.
ODD_SIGN = re.compile(r"[\t|<;=_~#*^…·]")
#: Columns set apart by spaces, and where such stretches are parted.
COLUMNS = re.compile(r"\S {3,}\S")
PARTS = re.compile(r"\n|\t| {3,}|[|=~^#*_;]|[.…·]{3,}|(?: \.){2,}")
#: Where a list entry begins, after a line break, and dot leaders: no sentence runs across them.
ENTRY = re.compile(r"\n[ \t]*(?:\(?\d{1,3}(?:\.\d+)*[.)][ \t]|\(?\d{1,3}(?:\.\d+)*、|[-*•·□■◦][ \t]|\([a-zA-Z]\)[ \t])")
#: What follows a full stop that ends no sentence.
ABBREVIATION = re.compile(r" [\da-zà-ÿа-я]")
LEADERS = re.compile(r"(?:[ \t]*[.…·]){3,}")
PARAGRAPH = re.compile(r"\n\s*\n")
SYMBOL = re.compile(r"[^\w]|_")
#: Strength of a stretch from which on it counts as a sentence in the reference that the sketches are made of, and the
#: most words that count.
SENTENCE, MOST_WORDS = 3.6, 40


@cache
def _strong_sets() -> dict[str, frozenset[str]]:
    """The common words without single Latin letters, which noise is full of."""
    return {lang: frozenset(w for w in known if len(w) > 1 or w > "\x7f") for lang, known in common_sets().items()}


def stretch_strength(stretch: str, known: frozenset[str], ended: bool) -> float:
    """How much a stretch of text is like a sentence: its words (two ideographs are one), times the share of letters in its
    characters, times how near it comes to one function word in eight; less without a mark at its end or with few letters."""
    words = WORD.findall(stretch.lower())
    if not words:
        return 0.0
    dense = len(stretch) - stretch.count(" ") - stretch.count("\n")
    letters = sum(map(len, words)) - sum([len(w) for w in words if w[0] <= "9"]) + stretch.count("�")
    share, n = letters / max(1, dense), len(words)
    ideographs = 0 if stretch.isascii() else len([w for w in words if w >= "㐀"])
    if ideographs > n / 2:
        n, function = ideographs / 2, 1.0
    else:
        function = min(1.0, 8 * sum(map(known.__contains__, words)) / n)
        if ended and n >= 5 and share >= 0.75 and max(map(len, words)) < 40:
            function = max(function, 0.9)
    return min(n, MOST_WORDS) * share * function * (1.0 if ended else 0.65) * (1.0 if share >= 0.45 else 0.3)


def _strongest(stretch: str, known: frozenset[str], ended: bool) -> float:
    """stretch_strength of a stretch, or of the strongest of its lines and cells if it is a list, a table or leaders."""
    lines = [x for x in stretch.split("\n") if x and not x.isspace()]
    if not lines:
        return 0.0
    whole = len(lines) == 1 or min(map(len, lines[:-1])) >= 40
    odd = "...." in stretch or " ." in stretch or ODD_SIGN.search(stretch) is not None
    wide = "   " in stretch and COLUMNS.search(stretch) is not None
    if not wide and (ended and not odd or whole and not (odd and NOT_A_SENTENCE.search(stretch))):
        return stretch_strength(stretch, known, ended)
    parts = PARTS.split(stretch)
    return max(stretch_strength(x, known, ended and i == len(parts) - 1) for i, x in enumerate(parts))


def stretches(text: str) -> Iterator[tuple[str, bool]]:
    """(stretch, whether a mark ends it as sentences end): text parted at such marks, paragraphs, list entries and leaders."""
    text = ENTRY.sub("\n\n", "\n" + text)
    if ".." in text or "…" in text or "·" in text or ". ." in text:
        text = LEADERS.sub("\n\n", text)
    at = 0
    for end in SENTENCE_END.finditer(text):
        if end.group() == "." and ABBREVIATION.match(text, end.end()):
            continue
        *before, last = PARAGRAPH.split(text[at : end.end()])
        yield from ((x, False) for x in before)
        yield last, True
        at = end.end()
    yield from ((x, False) for x in PARAGRAPH.split(text[at:]))


def text_stats(text: str) -> tuple[str, int, float, float, float, float, float, float, int]:
    """(language, *STATS, number of sentences) of a text that isn't blank. sentence_strength is the logarithm of the
    strongest stretch's strength, 0 from 1 down; sentences are stretches of SENTENCE and more."""
    text = readable(text)
    words = WORD.findall(text.lower())
    lang, common = language_of(words)
    if not text.isascii() and _plain_chars().search(text):
        plain = text.translate(_plain_table())
        other = WORD.findall(plain.lower())
        by = language_of(other)
        if by[1] > common and by[0] not in ("ru", "zh"):
            text, words, (lang, common) = plain, other, by
    solid = "".join(text.split())
    dense = len(solid) or 1
    symbols = len(SYMBOL.findall(solid))
    lines = [x for x in (line.strip() for line in text.splitlines()) if x]
    closed = sum(line.endswith(CLOSING) for line in lines) / max(1, len(lines))
    known, strongest, inside, sentences = _strong_sets().get(lang, frozenset()), 1.0, 0, 0
    for stretch, ended in stretches(text):
        strength = _strongest(stretch, known, ended)
        strongest = max(strongest, strength)
        if strength >= SENTENCE:
            inside += len(stretch) - stretch.count(" ") - stretch.count("\n")
            sentences += 1
    n = max(1, len(words))
    return lang, len(words), sum(map(len, words)) / n, symbols / dense, closed, common / n, log(strongest), min(1.0, inside / dense), sentences


STATS_DDL = "lang string, words int, mean_word_length double, symbol_share double, closed_line_share double, common_share double, sentence_strength double, sentence_share double, sentences int"


def document_stats(df: DataFrame, key: str, text_col: str, *also: str) -> DataFrame:
    """(key, *also, lang, words, mean_word_length, symbol_share, closed_line_share, common_share,
    sentence_strength, sentence_share, sentences) for every row of df.

    Null and blank texts have language `und`, no words and 0 in every share. Whole texts are read, in the tasks of
    the scan; repeated rows come out each; other columns aren't read.
    """
    src = df.select(key, *also, F.col(text_col).cast("string").alias("text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.drop("text").schema)
    types = [pa.string(), pa.int32(), *[pa.float64()] * 6, pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blank = ("und", 0, *[0.0] * 6, 0)
            rows = [text_stats(x) if x and not x.isspace() else blank for x in batch.column("text").to_pylist()]
            own = batch.drop_columns(["text"])
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
            names = [f.split()[0] for f in STATS_DDL.split(", ")]
            yield pa.RecordBatch.from_arrays([*own.columns, *cols], [*own.schema.names, *names])

    return src.mapInArrow(run, f"{fields}, {STATS_DDL}")


#: Least scale of a statistic's robust z-score, for collections whose middle half agrees.
SCALE_FLOOR = {"words": 5.0, "mean_word_length": 0.5, "sentence_strength": 0.25}
#: Statistics that are compared with rows that hold a sentence only, which the tail is read from.
OF_PROSE = ("symbol_share", "sentence_strength", "sentence_share")
#: Rows with a sentence that a language must have to be its own reference; those of less are held against all languages.
LEAST_ROWS = 50


def stat_sketches(stats: DataFrame) -> DataFrame:
    """(lang, rows, prose_rows, and a mergeable quantile sketch of each statistic): a row per language and one, `*`, for all.

    Those of OF_PROSE are of the rows that hold a sentence, prose_rows of them, so that a value is compared with prose
    however common tables and lists are; null where there is none. Sketches are built before the shuffle and merged after it, a few kB
    each however many rows a language has.
    """
    held = lambda s: (F.when(F.col("sentences") > 0, F.col(s)) if s in OF_PROSE else F.col(s)).cast("double")
    own = stats.where("words > 0").groupBy("lang").agg(
        F.count("*").alias("rows"), F.count_if(F.col("sentences") > 0).alias("prose_rows"), *[F.kll_sketch_agg_double(held(s)).alias(s) for s in STATS]
    )
    merged = [F.kll_merge_agg_double(F.col(s)).alias(s) for s in STATS]
    every = own.unionByName(own.groupBy(F.lit("*").alias("lang")).agg(F.sum("rows").alias("rows"), F.sum("prose_rows").alias("prose_rows"), *merged))
    return every.withColumns({s: F.when(F.col("prose_rows") > 0, F.col(s)) for s in OF_PROSE})


#: Ranks at which the sketches are read.
GRID = (0.01, 0.02, *(i / 20 for i in range(1, 20)), 0.98, 0.99)


def _grids(sketches: DataFrame, name: str) -> DataFrame:
    """(lang, name): the values of each statistic at the ranks of GRID."""
    ranks = F.array(*[F.lit(x) for x in GRID])
    return sketches.select("lang", F.struct(*[F.kll_sketch_get_quantile_double(F.col(s), ranks).alias(s) for s in STATS]).alias(name))


def _z(stat: str, grid: Column) -> Column:
    at = lambda q: F.get(grid, F.lit(GRID.index(q)))
    scale = F.greatest((at(0.75) - at(0.25)) / 1.349, F.lit(SCALE_FLOOR.get(stat, 0.05)))
    return (F.col(stat) - at(0.5)) / scale


def _rank(stat: str, grid: Column) -> Column:
    """The largest rank of GRID whose value isn't above the statistic; 0 below all."""
    below = F.size(F.filter(grid, lambda g: g <= F.col(stat)))
    return F.coalesce(F.get(F.array(F.lit(0.0), *[F.lit(x) for x in GRID]), below), F.lit(0.0))


def with_tails(stats: DataFrame, sketches: DataFrame) -> DataFrame:
    """stats with <stat>_rank (how much of the language's rows lies at or below the value, to the step of GRID) and
    <stat>_z (robust z-score within the language); those of OF_PROSE among the rows that hold a sentence. Languages with
    fewer than LEAST_ROWS of such rows are ranked among those of all languages.

    What is read off the sketches is broadcast: a row for each language of COMMON_WORDS, `und` and `*`, whatever the data.
    """
    own = sketches.where("lang <> '*'")
    langs = _grids(own, "own").join(own.select("lang", "prose_rows"), "lang").withColumn("of", F.lit("*"))
    whole = _grids(sketches.where("lang = '*'"), "whole").withColumnRenamed("lang", "of")
    grid = F.when(F.col("prose_rows") >= LEAST_ROWS, F.col("own")).otherwise(F.col("whole"))
    joined = stats.join(F.broadcast(langs.join(whole, "of").select("lang", grid.alias("grid"))), "lang", "left")
    ranks = {f"{s}_rank": _rank(s, F.col(f"grid.{s}")) for s in STATS}
    scores = {f"{s}_z": _z(s, F.col(f"grid.{s}")) for s in STATS}
    return joined.withColumns(ranks | scores).drop("grid")


#: Robust z-score from which on down the strongest stretch lies in the tail, and what a symbol share far above prose, from
#: SYMBOLS deviations on, adds to it at most.
TAIL, SYMBOLS, MOST_ODD = -4.5, 2.0, 2.0


def in_tail() -> Column:
    """Whether a row's strongest stretch is far weaker than those of its language's prose. Signs are the second evidence:
    each deviation of the symbol share beyond SYMBOLS counts as one of the strength, up to MOST_ODD."""
    odd = F.least(F.greatest(F.col("symbol_share_z") - SYMBOLS, F.lit(0.0)), F.lit(MOST_ODD))
    return F.coalesce(F.col("sentence_strength_z") - odd <= TAIL, F.lit(True))


def quality_stats(df: DataFrame, key: str, text_col: str, *also: str) -> DataFrame:
    """document_stats with ranks, z-scores and `tail`: whether the text lies in the tail of its language's sketches where
    there is no prose (see in_tail). Texts without any word are in it, and so is everything where no row holds a sentence.

    How many rows hold no sentence changes nothing, as the sketches are of those that do.
    """
    stats = cut_lineage(document_stats(df, key, text_col, *also))
    return with_tails(stats, stat_sketches(stats)).withColumn("tail", in_tail())
