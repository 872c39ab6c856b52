"""Texts decoded with a wrong character encoding: found, and restored where nothing was lost.

Round-trip repair: stretches of a text are encoded back under each candidate legacy encoding and decoded strictly as
the intended one; a stretch is replaced when its garbling cost drops, layer by layer.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings that UTF-8 is wrongly read with: those of one byte, of which these hold Cyrillic letters, and one of two.
SINGLE_BYTE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp866")
CYRILLIC = ("cp1251", "cp866")
DOUBLE_BYTE = "gb18030"
#: Legacy texts wrongly read as Western ones: the encoding they are in.
READ_AS_WESTERN = ("cp1251", "gb18030")
#: The replacement character, what is left of it after UTF-8 was read as GBK, and how its UTF-8 looks when
#: read with an encoding of one byte.
LOST = ("�", "锟斤拷", *sorted({b"\xef\xbf\xbd".decode(e) for e in SINGLE_BYTE}))
#: UTF-8 sequences (lead bytes, next bytes, ...) in ranges: all valid ones of three and four bytes, and those of two bytes
#: that stand alone in texts; other scripts of two bytes (MANY) are looked for three in a row, as one letter and a quotation
#: mark look the same. Under Cyrillic encodings the wide ones are looked for two in a row.
NARROW_SEQUENCES = ("\xc2|\x80-\xbf", "\xc3|\x80-\xbf", "\xd0|\x81\x90-\xbf", "\xd1|\x80-\x8f\x91", "\xe2|\x80-\xbf|\x80-\xbf")
WIDE_SEQUENCES = (
    "\xc4-\xc5|\x80-\xbf", "\xcb|\x80-\xbf", "\xce-\xcf|\x80-\xbf", "\xe0|\xa0-\xbf|\x80-\xbf", "\xe1|\x80-\xbf|\x80-\xbf", "\xe3-\xec|\x80-\xbf|\x80-\xbf",
    "\xed|\x80-\x9f|\x80-\xbf", "\xee-\xef|\x80-\xbf|\x80-\xbf", "\xf0|\x90-\xbf|\x80-\xbf|\x80-\xbf", "\xf1-\xf3|\x80-\xbf|\x80-\xbf|\x80-\xbf", "\xf4|\x80-\x8f|\x80-\xbf|\x80-\xbf",
)
MANY = ("\xc6-\xca\xcc-\xcd\xd2-\xdf|\x80-\xbf",)
CYRILLIC_WIDE = ("\xe3-\xec|\x80-\xbf|\x80-\xbf", "\xed|\x80-\x9f|\x80-\xbf", "\xef|\xbb-\xbf|\x80-\xbf", "\xf0|\x9f|\x80-\xbf|\x80-\xbf")

def _ranged(spec: str) -> list[int]:
    """Byte values of a character class such as a-cx."""
    return [b for first, last in re.findall(r"(?s)(.)(?:-(.))?", spec) for b in range(ord(first), ord(last or first) + 1)]


LEADS = {b for spec in NARROW_SEQUENCES for b in _ranged(spec.split("|")[0])}
WIDE_LEADS = {b for spec in WIDE_SEQUENCES + MANY for b in _ranged(spec.split("|")[0])}
#: Signs and punctuation that ordinary texts hold outside ASCII.
ORDINARY = set("–—‘’‚“”„…•€°§«»·¿¡ºª№´×±²³¼½¾′″　、。〈〉《》「」『』【】〔〕・ー～→←↑↓≤≥≠√∞∂∫∑−™©®£¥℃‰")
_UTF8_BYTES = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xe0[\xa0-\xbf][\x80-\xbf]|\xed[\x80-\x9f][\x80-\xbf])+")


@cache
def byte_of(encoding: str) -> dict[str, int]:
    """Upper-half bytes by their character. A byte without one is read as the C1 control, as decoders in the wild do."""
    table: dict[str, int] = {}
    for byte in range(128, 256):
        try:
            char = bytes([byte]).decode(encoding)
        except UnicodeDecodeError:
            char = chr(byte)
        table.setdefault(char, byte)
    return table


@cache
def garbled_pattern(encoding: str) -> str:
    """Regular expression of UTF-8 sequences as they look when read as encoding (one byte a character)."""
    char_of = {byte: re.escape(char) for char, byte in byte_of(encoding).items()}
    def every(specs: tuple[str, ...]) -> str:
        return "|".join("".join("[" + "".join(char_of[b] for b in _ranged(part) if b in char_of) + "]" for part in spec.split("|")) for spec in specs)

    if encoding in CYRILLIC:
        return f"{every(NARROW_SEQUENCES[:4])}|{every(('\xe2|\x80-\x8b|\x80-\xbf',))}|(?:{every(CYRILLIC_WIDE)}){{2,}}|{re.escape(b'\xef\xbf\xbd'.decode(encoding))}"
    return f"{every(NARROW_SEQUENCES + WIDE_SEQUENCES)}|(?:{every(MANY)}){{3,}}"


@cache
def double_byte_pattern() -> str:
    """Two characters as UTF-8 ideographs yield them when read in pairs of bytes: lead and next, then next and lead."""
    def chars(leads: range, trails: range) -> str:
        pairs = (bytes([a, b]).decode("gbk", "ignore") for a in leads for b in trails)
        return "[" + "".join(sorted({c for c in pairs if len(c) == 1})) + "]"

    return chars(range(0xE2, 0xF0), range(0x80, 0xC0)) + chars(range(0x80, 0xC0), range(0xE2, 0xF0))


#: Three or more Western upper-half characters in a row that aren't in a word with ASCII letters.
WESTERN_RUN = "(?<![A-Za-z])[\xa1-\xff‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ\x80-\x9f]{3,}(?![A-Za-z])"


@cache
def suspicion() -> tuple[re.Pattern, ...]:
    """(two characters as any Western encoding shows a lead and a next byte, three upper-half ones in a row, patterns
    that decide by themselves, all patterns). Each begins with one class of characters, which is quick to look for."""
    western = [e for e in SINGLE_BYTE if e not in CYRILLIC]

    def chars(values: set[int]) -> str:
        return "[" + "".join(sorted({re.escape(c) for e in western for c, b in byte_of(e).items() if b in values})) + "]"

    pair = chars(LEADS | WIDE_LEADS) + chars(set(range(0x80, 0xC0)))
    run = re.search(r"\[[^\]]*\]\{3,\}", WESTERN_RUN[len("(?<![A-Za-z])") :]).group()
    own = [garbled_pattern(e) for e in CYRILLIC] + [double_byte_pattern()]
    every = [garbled_pattern(e) for e in western] + own + [WESTERN_RUN]
    return re.compile(pair), re.compile(run), *map(re.compile, own), re.compile("|".join(every))


def suspicious(text: str) -> bool:
    """Whether text may hold something to repair or to report."""
    pair, run, *own, every = suspicion()
    if any(x in text for x in LOST) or "&#" in text and REFERENCES.search(text):
        return True
    found = pair.search(text) or run.search(text)
    return bool(found and every.search(text)) or any(p.search(text) for p in own)


#: Wrongly decoded characters that were then written as numeric character references, two or more in a row.
REFERENCES = re.compile(r"(?:&#(?:\d{3,6}|[xX][0-9a-fA-F]{2,5});){2,}")
REFERENCE = re.compile(r"&#(?:(\d{3,6})|[xX]([0-9a-fA-F]{2,5}));")


def without_references(text: str) -> str:
    """text with the characters that runs of numeric references stand for."""

    def char(found: re.Match) -> str:
        code = int(found.group(1)) if found.group(1) else int(found.group(2), 16)
        return chr(code) if 128 <= code < 0x110000 and not 0xD800 <= code < 0xE000 else found.group()

    return REFERENCES.sub(lambda run: REFERENCE.sub(char, run.group()), text)


@cache
def weight(char: str) -> int:
    """Garbling cost of one character."""
    code = ord(char)
    if code < 128:
        return 0 if code >= 32 or char in "\t\n\r\f" else 4
    if code < 0xA0 or code == 0xFFFD:
        return 4
    if 0x4E00 <= code < 0xA000:
        try:
            lead = char.encode("gb2312")[0]
        except UnicodeEncodeError:
            return 3
        return 2 if lead < 0xD8 else 3
    if char in ORDINARY:
        return 2
    kind = unicodedata.category(char)
    if kind[0] == "L":
        if code < 0x100 or char in "ЁёŒœ" or 0x410 <= code < 0x450 or 0x391 <= code < 0x3CA or 0x3041 <= code < 0x30FF:
            return 2
        return 2 if 0xAC00 <= code < 0xD7A4 or 0xFF00 <= code < 0xFF60 else 3
    if kind in ("Mn", "Cf", "Zs"):
        return 2
    if kind in ("Cn", "Co", "Cs", "Cc"):
        return 12
    return 2 if 0xFF00 <= code < 0xFFF0 or 0x1F000 <= code < 0x1FB00 else 3


def _western(char: str) -> bool:
    return "À" <= char <= "ÿ"


def cost(text: str) -> int:
    """Sum of the characters' weights; accented Western letters next to each other cost more, as words hold few such."""
    total, before = 0, False
    for char in text:
        total += weight(char)
        now = "\xa1" <= char <= "\xff"
        total += now and before
        before = now
    return total


def _undo_single(text: str, encoding: str) -> str:
    table, cyrillic = byte_of(encoding), encoding in CYRILLIC

    def right(found: re.Match) -> str:
        stretch = found.group()
        try:
            fixed = bytes(table[c] for c in stretch).decode("utf-8")
        except UnicodeDecodeError:
            return stretch
        near = text[max(0, found.start() - 1) : found.start()] + text[found.end() : found.end() + 1]
        letters = any("а" <= c <= "я" for c in near)
        if cyrillic and (letters and fixed[0].isalpha() and len(fixed) < 3 or len(fixed) < 2 and not near.strip().isascii()):
            return stretch
        if cyrillic and any(c >= "\u3000" and c != "�" for c in fixed) and all(c.isalpha() for c in stretch) and (encoding != "cp866" or stretch.islower()):
            return stretch  # a word
        after = text[found.end() : found.end() + 1]
        if len(fixed) == 1 and ("\u0800" <= fixed < "\u2000" or "\u3400" <= fixed < "\u4dc0" or "\ua000" <= fixed < "\ue000" or "\u27c0" <= fixed < "\u2b00" or "\u2c00" <= fixed < "\u3000") and not (after.isascii() and after.isalpha()):
            return stretch  # a letter before two signs, or part of a legacy text
        if any("一" <= c <= "龥" for c in fixed) and (len(fixed) < 2 or any("a" <= c <= "z" for c in near)):
            return stretch
        if all("\xa0" <= c <= "\xbf" and c not in ORDINARY for c in fixed):
            return stretch
        return fixed if cost(fixed) < cost(stretch) else stretch

    return re.sub(f"(?:{garbled_pattern(encoding)})+", right, text)


def _undo_double(text: str) -> str:
    out, at = [], 0
    for run in re.finditer(r"[^\x00-\x7f�]{3,}", text):
        ends, raw = {0: 0}, b""
        for i, char in enumerate(run.group(), 1):
            try:
                raw += char.encode(DOUBLE_BYTE)
            except UnicodeEncodeError:
                raw += b"\x00"
            ends[len(raw)] = i
        for found in _UTF8_BYTES.finditer(raw):
            start, end = found.span()
            if start not in ends:  # it begins in the middle of a character of the run: take the next one
                start = next((s for s in range(start + 1, end) if s in ends and raw[s] >= 0xC2), end)
            fixed = ""
            while end > start and not fixed:
                if end in ends:
                    try:
                        fixed = raw[start:end].decode("utf-8")
                    except UnicodeDecodeError:
                        end -= 1
                else:
                    end -= 1
            if end - start < 6:
                continue
            first, last = run.start() + ends[start], run.start() + ends[end]
            if first >= at and cost(fixed) < cost(text[first:last]):
                out += (text[at:first], fixed)
                at = last
    return "".join(out) + text[at:] if at else text


def _undo_western(text: str, encoding: str) -> str:
    """Legacy bytes that were read as Western ones, decoded as encoding instead."""
    table = byte_of("cp1252") | {chr(c): c for c in range(0x80, 0x100)}

    def right(found: re.Match) -> str:
        stretch = found.group()
        try:
            raw = bytes(table[c] for c in stretch)
            fixed = raw.decode(encoding)
        except UnicodeDecodeError:
            return stretch
        if LOST[1] in fixed or len(raw.decode("utf-8", "ignore").encode()) == len(raw) > 4:
            return stretch  # it is UTF-8 from end to end
        letters = [c for c in fixed if "А" <= c <= "я" or c in "Ёё" or "一" <= c <= "龥"]
        return fixed if len(set(letters)) > 1 and len(letters) * 2 > len(fixed) and cost(fixed) < cost(stretch) else stretch

    return re.sub(WESTERN_RUN, right, text)


def undo_all(text: str) -> list[tuple[str, str]]:
    """(what was undone, the result) for every way to undo one layer of text."""
    tried = [(e, _undo_single(text, e)) for e in SINGLE_BYTE if re.search(garbled_pattern(e), text)]
    if re.search(double_byte_pattern(), text):
        tried.append((DOUBLE_BYTE, _undo_double(text)))
    if re.search(WESTERN_RUN, text):
        tried += [(f"{e} as cp1252", _undo_western(text, e)) for e in READ_AS_WESTERN]
    return [(by, new) for by, new in tried if new != text]


def repair(text: str | None) -> tuple[str | None, list[str]]:
    """(text restored as far as possible, what was undone, outermost first), layer by layer while the cost falls.

    Runs of numeric character references are resolved only where what they stand for is itself to be repaired.
    """
    undone: list[str] = []
    if not text:
        return text, undone
    if "&#" in text and (plain := without_references(text)) != text:
        new, by = repair(plain)
        if by:
            return new, ["references", *by]
    if text.isascii():
        return text, undone
    while True:  # ends, as the cost falls each time
        least, best = cost(text), None
        for by, new in undo_all(text):
            if (now := cost(new)) < least:
                least, best = now, (by, new)
        if best is None:
            break
        undone.append(best[0])
        text = best[1]
    return text, undone


def garbled_texts(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, text, repaired, undone ARRAY<STRING>, lost BOOLEAN): the rows whose text was decoded with a wrong encoding.

    repaired is the text as far as it can be restored; lost tells whether characters are gone for good. ASCII
    texts are passed over in the JVM, and of the others only those that match one compiled pattern are worked on;
    nothing is shuffled. Null, empty and plain ASCII texts without character references aren't found; every copy of a repeated row is; other columns aren't read.
    """
    text = F.col(text_col).cast("string")
    src = df.select(*keys, text.alias("text")).where(text.isNotNull() & (text.rlike(r"[^\x00-\x7f]") | text.contains("&#")))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, repaired, undone, lost = [], [], [], []
            for i, body in enumerate(batch.column("text").to_pylist()):
                if not suspicious(body):
                    continue
                new, by = repair(body)
                gone = any(x in body or x in new for x in LOST)
                if by or gone:
                    kept.append(i)
                    repaired.append(new)
                    undone.append(by)
                    lost.append(gone)
            own = batch.take(pa.array(kept, pa.int32()))
            cols = [pa.array(repaired, pa.string()), pa.array(undone, pa.list_(pa.string())), pa.array(lost, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*own.columns, *cols], [*own.schema.names, "repaired", "undone", "lost"])

    return src.mapInArrow(run, f"{fields}, repaired string, undone array<string>, lost boolean")
