import pytest

from docmill.llm import mojibake
from docmill.llm.mojibake import repair, suspicious

GERMAN = "Die geprüfte Übersicht, gemäß der Absprache – «größer» als 5 €."
FRENCH = "Le relevé égaré à l'usine du littoral précise l'échéance prévue."
RUSSIAN = "Общий баланс заменяет порядок приёмки сверх плана."
CHINESE = "若采购订单超过了库存上限，则缺失的页码应由值班人员处理。"


def garble(text, encoding):
    out = []
    for byte in text.encode("utf-8"):
        try:
            out.append(bytes([byte]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(byte))
    return "".join(out)


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250"])
@pytest.mark.parametrize("text", [GERMAN, FRENCH])
def test_round_trip(text, encoding):
    bad = garble(text, encoding)
    assert suspicious(bad) and repair(bad)[0] == text


@pytest.mark.parametrize("encoding", ["cp1251", "cp866", "cp1252", "latin-1"])
def test_round_trip_of_cyrillic(encoding):
    assert repair(garble(RUSSIAN, encoding))[0] == RUSSIAN


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1"])
def test_round_trip_of_ideographs(encoding):
    assert repair(garble(CHINESE, encoding))[0] == CHINESE


def test_layers_and_parts():
    twice = garble(garble(FRENCH, "cp1252"), "cp1252")
    assert repair(twice) == (FRENCH, ["cp1252", "cp1252"])
    assert repair(f"{GERMAN} {garble(FRENCH, 'mac_roman')} {garble(FRENCH, 'cp1252')}")[0] == f"{GERMAN} {FRENCH} {FRENCH}"


def test_references_to_garbled_characters():
    bad = "".join(f"&#{ord(c)};" if c > "\x7f" else c for c in garble(FRENCH, "cp1252"))
    assert bad.isascii() and suspicious(bad) and repair(bad) == (FRENCH, ["references", "cp1252"])
    assert repair("caf&#233; &#8364;&#8364; &amp; &#49;&#50;&#51;") == ("caf&#233; &#8364;&#8364; &amp; &#49;&#50;&#51;", [])


def test_legacy_bytes_read_as_western():
    assert repair(RUSSIAN.encode("cp1251").decode("cp1252"))[0] == RUSSIAN
    assert repair("采购订单超过库存上限".encode("gbk").decode("latin-1"))[0] == "采购订单超过库存上限"


@pytest.mark.parametrize(
    "text",
    [GERMAN, FRENCH, RUSSIAN, CHINESE, "Гёте и Её «АБВ»", "La niña «É» créée", "├── runs └── export", "√2 ∂x ≠ ∞", "1.1 x ···· 6", "ＡＢＣ Ω µ", "`¬§_|¦¬§"],
)
def test_right_texts_stay(text):
    assert repair(text) == (text, [])


@pytest.mark.parametrize("encoding", mojibake.SINGLE_BYTE)
@pytest.mark.parametrize("text", ["donn�es", "les donn��es"])
def test_misread_replacement_characters(encoding, text):
    bad = garble(text, encoding)
    assert suspicious(bad) and any(x in bad for x in mojibake.LOST) and "锟斤拷" not in repair(bad)[0]
    assert encoding in mojibake.CYRILLIC or repair(bad)[0] == text


@pytest.mark.parametrize("text", ["□ item", "✓ done ● open", "① first", "12 ㎡", "대한민국", "Tiếng Việt", "שלום"])
def test_all_valid_sequences(text):
    bad = garble(text, "cp1252")
    assert suspicious(bad) and repair(bad)[0] == text


@pytest.mark.parametrize("encoding", ["cp1251", "cp866"])
@pytest.mark.parametrize("text", ["中文", CHINESE])
def test_ideographs_read_as_cyrillic(encoding, text):
    bad = garble(text, encoding)
    assert suspicious(bad) and repair(bad)[0] == text


@pytest.mark.parametrize("text", ["шалфей и шалфей", "дії її дії", "«voilà»… «está»… «irmã»… «né»…", "Он сказал: «да»… «и»…", "9,402,395Ôª¡£"])
def test_words_before_signs_stay(text):
    assert repair(text) == (text, [])


def test_rows(spark):
    rows = [(1, garble(FRENCH, "cp1252"), "x"), (1, garble(FRENCH, "cp1252"), "x"), (2, None, "x"), (3, "", "x"), (4, FRENCH, "x"), (5, "lost � here", "x"), (6, "锟斤拷", "x"), (7, GERMAN * 2000, "x")]
    df = spark.createDataFrame(rows, "id bigint, text string, repaired string")
    got = sorted((r["id"], r["repaired"], r["lost"]) for r in mojibake.garbled_texts(df, ["id"], "text").collect())
    assert got == [(1, FRENCH, False), (1, FRENCH, False), (5, "lost � here", True), (6, "锟斤拷", True)]
    assert mojibake.garbled_texts(df.limit(0), ["id"], "text").collect() == []


def test_any_number_of_layers():
    text = garbled = "Prüfung der Größe"
    for _ in range(6):
        garbled = garbled.encode("utf-8").decode("latin-1")
    assert mojibake.repair(garbled) == (text, ["latin-1"] * 6)
