import pytest

from docloom.llm.garbled import garbled, repair_batch

CLEAN = [
    "Der Kühlkreis läuft bei 12 °C, die Förderpumpe übersteht 4 m³ je Stunde.",
    "La pompe de décantation dépasse 12 µm après l'été, où l'échangeur cède.",
    "Смена отмечает показатель «мутность» каждое утро при 34 °C.",
    "ОТСТОЙНИК И НАСОС. Входной клапан работает.",
    "Operators call this the “clamp bolt” rule – see §45.",
    "CÂMARA FRIA, PRESSÃO 12 KPA, RELATÓRIO DA SEÇÃO.",
    "Ðorvik and Åsele list 4.2 rpm; it fell to € 666; the â-series.",
    "├── src/main.c\n│   └── lib",
    "ran at 197 &#176;C &#8211; see page 42, caf&eacute; &amp; more",
    "Größe: 5 × 3 ± 2 Ω, naïve façade, ångström, œuvre, ½ ¶39 ¿qué?",
    "plain ascii text", "", "北京市海淀区 は東京です。",
]


def test_clean_texts_are_left_alone():
    assert [r for r in repair_batch(CLEAN) if r[1] or r[2]] == []


LONG = {"de": CLEAN[0], "fr": CLEAN[1], "ru": CLEAN[2], "en": "Operators call this the “clamp bolt” rule – at 12 °C or 5 µm."}


@pytest.mark.parametrize("wrong", ["cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866"])
@pytest.mark.parametrize("lang", LONG)
def test_utf8_read_as_another_encoding_is_restored(wrong, lang):
    raw = LONG[lang].encode()
    try:
        seen = "".join(bytes([b]).decode(wrong) if not (wrong == "cp1252" and b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)) else chr(b) for b in raw)
    except UnicodeDecodeError:
        pytest.skip("the encoding lacks a byte")
    (text, names, lost), = repair_batch([seen])
    assert names and text == LONG[lang] and not lost


@pytest.mark.parametrize("right,wrong", [("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "koi8_r")])
def test_cyrillic_read_as_another_one_byte_encoding(right, wrong):
    original = "Смена отмечает показатель каждое утро"
    (text, names, _), = repair_batch([original.encode(right).decode(wrong, "replace")])
    assert names and text == original


def test_double_garbling_entities_and_losses():
    twice = "42 µm".encode().decode("cp1252").encode().decode("cp1252")
    assert repair_batch([f"about {twice} here"])[0][0] == "about 42 µm here"
    assert repair_batch(["73 &#206;&#169; of play"])[0][0] == "73 Ω of play"
    text, names, lost = repair_batch(["pr�ft t�glich"])[0]
    assert not names and lost


def test_half_of_a_text():
    text = "Erst läuft es. " + "Dann fällt die Förderpumpe aus.".encode().decode("latin-1")
    assert repair_batch([text])[0][0] == "Erst läuft es. Dann fällt die Förderpumpe aus."


def test_frame(spark):
    bad = "FÃ¶rderpumpe"
    rows = [("d", 1, bad, 1), ("d", 1, bad, 2), ("d", 2, None, 3), (None, None, bad, 4), ("e", 1, "Förderpumpe", 5), ("f", 1, "x" * 100_000 + bad, 6)]
    df = spark.createDataFrame(rows, "doc_id string, ord int, text string, restored int")
    out = garbled(df).collect()
    assert sorted(((r["doc_id"], r["ord"]) for r in out), key=str) == [("d", 1), ("f", 1), (None, None)]
    assert {r["restored"][-11:] for r in out} == {"Förderpumpe"}
    assert garbled(df.limit(0)).count() == 0
