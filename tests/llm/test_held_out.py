"""Hand-made sentences of thirteen languages that share no phrase with the test tables, and contexts of any length."""

import pytest

from tickloom.llm import sentences

#: "|" stands for a boundary.
HELD_OUT = [
    "Gov. Smith spoke.|Then the crowd left.", "The U.S. Army came.|It stayed a week.", "Adm. Lee and Sen. Roy met.|Nobody else did.", "Jan. 5 was cold.|The lake froze.",
    "Col. Ray saw Gen. Hay.|They shook hands.", "He met Sen. Roy on Dec. 5.|It was cold.", "They live on Main St.|The house is old.", "He works for Acme Inc.|She left.",
    "We met at 5 p.m.|He left at 6 a.m. sharp.", "See vol. 3 for more.|Done.", '"Stop!" he cried.|"Why?" she asked.', "The U.K. Parliament met.|The U.N. is in New York.|We left the U.S.|It was fun.",
    "Version 2.5 is out.|3 bugs left.", "J. R. R. Tolkien wrote it.|C. S. Lewis too.", "It costs $3.50.|That is ok.", "Rep. Hall and Lt. Moss agreed.|We did not.", "George Bush Sr. spoke.|He sat.",
    "Herr Dr. Meier kam am 3. Mai.|Er ging.", "Das ist z. B. so.|Ja.", "Nr. 7 fehlt.|Die anderen sind da.", "Er rief: „Halt! Wer da?“|Niemand sprach.",
    "M. Dupont arrive.|Mme. Durand part.", "Il a lu le chap. 4.|Elle dort.", "« Viens ! » cria Paul.|Il courut.",
    "El Sr. López llegó.|La Dra. Ruiz no.", "¿Quién viene?|Nadie lo sabe.", "Vive en EE. UU. desde mayo.|Trabaja mucho.",
    "O Dr. Silva saiu.|A Profa. Lima ficou.", "Leia o cap. 2.|Depois volte.", "Он живёт на ул. Ленина.|Да.", "Купили яблоки, груши и т. д.|Потом ушли.", "Г-н Петров ушёл.|«Когда?» — спросила она.",
    "Ο κ. Παπάς ήρθε.|Πού πήγε;|Δεν ξέρω.", "यह ठीक है।|वह घर गया।|क्या तुम आओगे?", "هل جاء أحمد؟|نعم.|ثم ذهب إلى البيت.", "안녕하세요.|저는 학생입니다.|정말요?",
]
UNSPACED = ["これは本です。|はい！|「そうだ。」と彼は言った。", "今天很好。|明天呢？|“走吧！”他喊道。"]


@pytest.mark.parametrize("case", HELD_OUT)
def test_held_out(case):
    text = case.replace("|", " ")
    assert [text[a:b] for a, b in sentences.sentences(text)] == case.split("|")


@pytest.mark.parametrize("case", UNSPACED)
def test_held_out_without_blanks(case):
    text = case.replace("|", "")
    assert [text[a:b] for a, b in sentences.sentences(text)] == case.split("|")


def test_thai():
    text = "ฉันไปตลาด เธออยู่บ้าน"
    assert [text[a:b] for a, b in sentences.sentences(text)] == text.split(" ")


@pytest.mark.parametrize("n", [1, 100, 500, 5_000])
def test_context_of_any_length(n):
    """Neither the distance to a Greek letter nor that from a quotation to its verb decides."""
    assert len(sentences.sentences("Ποιος " + "1" * n + "; Ναι.")) == 2
    assert len(sentences.sentences("“谁？”" + "A" * n + "问道。不。")) == 2
    assert len(sentences.sentences("Il partit " + "x" * n + " etc. et revint. Oui.")) == 2
    assert len(sentences.sentences("Note: " + "word " * n + "“Go. Now.” said Al. Then he left.")) == 2


def test_first_matching_row_decides():
    """A row of the unit's own language goes before the rows of the others."""
    rows = sentences._of_word("en", "cased", "no"), sentences._of_word("fr", "cased", "no")
    assert rows[0] and rows[1] and all(isinstance(ends, bool) for r in rows for _, _, ends in r)
    assert sentences.language_of("Der Hund und die Katze sind nicht im Haus") == "de" and sentences.language_of("где он") == "ru" and sentences.language_of("12 34") == "en"
