"""Sentence boundaries across languages and scripts (problem 10).

Cascading segmentation rule tables. The layout table cuts a text into units
(paragraphs, headings, key/value lines, list items, speaker lines); the quotation
table protects what stands between paired quotes. Every mark of a unit that could end a
sentence is then asked of a cascade of rule tables: the shared one, that of the unit's
language or script, those of the other languages of the script, and the last one. A row
of a table is a pair of patterns, for what stands before and behind the position, with
the verdict break or no break; the first row whose two patterns match decides. Rows for
words (abbreviations, titles, months, units) are found by the word before the mark.

Patterns see the whole unit on both sides. Documents are independent: one pass in
Python, no shuffle, whole texts.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: the languages' words -------------------------------------------------

#: Frequent words by which the language of a unit in Latin script is told.
FREQUENT = {
    "en": "the of and to in is was it for on with that this at by from not are be as no we you they had has have its but or",
    "de": "der die das und ist nicht ein eine im am den dem von mit auf für zu war wir sie es auch nach bei aus wird sind oder",
    "fr": "le la les des et est un une du au que qui dans pour pas sur avec ne ce cette nous vous il elle sont ou",
    "es": "el la los las y es un una de del que en para no con por se su al lo como más está son o",
    "pt": "o a os as e é um uma de do da que em para não com por se no na ao mais foi são ou",
}
#: Titles and ranks, written with a capital, in front of a name.
TITLES = {
    "en": "mr mrs ms mx messrs dr drs prof rev fr st hon pres gov sen rep amb sec gen adm col maj capt cmdr comdr lt sgt cpl pvt brig supt insp det mt ft",
    "de": "hr hrn fr frl dr prof dipl ing mag st hl präs",
    "fr": "m mm mme mmes mlle mlles dr drs pr prof me st ste mgr gal",
    "es": "sr sra sres sras srta d dña dr dra dres prof profa lic ing gral cap cnel sto sta",
    "pt": "sr sra srs sras srta dr dra drs prof profa eng enga d gal cel cap sto sta exmo exma",
    "ru": "г-н г-жа проф акад др им ул пр пл гл тов св",
    "el": "κ κα κος κκ δρ καθ αγ στρ",
    "hi": "डॉ श्री श्रीमती सुश्री प्रो पं सं मो कु", "ar": "د أ م ص ج",
}
#: In front of a number: parts of documents, numbers, months.
NUMBERED = {
    "en": "no nos nr fig figs eq eqs sec sect ch chap vol vols art arts p pp par para cl tab ref dept ex ver rev av est cap max min jan feb mar apr jun jul aug sep sept oct nov dec tel ext approx avg",
    "de": "nr abs art kap abb tab bd s str st ziff anm jh jan feb mär apr jun jul aug sep sept okt nov dez tel max min ca",
    "fr": "art chap fig p pp vol éd n no nos env av tél max min janv févr avr juil sept oct nov déc ch cap st ste",
    "es": "art núm núms pág págs cap fig figs vol tel tél máx mín avda av ene feb mar abr jun jul sept sep oct nov dic n p",
    "pt": "art arts núm pág págs cap fig figs vol tel máx mín av jan fev mar abr mai jun jul nov dez n p",
    "ru": "см табл рис стр гл ст п пп ч т тел янв февр апр авг сент окт нояб дек",
    "el": "σελ αρ άρθρ κεφ εικ πίν τηλ ιαν φεβ μαρ απρ ιουν ιουλ αυγ σεπ οκτ νοε δεκ",
}
#: A sentence goes on behind these, whatever follows.
INNER = {
    "en": "vs cf viz e.g i.e incl resp approx avg ca ibid op cit fig figs nos pp vol ch sect eq",
    "de": "vgl bzw evtl ggf inkl exkl zzgl sog z.b d.h u.a o.ä u.u i.d.r ca abb kap tab abs art dipl ing tel",
    "fr": "cf env p.ex c.-à-d éd tél fig chap vol art", "es": "p.ej ej aprox núm núms pág págs fig tel avda vol art",
    "pt": "p.ex ex i.e aprox pág págs fig núm tel vol art", "ru": "см табл рис напр т.е ср стр", "el": "βλ π.χ δηλ σελ αρ", "hi": "", "ar": "",
}
#: These may end a sentence, if what follows can begin one.
CLOSING = {
    "en": "etc ltd inc co corp plc llc llp bros jr sr esq a.m p.m a.d b.c u.s u.k e.u u.n u.s.a d.c ph.d m.d b.a m.a dept dev",
    "de": "usw etc u.s.w co gmbh ag e.v u.v.m o.g std", "fr": "etc cie s.a s.a.r.l", "es": "etc ee.uu uu cía s.a s.l ltda", "pt": "etc ltda cia s.a e.u.a",
    "ru": "т.п т.д др пр руб коп тыс млн млрд гг г", "el": "κ.λπ κλπ κ.ά κ.λ.π α.ε π.χ μ.μ π.μ", "hi": "", "ar": "",
}
#: Units of measure and parts of names that are units behind a number only.
UNITS = {
    "en": "min sec hr hrs ft in oz lb lbs yd mi sq pt pts max est s.d", "de": "min sek std stk st mio mrd tsd max", "fr": "min sec h max", "es": "min seg h máx", "pt": "min seg h máx",
    "ru": "мин сек ч г кг м см шт др", "el": "λεπ δευτ ώρ",
}
#: Nouns that carry a country's abbreviation.
STATE = "Army Navy Air Marine Marines Coast Congress Senate House Supreme Treasury Department Dept President Government Federal Securities District Court Bank Census Capitol Postal Secretary Attorney Dollar Steel Open Embassy Ambassador State Justice Constitution Patent Geological Forces Ministry Parliament Council General Assembly session sessions market markets open dollar economy government stocks bonds futures equities hours holiday holidays"
#: Verbs of speaking after a quotation; the quotation is then carried by their sentence.
SPEAKING = (
    "asked wrote said says replied answered added shouted noted writes asks told cried explained whispered called | fragte schrieb sagte meinte rief antwortete notierte erklärte | a dit demande demanda écrit "
    "répondit dit écrivit ajouta cria | escribió preguntó dijo respondió añadió gritó | escreveu perguntou disse respondeu gritou | написал написала спросил спросила сказал сказала ответил ответила | έγραψε ρώτησε είπε απάντησε φώναξε"
).replace("|", " ").split()
#: After a closed quotation these carry on in scripts without case.
CARRYING_ON = r"と|が|を|は|に|の|も|って|などと|という|라고|이라고|하고|고|라는|ثم|و(?=\p{Arabic})|और|कहकर|लिखकर|कि|คือ|และ"
#: Chinese words by which a quotation in front is attributed.
ZH_SPEAKING = r"[^。！？，；\n“”「」]*?(?:问道|说道|写道|答道|喊道|问|说|写|答|喊)"
#: Words that carry a sentence on in lower case: auxiliaries, conjunctions, what seldom begins one.
LINKING = (
    "are is was were be been has have had of per than and or but | und oder ist sind war waren | et ou est sont avant pour | y o son para antes | e são "
    "| и или за до для больше | και ή είναι για πριν"
).replace("|", " ").split()
#: Time zones after a.m. and p.m.
ZONES = r"(?:Eastern|Central|Mountain|Pacific|Atlantic|ET|CT|MT|PT|E[SD]T|C[SD]T|M[SD]T|P[SD]T|GMT|UTC|CET|CEST|BST)\b"
#: German words in front of an ordinal number, and months behind one.
DE_ORDINAL = r"(?i:am|an|ab|bis|vom|von|zum|zur|im|in|dem|den|der|die|das|des|beim|jeder|jede|jedes|unser|unsere|mein|meine|seit|und)"
DE_MONTHS = r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)"

# ---- characters -------------------------------------------------------------------------

PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "„": "“”", "‘": "’", "‹": "›", "《": "》", "〈": "〉"}
CLOSERS = "\"'”’»」』›》〉)]）］】"
TERMINAL = ".!?…。！？؟।॥｡．‼⁇⁈⁉۔։።။"
WIDE = "。！？｡．"
EMOJI = r"(?:[\p{Extended_Pictographic}--[0-9#*©®™]]|[\U0001F1E6-\U0001F1FF]{2})(?:️|[\U0001F3FB-\U0001F3FF]|‍\p{Extended_Pictographic})*"
V1 = regex.V1
_rx = cache(regex.compile)
_OPENERS = regex.compile("[\"" + "".join(PAIRS) + "]")
_TERMINALS = regex.compile(rf"[{regex.escape(TERMINAL)}]+")
_EMOJI_RUN = regex.compile(rf"(?:[^\S\n\r]*{EMOJI})+", V1)
_EMOJI_ONE = regex.compile(EMOJI, V1)
_LINE = regex.compile(r"[^\n\r\v\f\u0085  ]*(?:\r\n|[\n\r\v\f\u0085  ]|$)")
_OPEN_MARKS = r"[\"'“„«‘「『(\[¿¡（]*"

# ---- layout table -----------------------------------------------------------------------

#: A line that begins like this starts a unit of its own, wherever it stands.
STRONG = [
    regex.compile(r"\s*[-*+•‣·]\s+[\p{L}\p{N}$]"),                      # list item
    regex.compile(r"\s*#{1,6}\s+\p{L}"),                                # marked heading
    regex.compile(r"\s*v\d+(?:\.\d+)+\b.*\(\d{4}-\d\d-\d\d\)\s*$"),    # version heading
    regex.compile(r"\s*\p{Lu}[\p{Latin}\p{Cyrillic}\p{Greek}\p{M}'’-]+:\s"),  # speaker
    regex.compile(r"\s*\p{Lu}[\p{L}.  ]{0,30}[^\S\n]\.{4,}"),           # key ..... value
    regex.compile(r"\s*--\s?\p{Lu}"),                                  # signature
    regex.compile(r"\s*(?:Best|Thanks|Regards|Cheers|Saludos|Gracias|Merci|Cordialement|Grüße|Danke|Abraços|Obrigado)\b[,!]?\s\p{Lu}\p{L}*\s*$"),
]
#: Of these not even a wrapped text has one inside a sentence.
LISTED = regex.compile(r"\s*(?:[-*+•]\s+\p{Lu}\p{Ll}|#{1,6}\s+\p{L}|v\d+(?:\.\d+)+\s*\(\d{4}-\d\d-\d\d\)\s*$)")
#: Of these the line is the whole unit: headings, dotted leaders, signatures.
WHOLE = [STRONG[1], STRONG[2], STRONG[4], STRONG[5], STRONG[6]]
#: These start a unit only behind a line that is itself complete: the same shapes occur
#: where a text was broken before an ordinal or an initial.
WEAK = [regex.compile(r"\s*(?:(?:\d{1,3}[.)]|\(\p{L}\))\s+\p{L}|(?:\d{1,2}(?:\.\d{1,2})+\.?|\p{Lu}[.)])\s+[\p{Lu}\p{Lo}])")]
#: A line like this is code and never divided.
CODE = regex.compile(r"(?!.*[.!?]\s+\p{Lu}\p{Ll})(?!(?:[^()]|\([^()]*\))*\)(?:[^()]|\([^()]*\))*$)\s*(?:(?:if|for|while|def|return|import|run|let|var|const)\b.*(?:\w\[|\w\(|\s--\w).*|[\w.\[\]]+\s*(?:=|\+=|-=|:=)\s*\S.*|[\w.]+\(.*\)\s*;?|\w+=\S+;.*)\s*$")
#: Key and value on one line, never divided.
KEYED = regex.compile(r"\s*[\p{Lu}\p{Lo}][\p{L}\p{M}.  ]{0,30}?\s*(?:[:=：]|\.{4,})\s*[-+$€£]?\s*[\d][\d.,\s%$€£: ]*$")
#: A first line like this is a greeting or a heading.
OPENING = regex.compile(r"\s*(?:\p{L}+[ \u00a0]){0,2}\p{Lu}\p{L}*\s*[,:،，]?\s*$|\s*\p{Lu}\p{Ll}+(?: \p{Ll}+){0,2}\s*$")


_CODED = regex.compile(r"[=(\[]|--")
_OPEN_CODE = regex.compile(r"[;=<>(,+*-]$|//$")


def _is_code(line: str) -> bool:
    return _CODED.search(line) is not None and CODE.match(line) is not None


def _ends_sentence(line: str) -> bool:
    line = _EMOJI_RUN.sub("", line).rstrip().rstrip(CLOSERS + "“ \u00a0")
    if not line or line[-1] not in TERMINAL + ";":
        return False
    last = _rx(r"([\p{L}\p{M}.]+|\b\d{1,2})\.$").search(line)
    return last is None or not (len(last[1]) == 1 and not _rx(r"\d\s?\p{Ll}\.$").search(line) or last[1].isdigit() or unicodedata.normalize("NFC", last[1]).lower() in _LEADING)


def units(text: str) -> list[tuple[int, int]]:
    """Spans that no sentence crosses.

    Blank lines always divide, and so do the breaks around key/value lines, marked
    headings, dotted leaders and signatures and in front of speakers and list items.
    The other single breaks are of two kinds: if more of the lines that start a unit
    stand behind a single break than behind a blank line, the lines of the text are
    units and every break divides; else the text was wrapped and a break is a blank,
    except behind a greeting or heading in the first line and around code.
    """
    lines = []
    for m in _LINE.finditer(text):
        if m.end() > m.start():
            lines.append((m.start(), text[m.start():m.end()].strip()))
    if len(lines) < 2:
        return [(0, len(text))]
    first = next((i for i, x in enumerate(lines) if x[1]), 0)
    # The shapes of each line, looked at once.
    bodies = [body for _, body in lines]
    strong = [next((k for k, p in enumerate(STRONG) if p.match(body)), None) if body else None for body in bodies]
    keyed = [bool(body) and KEYED.match(body) is not None for body in bodies]
    code = [bool(body) and _is_code(body) for body in bodies]
    weak = [bool(body) and WEAK[0].match(body) is not None for body in bodies]

    def starts(i: int) -> bool:
        if strong[i] is not None or keyed[i]:
            return True
        prior = bodies[i - 1]
        if code[i]:
            return _ends_sentence(prior) or (code[i - 1] and not _OPEN_CODE.search(prior))
        return weak[i] and (_ends_sentence(prior) or strong[i - 1] is not None or weak[i - 1] or keyed[i - 1] or code[i - 1] or (i - 1 == first and OPENING.match(prior) is not None))

    def whole(i: int) -> bool:
        """Whether the line is a unit, unless what follows carries it on in lower case."""
        return (keyed[i] or strong[i] is not None and any(p.match(bodies[i]) for p in WHOLE)) and not bodies[i + 1][:1].islower()

    def shaped(i: int) -> bool:
        """Whether the shapes of the lines around this break divide them, however the text is laid out."""
        body = bodies[i]
        if strong[i] == 0 and not LISTED.match(body):  # else a minus or plus in a wrapped sentence
            return whole(i - 1) or _ends_sentence(bodies[i - 1])
        return whole(i - 1) or keyed[i] or strong[i] is not None or LISTED.match(body) is not None

    single = [i for i in range(1, len(lines)) if bodies[i] and bodies[i - 1]]
    spaced = sum(strong[i] is not None or weak[i] or keyed[i] or code[i] for i in range(first + 1, len(lines)) if bodies[i] and not bodies[i - 1])
    divided = sum(map(starts, single)) > spaced
    out: list[tuple[int, int]] = []
    begin = None
    for i, (at, body) in enumerate(lines):
        if not body:
            if begin is not None:
                out.append((begin, at))
            begin = None
        elif begin is None:
            begin = at
        elif divided or shaped(i) or (code[i - 1] and not code[i] and _rx(r"\p{Lu}\p{Ll}|\p{Lo}").match(body)) or (i - 1 == first and OPENING.match(lines[first][1]) and not body[0].islower() and body[0] not in "$€"):
            out.append((begin, at))
            begin = at
    if begin is not None:
        out.append((begin, len(text)))
    return out


# ---- quotation table --------------------------------------------------------------------

def quotations(text: str) -> list[tuple[int, int]]:
    """(open, after close) of outermost paired quotes; unpaired ones are ordinary marks."""
    out, i, n = [], 0, len(text)
    absent: set[str] = set()  # closers of which no more follow
    while (m := _OPENERS.search(text, i)) is not None:
        begin = m.start()
        close = PAIRS.get(text[begin], '"')
        i = begin + 1
        if close in absent:
            continue
        j = i
        while True:
            at = min((k for k in (text.find(x, j) for x in close) if k >= 0), default=-1)
            if at >= 0 and close == "’" and at + 1 < n and text[at + 1].isalpha() and text[at - 1].isalpha():
                j = at + 1  # an apostrophe
                continue
            break
        if at < 0:
            absent.add(close)
        else:
            out.append((begin, at + 1))
            i = at + 1
    return out


# ---- rule tables ------------------------------------------------------------------------

class Row(NamedTuple):
    """A pair of patterns and the verdict. ``words``: the word before the mark is one of
    these; ``before`` ends at the position, ``after`` begins there, "" is anything;
    ``style``: 'small' and 'cased' rows hold in texts whose sentences begin with small
    letters, or with capitals, only."""

    words: frozenset[str] | None
    before: str
    after: str
    ends: bool
    style: str = ""


def _w(text: str) -> frozenset[str]:
    return frozenset(text.split())


_OPEN = r"[\s\"'“„«‘「『(\[¿¡（]*+"
_SHUT = f"[{regex.escape(CLOSERS)}]*"
#: A capital, digit or letter without case begins a sentence; so does the end of the unit.
_BEGINS = _OPEN + r"(?:[^\p{Ll}]|$)"
_NUMBER = _OPEN + r"[$€£#№]?\s?(?:\p{N}|[IVXLC]{2,}\b)"
_NAME = _OPEN + r"\p{Lu}"
#: A small letter of the script of the last letter before.
_SMALL = [(rf"(?:\p{{{x}}}\P{{L}}*)", _OPEN + rf"[\p{{Ll}}&&\p{{{x}}}]") for x in ("Latin", "Cyrillic", "Greek")] + [(r"(?:^\P{L}*)", _OPEN + r"\p{Ll}")]
_LINK = _OPEN + "(?:" + "|".join(sorted(set(LINKING), key=lambda x: (-len(x), x))) + r"|(?:before|after|while|without|by|when)\s\p{Ll}+ing)\b"


def _goes_on(words: frozenset[str] | None, before: str, style: str = "cased") -> list[Row]:
    """No break where a small letter of the same script follows."""
    return [Row(words, rf"{b}(?<={before})" if before else b, a, False, style) for b, a in _SMALL]


#: Marks other than the period, and periods with no blank behind them.
UNSPACED = [
    Row(None, rf"[!?]{_SHUT}", r"(?=\S)" + _OPEN + r"[^\s\p{Lu}\p{Lo}]", False),
    Row(None, r"[^.…]" + _SHUT, "", True),
    Row(None, rf"[.…][{regex.escape(CLOSERS)}]+", r"(?=\S)" + _OPEN + r"[\p{Lu}\p{Lo}]", True),
    Row(None, rf"[.…][{regex.escape(CLOSERS)}]+", r"\S", False),
]
ELLIPSIS = [
    Row(None, r"\.{4,}" + _SHUT, "", False),                                                   # leaders of a table line
    Row(None, r"(?:…|\.{3})" + _SHUT, r"\s*(?:[都也等就还]|など|という|と)", False),              # an enumeration goes on
    Row(None, r"(?i:\b(?:hm+|uh+|um+|er+|well|so|and|oh|ah))(?:…|\.{3})" + _SHUT, _OPEN + r"\p{Ll}", False),  # a pause
    Row(None, r"(?:…|\.{3})" + _SHUT, r"\s*(?:and|but|or|then|et|mais|y|e|pero|mas|und|oder|aber|и|но|και)\b", False),
    *_goes_on(None, r"(?:…|\.{3})" + _SHUT),
    Row(None, r"(?:…|\.{3})" + _SHUT, "", True),
    Row(None, r"\.\p{L}\w*\.", r"\S", False),                                                # inside a name with dots
    Row(None, r"(?:\p{Ll}\p{Ll}|\d|[)\]%])\.", r"\p{Lu}(?:[\p{Ll}'’\u00a0 ]|\.\s?\p{Lu}|\p{Lu}{2} \d)", True),  # a blank is missing
    Row(None, "", r"\S", False),
]


def _language(x: str) -> list[Row]:
    """The table of a language out of its words: titles, numbers, units, closing words."""
    units = _w(UNITS.get(x, ""))
    closing = _w(CLOSING[x])
    known = _w(TITLES[x]) | _w(NUMBERED.get(x, "")) | _w(INNER[x])
    behind = r"\p{N}[\s ]*[\p{L}\p{M}.]+\." + _SHUT
    small = [Row(w, "", _LINK, False, "small") for w in (closing,)]
    return [
        Row(units, behind, _BEGINS, True), *_goes_on(units, behind), *[Row(units, behind, _LINK, False, "small")], Row(units, behind, "", True, "small"),
        Row(_w(INNER[x]), "", _NUMBER, False), Row(_w(NUMBERED.get(x, "")), "", _NUMBER, False),
        Row(_w(TITLES[x]), rf"\b(?:\p{{Lu}}|[\p{{Lo}}])[\p{{L}}\p{{M}}\-]*\.{_SHUT}", _OPEN + r"[\p{Lu}\p{Lo}]", False),
        Row(_w(INNER[x]) - closing, "", "", False),
        Row(closing & known, "", _OPEN + r"\p{Lu}", True),
        Row(units - closing, "", "", False),
        *small, *_goes_on(closing, ""), Row(closing, "", "", True),
        Row(_w(NUMBERED.get(x, "")) - units, "", "", True, "small"), *_goes_on(frozenset(w for w in _w(NUMBERED.get(x, "")) if len(w) < 3), ""),
        Row(_w(TITLES[x]) - _w(NUMBERED.get(x, "")), "", _OPEN + r"[\p{L}]", False),
    ]


SHARED = [
    Row(_w("u.s u.k e.u u.n u.s.a"), "", r"\s+(?:" + "|".join(STATE.split()) + r")(?:'s|’s)?\b", False),
    Row(_w("sr jr"), r"\b\p{Lu}\p{L}{2,},?\s+[SJ]r\.", _BEGINS, True), Row(_w("sr"), "", _NAME, False),
    Row(_w("st ave rd blvd"), r"\b\p{Lu}\p{L}+\s+(?:St|Ave|Rd|Blvd)\.", _OPEN + r"(?:The|It|He|She|We|They|I|A|An|This|That|You|But|And|In|On|At)\b", True),
    Row(_w("a.m p.m m"), r"(?i:[ap]\.\s?m)\.", r"\s*" + ZONES, False),
    Row(None, r"\b[Nn]o\.", _OPEN + r"\p{N}", False), Row(None, r"\b[Nn]o\.", "", True),
    Row(None, r"\b" + DE_ORDINAL + r"\s+\d{1,2}\.", r"\s*\p{L}", False),
    Row(None, r"\b\d{1,2}\.", r"\s*" + DE_MONTHS, False),
    Row(None, r"(?<![\p{L}\p{N}])(?:z|d|u|i|o|s|p|v)\.\s*(?:B|h|a|e|ä|o|u|ej|ex|Chr)\.", "", False),
    Row(None, r"(?<![\p{L}\p{N}])т\.\s*е\.", "", False),
    Row(None, r"(?<![\p{L}\p{N}])т\.\s*[пд]\.", _BEGINS, True),
    Row(None, r"(?<![\p{L}\p{N}])т\.\s*[пд]\.", _LINK, False, "small"), Row(None, r"(?<![\p{L}\p{N}])т\.\s*[пд]\.", "", False, "cased"), Row(None, r"(?<![\p{L}\p{N}])т\.\s*[пд]\.", "", True),
    Row(None, r"\d\s*гг?\.", _OPEN + r"[\p{Lu}\p{N}]", True),
    Row(None, r"\bet\s+al\.", _OPEN + r"[\p{Ll}\p{N}]", False),
    Row(_w("ee"), "", r"\s*UU\.", False),
    Row(_w("e.g i.e s.d p.ej"), "", "", False),
    Row(_w("st"), "", r"\s*dev\b", False),
]
#: What no table knows: a single letter is an initial unless it is a unit behind a number.
LAST = [
    Row(None, r"\p{N}[\s ]*\p{Ll}\." + _SHUT, _BEGINS, True),
    *_goes_on(None, r"\p{N}[\s ]*\p{Ll}\." + _SHUT), Row(None, r"\p{N}[\s ]*\p{Ll}\." + _SHUT, "", True),
    Row(None, r"(?<![\p{L}\p{M}])[\p{L}--[\p{Thai}\p{Han}\p{Hangul}]]\p{M}*\." + _SHUT, "", False),
    *_goes_on(None, r"(?<![\p{L}\p{M}])\p{L}{2}\." + _SHUT),
    Row(None, "", "", True),
]
LATIN = ("en", "de", "fr", "es", "pt")
_OTHER = {"Cyrillic": "ru", "Greek": "el", "Devanagari": "hi", "Arabic": "ar"}
_LEADING = {w for x in TITLES for w in (*TITLES[x].split(), *INNER[x].split())}
_KNOWN = _LEADING | {w for v in (*NUMBERED.values(), *CLOSING.values(), *UNITS.values()) for w in v.split()} | {w for r in SHARED for w in r.words or ()}
_TABLES = {x: _language(x) for x in TITLES}


@cache
def _general(last: bool, style: str) -> tuple[regex.Pattern, list[bool]]:
    """The rows for any word, of the shared tables or the last one, as one pattern whose
    groups stand for the rows, in order, and the rows' verdicts."""
    rows = [r for r in (LAST if last else UNSPACED + ELLIPSIS + SHARED) if r.words is None and r.style in ("", style)]
    pairs = [(f"(?<={r.before})" if r.before else "") + (f"(?={r.after})" if r.after else "") + "()" for r in rows]
    return regex.compile("|".join(pairs), V1), [r.ends for r in rows]


@cache
def _of_word(language: str, style: str, word: str) -> list[tuple[regex.Pattern | None, regex.Pattern | None, bool]]:
    """The rows for one word: the shared ones, those of the language, those of the others."""
    order = [language, *[x for x in (*LATIN, "ru", "el", "hi", "ar") if x != language]]
    rows = [r for r in SHARED + [r for x in order for r in _TABLES[x]] if r.words is not None and word in r.words and r.style in ("", style)]
    return [(_rx(f"(?<={r.before})", V1) if r.before else None, _rx(r.after, V1) if r.after else None, r.ends) for r in rows]


_WORD = regex.compile(r"(?r)[\p{L}\p{M}](?:[\p{L}\p{M}.\-]*[\p{L}\p{M}])?", V1)
_ITEM = regex.compile(r"[\s(]*\d[\s(\d]*\.")
_FIRST = regex.compile(r"\p{L}")
_FREQUENT = {w: [x for x in LATIN if w in FREQUENT[x].split()] for v in FREQUENT.values() for w in v.split()}
_NOT_LATIN = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Devanagari}\p{Arabic}]")
_SCRIPTS = [(_x, regex.compile(rf"\p{{{_s}}}")) for _s, _x in _OTHER.items()]


def _word_before(text: str, end: int, start: int = 0) -> str:
    m = _WORD.match(text, start, end)
    return unicodedata.normalize("NFC", m.group()).lower() if m else ""


@lru_cache(maxsize=4)
def language_of(text: str) -> str:
    """Language whose table is asked first: that of the most letters' script, in Latin
    script that of the most frequent words; English where nothing tells."""
    if _NOT_LATIN.search(text):
        for x, script in _SCRIPTS:
            if 2 * len(script.findall(text)) >= len(_rx(r"\p{Latin}").findall(text)) and script.search(text):
                return x
    votes = dict.fromkeys(LATIN, 0)
    for w in text.lower().split():
        for x in _FREQUENT.get(w, ()):
            votes[x] += 1
    return max(LATIN, key=votes.__getitem__)


def decide(text: str, start: int, mark: int, end: int, small: bool) -> bool:
    """Whether the sentence from ``start`` ends at ``end``, behind the mark and its closers."""
    word, long = "", False
    if text[mark] == ".":
        if (m := _ITEM.match(text, start)) and m.end() == mark + 1:
            return False  # nothing but the item's number so far
        word = _word_before(text, mark, start)
        long = len(word) > 2 and word.isalpha()
        word = word if word in _KNOWN else ""
        if word and small and (first := _FIRST.search(text, start, end)) and first.group().isupper():
            small = False  # this sentence began with a capital, so will the next
    style = "small" if small else "cased"
    pattern, verdicts = _general(False, style)
    if m := pattern.match(text, end):
        return verdicts[m.lastindex - 1]
    if word:
        for before, after, ends in _of_word(language_of(text), style, word):
            if (before is None or before.match(text, end)) and (after is None or after.match(text, end)):
                return ends
    if long:
        return True  # but for its last row, the last table is about words of one or two letters
    pattern, verdicts = _general(True, style)
    return verdicts[pattern.match(text, end).lastindex - 1]


# ---- behind a quotation -----------------------------------------------------------------

_FRONT = regex.compile(r"\s*(?:[^\s:：]+(?:[^\S\n][^\s:：]+){0,2}[:：])?[\s\-*+•#0-9.]*")
_SPEAKS = regex.compile(_OPEN + "(?:" + "|".join(SPEAKING) + r")\b")
#: (before, after, ends); before is matched from the sentence's start up to the quotation.
QUOTED = [
    (None, regex.compile(r"\s*[,،，、;；:：—–\-)」』）.。!?！？]"), False),
    (None, regex.compile(r"\s*(?:" + CARRYING_ON + ")"), False),
    (None, regex.compile(r"\p{Hangul}"), False),
    (_FRONT, regex.compile(r"\s*" + ZH_SPEAKING), False),
]
QUOTED_CASED = [(None, None, False)]
QUOTED_SMALL = [(None, _SPEAKS, False), (_FRONT, None, True), (regex.compile(r".*[:：]\s*", regex.S), None, True), (None, None, False)]


def after_quotation(text: str, start: int, opened: int, end: int, stop: int, small: bool) -> bool:
    """Whether the sentence ends behind a quotation that itself ends like one."""
    if end >= stop:
        return True
    goes_on = any(_rx(f"(?<={b})", V1).match(text, end) and _rx(a, V1).match(text, end) for b, a in _SMALL)
    for before, after, ends in QUOTED + ((QUOTED_SMALL if small else QUOTED_CASED) if goes_on else []):
        if (before is None or before.fullmatch(text, start, opened)) and (after is None or after.match(text, end)):
            return ends
    return True


_MARKS = regex.compile(rf"[{regex.escape(TERMINAL)}]+(?:[   ]?[»]|[{regex.escape(CLOSERS)}])*|;(?=\s|$)", V1)
_THAI_GAP = regex.compile(r"(?<=\p{Thai})[^\S\n\r]+(?=\S)|(?<=\p{Thai})\s*[\n\r]\s*(?=\S)", V1)


_NAMED = regex.compile(r"\w*[\d_.(=]")
_LOWER = regex.compile(r"(?<=\p{L}{3})[.!?]\s+\p{Ll}")
_THAI = regex.compile(r"\p{Thai}")
_GREEK = regex.compile(r"\p{Greek}")
_BLANKS = regex.compile(r"\s+")


def small_style(text: str) -> bool:
    """Whether sentences of this stretch begin in lower case: its first letter does, or
    a letter behind a plain sentence end does."""
    first = _FIRST.search(text)
    if first and first.group().islower() and not _NAMED.match(text, first.start()):
        return True
    return any(_word_before(text, m.start()) not in _KNOWN for m in _LOWER.finditer(text))


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Code-point spans of the sentences of a text, in order."""
    if not text or not text.strip():
        return []
    out: list[tuple[int, int]] = []
    for lo, hi in units(text):
        unit = text[lo:hi]
        if _CODED.search(unit) and _is_code(_BLANKS.sub(" ", unit)) or KEYED.match(unit.strip()):
            spans = [(0, len(unit))]
        else:
            spans = _within(unit)
        for s, e in spans:
            while s < e and unit[s].isspace():
                s += 1
            while e > s and unit[e - 1].isspace():
                e -= 1
            if s < e:
                out.append((lo + s, lo + e))
    return out


def _within(unit: str) -> list[tuple[int, int]]:
    if not _MARKS.search(unit) and not _THAI.search(unit):
        return [(0, len(unit))]
    small = small_style(unit)
    quotes = quotations(unit)
    opened = [s for s, _ in quotes]

    def quoted(at: int) -> bool:
        i = bisect_left(opened, at) - 1
        return i >= 0 and at < quotes[i][1]

    greek = _GREEK.search(unit)  # the first Greek letter of the sentence at hand, or behind it
    cuts: list[int] = []
    start, stop = 0, len(unit.rstrip())
    points = [(m.end(), "mark", m.start(), m.end()) for m in _MARKS.finditer(unit)]
    if quotes:
        points = [p for p in points if not quoted(p[2])] + [(e, "quote", s, e) for s, e in quotes]
    if _THAI.search(unit):
        points += [(m.start(), "thai", m.start(), m.start()) for m in _THAI_GAP.finditer(unit) if not quoted(m.start())]
    points.sort()
    for end, kind, a, b in points:
        if end <= start:
            continue
        if kind == "quote":
            inner = unit[a + 1:b - 1].rstrip()
            if not inner or inner[-1] not in TERMINAL or not after_quotation(unit, start, a, b, stop, small):
                continue
        elif kind == "mark":
            if unit[a] == ";":
                if greek and greek.start() < start:
                    greek = _GREEK.search(unit, start)
                if not greek or greek.start() > a:
                    continue
            elif end < len(unit):
                last = _TERMINALS.match(unit, a, b).end() - 1
                if not decide(unit, start, last, b, small):
                    continue
        k = end
        while k < stop and unit[k].isspace():
            k += 1
        if k < stop and unit[k] > "\u203b" and (run := _EMOJI_RUN.match(unit, end)):
            end = run.end()
        if end >= stop:
            break
        cuts.append(end)
        start = end
    edges = [0, *cuts, len(unit)]
    return list(zip(edges, edges[1:]))


def sentence_spans(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_char, end_char): one row per sentence, code-point offsets from
    0, end exclusive, no white space at either end.

    Null, empty and blank texts have no row. A text given under several ids is
    divided for each; a row that occurs twice gives its sentences twice; null ids
    are kept. The language label is not looked at, for it may be wrong or missing
    and texts mix languages: script and words of the sentence at hand choose the
    rules. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [sentences(t) for t in batch.column(1).to_pylist()]
            sizes = [len(s) for s in spans]
            at = np.repeat(np.arange(len(spans)), sizes)
            flat = np.array([x for s in spans for x in s], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["d", "start_char", "end_char"])

    kind = documents.schema[doc_id].dataType.simpleString()
    rows = documents.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"d {kind}, start_char long, end_char long").withColumnRenamed("d", doc_id)
