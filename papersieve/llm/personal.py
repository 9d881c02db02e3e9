"""Personal information in free text: detection by typed grammars, typed placeholders, and keyed surrogates.

Numbers, mail addresses and postal addresses are found by the grammar of their formats, with the words before them
ruling out order, invoice, grant, accession and book numbers; names by the phrases that introduce a person in eight
languages, and then wherever the same name stands again in the text.

Every found entity gets a surrogate that is drawn by a keyed hash, agrees with it in kind, script, format and (for given
names of the tables) gender, and is the same wherever the entity occurs. Surrogates that two entities would share are
drawn again until all are distinct.

Defined results: null and empty texts have no items and stay as they are; an item found several times in a text is one
row; where spans overlap, the earlier and longer one holds.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.session import cut, read_table, spread

KEY = b"papersieve"  # for tests; production sets spark.papersieve.key
KINDS = ("EMAIL", "ADDRESS", "ID", "PHONE", "NAME")

_L = r"A-Za-zÀ-ÖØ-öø-ÿ"
_D = r"0-9०-९"
# A beginning that no word or number runs into; letters of scripts without blanks may stand before.
_B = rf"(?<![{_L}{_D}_@.+/-])"
_E = rf"(?![{_L}{_D}_])"

_LOCAL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*"
_HOST = r"[A-Za-z0-9-]+"
EMAIL = re.compile(
    rf"{_B}{_LOCAL}(?:@{_HOST}(?:\.{_HOST})*\.[A-Za-z]{{2,}}"
    rf"|\s?[\[(]\s?(?:at|AT)\s?[\])]\s?{_HOST}(?:(?:\.|\s?[\[(]\s?(?:dot|DOT)\s?[\])]\s?){_HOST})+"
    rf"|\s+(?:AT|at)\s+{_HOST}(?:\s+(?:DOT|dot)\s+{_HOST})+){_E}"
)

# Gates: whatever the patterns behind them match, holds these.
_HIDDEN_AT = re.compile(r"[\[(]\s?(?:at|AT)\s?[\])]|\s(?:AT|at)\s+[A-Za-z0-9-]+\s+(?:DOT|dot)\s")
_DIGITS = re.compile(r"\d{3}[\s.-]?\d|\d{2}[\s.-]\d{2}")

_W = rf"[A-ZÀ-Ý][{_L}'’-]+"
_PLACE = rf"{_W}(?:\s{_W})?"
_DW = r"[ऀ-ॿ]+"
# Each format with words of which a text must hold one for the format to be looked for at all. Where the town follows its
# postal code, it belongs to the code.
ADDRESSES = [
    (words, re.compile(pattern.replace(r"\s", r"[ \n ]")))
    for words, pattern in (
        (("Apt", "Unit", "Suite"), rf"{_B}\d{{1,4}}\s{_W}\s(?:Avenue|Street|Road|Lane|Drive|Boulevard),\s(?:Apt|Unit|Suite)\s\d+,\s{_PLACE},\s[A-Z]{{2}}\s\d{{5}}"),
        (("Lane", "Street", "Road", "Close", "Avenue"), rf"{_B}\d{{1,4}}\s{_W}\s(?:Lane|Street|Road|Close|Avenue),\s{_PLACE}\s[A-Z]{{1,2}}\d[A-Z\d]?\s\d[A-Z]{{2}}"),
        (("Flat",), rf"{_B}Flat\s\d+,\s{_W}\sSociety,\s{_W}\sRoad,\s{_PLACE}\s\d{{3}}\s?\d{{3}}"),
        (("Plot",), rf"{_B}Plot\sNo\.\s\d+,\sNear\s{_W}\sTemple,\s{_PLACE}\s-\s\d{{3}}\s?\d{{3}}"),
        (("Galli",), rf"{_B}H\.\s?No\.\s\d+(?:/\d+)?,\s{_W}\sGalli,\sAt\sPost\s{_PLACE}\s\d{{3}}\s?\d{{3}}"),
        (("straße", "strasse", "weg", "gasse", "allee", "platz"), rf"{_B}{_W}(?:straße|strasse|weg|gasse|allee|platz)\s\d+[a-z]?,\s\d{{5}}\s{_W}"),
        (("rue", "avenue", "boulevard", "place"), rf"{_B}\d{{1,4}}(?:\s(?:bis|ter))?,\s(?:rue|avenue|boulevard|place)\s{_PLACE},\s\d{{5}}\s{_W}"),
        (("Calle", "Avenida", "Plaza"), rf"{_B}(?:Calle|Avenida|Plaza)\s{_PLACE}\s\d{{1,4}},\s\d{{5}}\s{_W}"),
        (("मार्ग", "गली", "वाडा", "रोड", "पथ", "चौक", "नगर"), rf"{_B}[{_D}]{{1,4}},\s{_DW}\s(?:मार्ग|गली|वाडा|रोड|पथ|चौक|नगर),\s{_DW}\s[{_D}]{{3}}\s?[{_D}]{{3}}"),
    )
]

ID = re.compile(
    "|".join(
        (
            rf"{_B}[A-Z]{{5}}\d{{4}}[A-Z]{_E}",
            rf"{_B}(?:19|20)\d{{2}}[A-Z]{{2,4}}\d{{4,6}}{_E}",
            rf"{_B}P(?:19|20)\d{{2}}[A-Z]{{2}}\d{{5,7}}{_E}",
            rf"{_B}\d{{4}}([ -]?)\d{{4}}\1\d{{4}}(?![-.]?\d){_E}",
            rf"{_B}\d{{3}}-\d{{2}}-\d{{4}}(?![-.]?\d){_E}",
            rf"{_B}[A-Z]\d{{7}}{_E}",
        )
    )
)

PHONE = re.compile(
    "|".join(
        (
            rf"(?<![{_L}{_D}_@.+/-])(?:\+|00|००)[{_D}]{{2}}[ .-]?[{_D}]{{2,5}}(?:[ .-]?[{_D}]{{2,8}}){{1,3}}(?![-]?[{_D}])",
            rf"{_B}\([{_D}]{{2,5}}\)\s?[{_D}]{{3,4}}[ -]?[{_D}]{{2,4}}(?![-]?[{_D}])",
            rf"{_B}[0०][{_D}]{{2}}\s[{_D}]{{4}}\s[{_D}]{{4}}(?![-]?[{_D}])",
            rf"{_B}0[{_D}](?:\s[{_D}]{{2}}){{4}}(?![-]?[{_D}])",
            rf"{_B}0[{_D}]{{2}}\s[{_D}]{{5}}\s?[{_D}]{{3}}(?![-]?[{_D}])",
            rf"{_B}[0०][{_D}]{{4,5}}-[{_D}]{{5,6}}(?![-]?[{_D}])",
            rf"{_B}[{_D}]{{4}}\s[{_D}]{{3}}\s[{_D}]{{3}}(?![- ]?[{_D}])",
            rf"{_B}[5-9५-९][{_D}]{{9}}(?![-]?[{_D}])",
        )
    )
)
# Words before a number that is no personal one.
_NOT_PERSONAL = re.compile(r"(?:order|invoice|grant|accession|isbn|issn|doi|ref|reference|award|contract|lot|batch|serial|patent|handle|tag|account|licen[cs]e|project|proposal|barcode|sample|receipt|bill|ticket|version)s?\b[\s.:#(]*(?:no|nos|number|num|id|code)?[\s.:#(]*$", re.IGNORECASE)

_WORDS = {  # fixed values: titles before a name, which don't belong to it
    "title": r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Smt|Shri|Er|M|Mme|Sr|Sra|Herr|Herrn|Frau|Doña|Don|डॉ|प्रा|प्रो|श्री|श्रीमती|कु)\.?\s+)*",
}
_NAME_WORD = rf"(?:[A-ZÀ-Ý][{_L}'’]*[a-zà-ÿ'’{_L}](?:-[A-ZÀ-Ý][{_L}'’]+)*|[A-ZÀ-Ý]\.)"
NAME_SHAPE = rf"(?:{_NAME_WORD}(?:[  ]{_NAME_WORD}){{1,3}}|{_DW}\s{_DW})"
_DNAME = rf"(?:{_DW}\s{_DW}|{_NAME_WORD}(?:\s{_NAME_WORD}){{1,3}})"
# Phrases that introduce a person. Each has one group, the name.
_INTRO = [
    rf"(?:Correspondence|Name|Student|Author|Supervisor|Guide|Contact person|Submitted by|Prepared by|Signed|Candidate)(?:\s?:|\sby)?[  ]+TITLE({NAME_SHAPE})(?=\s*(?:[,(\n.|;]|$))",
    rf"\b(?:One|Another|The) (?:respondent|participant|student|interviewee|candidate|guide|supervisor|researcher|author),? TITLE({NAME_SHAPE})(?=,| (?:insisted|declares|said|asked|agreed|signed|wrote|confirmed))",
    rf"\band TITLE({NAME_SHAPE})(?= answered by phone)",
    rf"\b(?:grateful|thankful|indebted|thanks are due|thanks go) to TITLE({NAME_SHAPE})(?= for\b)",
    rf"\b(?:thank|acknowledge)s? TITLE({NAME_SHAPE})(?= for\b)",
    rf"\b(?:carried out|conducted|transcribed|coded|collected|supervised|guided|checked|written|prepared) by TITLE({NAME_SHAPE})(?= (?:and|over|in|on|during|for|under)\b|[.,;])",
    rf"\b(?:carried out|conducted|transcribed|coded|collected|supervised|guided|checked|written|prepared) by TITLE{NAME_SHAPE} and TITLE({NAME_SHAPE})(?= (?:over|in|on|during|for)\b|[.,;])",
    rf"\bDank gilt TITLE({NAME_SHAPE})(?= für\b)",
    rf"\b(?:Der Teilnehmer|Die Teilnehmerin|Der Befragte|Die Befragte|Der Student|Die Studentin) TITLE({NAME_SHAPE})(?= (?:wies|hat|legte|gab|bat|sagte)\b)",
    rf"\bRückfragen beantwortet TITLE({NAME_SHAPE})(?= unter\b)",
    rf"\bJe remercie TITLE({NAME_SHAPE})(?= (?:pour|de|d')\b)",
    rf"\b(?:Le participant|La participante|L'étudiante?|Le répondant|La répondante|El participante|El estudiante|La estudiante) TITLE({NAME_SHAPE})(?= (?:a|mostró|presentó|declara|declare|dijo|firmó)\b)",
    rf"\bAgradezco a TITLE({NAME_SHAPE})(?= (?:la|el|las|los|su|por)\b)",
    rf"यह शोध कार्य TITLE({_DNAME})(?= द्वारा)",
    rf"मार्गदर्शक TITLE({_DNAME})(?= (?:का|के|की|यांचे|यांची|यांचा|यांना))",
    rf"(?:वाली|वाले) प्रतिभागी TITLE({_DNAME})(?= ने)",
    rf"हा प्रबंध TITLE({_DNAME})(?= यांनी)",
    rf"असलेल्या TITLE({_DNAME})(?= यांनी)",
    rf"(?:Guide|Name|Student|Submitted by)(?:\s?:)?\s+TITLE({_DW}\s{_DW})(?=\s*(?:[,(\n.]|$))",
]
# For each phrase a word that a text must hold for it to be looked for.
_GATES = [
    ("Correspondence", "Name", "Student", "Author", "Supervisor", "Guide", "Contact person", "Submitted", "Prepared", "Signed", "Candidate"),
    ("respondent", "participant", "student", "interviewee", "candidate", "guide", "supervisor", "researcher", "author"),
    ("answered by phone",), ("grateful", "thankful", "indebted", "thanks"), ("thank", "acknowledge"),
    ("carried out by", "conducted by", "transcribed by", "coded by", "collected by", "supervised by", "guided by", "checked by", "written by", "prepared by"),
    ("carried out by", "conducted by", "transcribed by", "coded by", "collected by", "supervised by", "guided by", "checked by", "written by", "prepared by"),
    ("Dank gilt",), ("Teilnehmer", "Befragte", "Student"), ("Rückfragen",), ("remercie",),
    ("participant", "étudiant", "répondant", "estudiante"), ("Agradezco",), ("शोध कार्य",), ("मार्गदर्शक",), ("प्रतिभागी",), ("प्रबंध",), ("असलेल्या",),
    ("Guide", "Name", "Student", "Submitted"),
]
INTRO = [(words, re.compile(p.replace("TITLE", _WORDS["title"]))) for words, p in zip(_GATES, _INTRO, strict=True)]
_LINE_NAME = re.compile(rf"^[  ]*{_WORDS['title']}({NAME_SHAPE})[  ]*$")
_NOT_NAMES = re.compile(r"\b(?:Review|Analysis|Results|Abstract|Introduction|Discussion|Conclusion|Methodology|Data|Literature|Forschung|Stand|Revue|Marco|Plot|No|Temple|Society|Road|Lane|Avenue|Galli|Contact|Address|Mobile|Email)\b")


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all items, in order, without overlaps."""
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def add(a: int, b: int, kind: str) -> None:
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            out.append((a, b, kind))

    if "@" in text or _HIDDEN_AT.search(text):
        for m in EMAIL.finditer(text):
            add(m.start(), m.end(), "EMAIL")
    for words, pattern in ADDRESSES:
        if any(w in text for w in words):
            for m in pattern.finditer(text):
                add(m.start(), m.end(), "ADDRESS")
    digits = _DIGITS.search(text)
    for kind, pattern in (("ID", ID), ("PHONE", PHONE)):
        for m in pattern.finditer(text) if digits else ():
            if not _NOT_PERSONAL.search(text[max(0, m.start() - 40) : m.start()]):
                add(m.start(), m.end(), kind)
    names: set[str] = set()
    for words, pattern in INTRO:
        if any(w in text for w in words):
            for m in pattern.finditer(text):
                if not _NOT_NAMES.search(m.group(1)):
                    add(m.start(1), m.end(1), "NAME")
                    names.add(m.group(1))
    # A name on a line of its own, beside lines of contact data.
    if out:
        lines, at = text.split("\n"), 0
        contact = set()
        starts = []
        for line in lines:
            starts.append(at)
            at += len(line) + 1
        for a, b, kind in out:
            if kind != "NAME":
                k = _line_of(starts, a)
                contact.add(k)
        for k, line in enumerate(lines):
            m = _LINE_NAME.match(line)
            if m and len(line) < 60 and (k + 1 in contact or k - 1 in contact) and not _NOT_NAMES.search(line):
                add(starts[k] + m.start(1), starts[k] + m.end(1), "NAME")
                names.add(m.group(1))
    # Further places of names that were introduced.
    for n in names:
        at = text.find(n)
        while at >= 0:
            e = at + len(n)
            if not (text[at - 1 : at].isalnum() or text[e : e + 1].isalnum() or text[e : e + 1] == "-"):
                add(at, e, "NAME")
            at = text.find(n, e)
    return sorted(out)


def _line_of(starts: list[int], pos: int) -> int:
    import bisect

    return bisect.bisect_right(starts, pos) - 1


def placeholder_text(text: str | None) -> str | None:
    """The text with [KIND n] in place of every item; equal items of a text share their number."""
    if not text:
        return text
    seen: dict[tuple[str, str], int] = {}
    count: dict[str, int] = {}
    parts, at = [], 0
    for a, b, kind in spans(text):
        key = (kind, text[a:b])
        if key not in seen:
            count[kind] = count.get(kind, 0) + 1
            seen[key] = count[kind]
        parts += [text[at:a], f"[{kind} {seen[key]}]"]
        at = b
    return "".join(parts) + text[at:]


# Common given names by gender, in Latin and Devanagari script. Names outside are drawn without a gender.
FEMALE = frozenset(
    """aisha alice alicia amelie amina amita amrita ana anagha andrea angela anita anjali anke anna anne annika antje aparna
    archana asha barbara beatriz birgit camille carmen carolina catherine chantal charlotte chitra clara claire claudia
    deepa devika diana dipti edith elena elisabeth elizabeth emma eva falguni fatima gabriele gita greta hanna heike helen
    hemlata ines inga isabel jana janhavi jane jessica julia juliane karen karin kate katharina kavita ketaki laura lea lena
    lucia madhuri margaret maria marie marta mary meera monika mrunal nandita nathalie neha nicole nina noemie olga pallavi
    patricia petra pooja priya rachel radha rekha revati rosa ruth sabine sandra sara sarah seema sneha sofia sophie sunita
    susan swati tanuja tara teresa urmila ursula varsha vidya
    आशा गीता दीप्ति मीरा विद्या सीता तारा प्रीति वर्षा चित्रा रेवती केतकी अनघा देविका नंदिता सुनीता कविता""".split()
)
MALE = frozenset(
    """aarav abhay ajay alain alan albert alejandro alexander amit anand andre andreas anil anton antonio arjun arthur arun
    ashok benjamin bernd bruno carlos charles christian christoph claude daniel david dennis diego dieter dinesh dominik
    eduardo emil enrique eric ernst felix fernando francisco francois frank franz fritz ganesh gaurav georg george gerhard
    gilles hans harish heinrich henri henry hugo ivan jack jakob james jan javier jean jens joachim johann john jonas jorge
    jose joseph juan karl kiran klaus kunal lars laurent louis luca luis mahesh manuel marc marco mario mark markus martin
    matthias max michael michel miguel mohan nikhil nils nitin olivier oscar oskar otto pablo patrick paul pedro peter
    philippe pierre prakash rahul rainer rajesh ramesh raul ravi richard robert rohan roland sachin sanjay stefan suresh
    thomas tomas uwe vijay vikram vinod walter werner wilhelm william wolfgang
    अरुण मोहन दिनेश विजय राहुल गौरव अजय सुरेश रमेश महेश गणेश संजय""".split()
)
# The parts of which surrogate words are built, and the endings that mark their kind.
_ONSETS, _VOWELS, _CODAS = "b d f g h j k l m n p r s t v z".split(), "a e i o u".split(), ["", "l", "m", "n", "r", "s"]
_ENDINGS = {"female": ("a", "ia", "ina", "ella"), "male": ("o", "an", "us", "ard"), "given": ("i", "e", "en", "is"), "surname": ("berg", "dal", "er", "mann", "son", "ov", "ini", "ez")}
_DEV_ONSETS, _DEV_SIGNS = "क ग ज ट त द न प ब म य र ल व श स ह".split(), ["", "ा", "ि", "ी", "ु", "े", "ो"]
_DEV_ENDINGS = {"female": ("ता", "नी", "का", "या"), "male": ("श", "व", "त", "ज"), "given": ("म", "र", "न", "ल"), "surname": ("कर", "वाले", "राव", "देव", "पंत", "साने")}
_ROUNDS = 64  # draws of one value at most; words grow with the draws, so only a format of fixed size can use them up


def secret(spark: SparkSession) -> bytes:
    """The key of the session, set as spark.papersieve.key; production sets its own."""
    return spark.conf.get("spark.papersieve.key", KEY.decode()).encode()


def _stream(key: bytes, kind: str, value: str, salt: int) -> bytes:
    return hashlib.blake2b(f"{kind}\x00{value}\x00{salt}".encode("utf-8", "surrogatepass"), key=key[:64], digest_size=64).digest()


def normal_word(word: str) -> str:
    return unicodedata.normalize("NFC", word).casefold()


def name_parts(name: str) -> list[tuple[str, str, bool]]:
    """(separator before, word, whether it stands where a given name does) of a name; hyphens separate, too."""
    words = [(m.group(1), m.group(2)) for m in re.finditer(r"([\s\u00a0-]*)([^\s\u00a0-]+)", name)]
    caps = [w.isupper() and len(w) > 2 for _, w in words]
    # "SURNAME Given": the capitals mark the surname.
    first = 1 if caps and caps[0] and not all(caps) and len(words) > 1 else 0
    last = 0 if first else len(words) - 1
    return [(sep, w, k == first or (k != last and "-" not in sep)) for k, (sep, w) in enumerate(words)]


@lru_cache(maxsize=64)
def _initials(key: bytes) -> dict[str, str]:
    """A keyed order of the letters, so different initials stay different."""
    letters = [chr(65 + k) for k in range(26)]
    return dict(zip(letters, sorted(letters, key=lambda c: _stream(key, "initial", c, 0))))


def initial(word: str, key: bytes) -> str | None:
    """The surrogate of an initial with its point, None for other words; an accent of it is dropped."""
    if len(word) == 2 and word[1] == ".":
        base = unicodedata.normalize("NFKD", word[0])[0].upper()
        return _initials(key).get(base, word[0]) + "."
    return None


def word_kind(word: str, given: bool) -> str:
    return "female" if word in FEMALE else "male" if word in MALE else "given" if given else "surname"


def drawn_word(word: str, kind: str, salt: int, key: bytes, size: int = 2) -> str:
    """A surrogate of a word, in small letters and in its script, of size syllables and more with the salt."""
    b = _stream(key, "word", word, salt)
    count = size + salt // 3
    b = (b * (1 + (3 * count + 1) // len(b)))[: 3 * count + 1]
    if word[:1] > "ऀ":
        body = "".join(_DEV_ONSETS[b[3 * k] % 17] + _DEV_SIGNS[b[3 * k + 1] % 7] for k in range(count))
        return body + _DEV_ENDINGS[kind][b[-1] % len(_DEV_ENDINGS[kind])]
    body = "".join(_ONSETS[b[3 * k] % 16] + _VOWELS[b[3 * k + 1] % 5] + (_CODAS[b[3 * k + 2] % 6] if k else "") for k in range(count))
    return (body if body[-1] not in "aeiou" else body + _ONSETS[b[-1] // 16]) + _ENDINGS[kind][b[-1] % len(_ENDINGS[kind])]


def _cased(new: str, word: str) -> str:
    return new.upper() if word.isupper() and len(word) > 1 else new[:1].upper() + new[1:] if word[:1].isupper() else new


# Words of addresses that stay.
_ADDRESS_WORDS = frozenset("Flat Society Road Plot No Near Temple H Galli At Post Avenue Apt Lane Calle rue bis ter Street Drive Boulevard Unit Suite Close Avenida Plaza avenue boulevard place मार्ग गली वाडा रोड पथ चौक नगर".split())


def surrogate(kind: str, value: str, salt: int = 0, key: bytes = KEY) -> str:
    """A replacement of the same kind, script and format, the same for values that differ in letter case only."""
    if kind == "NAME":
        return "".join(sep + (initial(w, key) or _cased(drawn_word(n := normal_word(w), word_kind(n, given), salt, key), w)) for sep, w, given in name_parts(value))
    stream = _stream(key, kind, normal_word(value), salt)
    stream = stream * (1 + (3 * len(value)) // len(stream))
    out, word_at = [], 0
    for k, m in enumerate(re.finditer(rf"[{_L}]+|[ऀ-ॣ॰-ॿ]+|[0-9]|[०-९]|.", value, re.DOTALL)):
        t, b = m.group(), stream[3 * k]
        made = "".join(_ONSETS[stream[3 * k + j] % 16] + _VOWELS[stream[3 * k + j] // 16 % 5] for j in range(3))
        if t.isdigit():
            # Country and trunk prefixes keep the format.
            keep = kind == "PHONE" and (m.start() < 3 and value[0] == "+" or m.start() < 4 and value[:2] in ("00", "००") or m.start() == 0 and t in "0०")
            out.append(t if keep else (chr(0x966 + b % 10) if t > "9" else str(b % 10)))
        elif t[0].isalpha() and kind == "ID":
            out.append("".join(chr(65 + stream[3 * k + j % 3] // (1 + j // 3) % 26) for j in range(len(t))))
        elif t[0].isalpha() and kind == "EMAIL":
            fixed = t.lower() in ("at", "dot") or word_at > 0 and not re.search(r"@|at\b|AT\b", value[m.start() :])
            out.append(t if fixed else made.upper() if t.isupper() else made)
        elif t[0].isalpha() and kind == "ADDRESS":
            tail = next((x for x in ("straße", "strasse", "weg", "gasse", "allee", "platz") if t.endswith(x) and t != x), "")
            # Letters of a postal code stay letters of a code.
            code = t.isupper() and len(t) <= 2 and t.isascii()
            out.append(t if t in _ADDRESS_WORDS else "".join(chr(65 + stream[3 * k + j] % 26) for j in range(len(t))) if code else drawn_word(normal_word(t), "surname", salt, key) if t > "ऀ" else made.capitalize() + tail)
        else:
            out.append(t)
        word_at += t[0].isalpha()
    return "".join(out)


def items(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pii_kind, pii_text), one row per distinct item of a text."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, t) for i, text in zip(pdf[id_col], pdf[text_col]) for k, t in {(k, text[a:b]) for a, b, k in spans(text)}]
            yield pd.DataFrame(rows, columns=[id_col, "pii_kind", "pii_text"])

    src = spread(docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, text_col), id_col)
    return src.mapInPandas(run, f"{id_col} {id_type}, pii_kind string, pii_text string")


def _distinct_draws(values: DataFrame, draw, real: DataFrame) -> DataFrame:
    """(kind, value, new): a draw for every value (kind, value, grp), distinct within grp and equal to no real value (grp,
    value). The smallest value that draws something keeps it, the others draw again; only these go on. Values that use up
    _ROUNDS draws, as their format has too few forms, get a placeholder with their hash."""
    todo, done, taken = values.withColumn("new", draw(0)("kind", "value")), None, real.select("grp", F.col("value").alias("new")).distinct()
    for salt in range(1, _ROUNDS + 1):
        todo = cut(todo)
        first = todo.groupBy("grp", "new").agg(F.min("value").alias("keeper"))
        marked = todo.join(first, ["grp", "new"]).join(taken.withColumn("used", F.lit(True)), ["grp", "new"], "left")
        marked = cut(marked.select("kind", "value", "grp", "new", (F.col("used").isNull() & (F.col("value") == F.col("keeper"))).alias("good")))
        good, rest = marked.where("good").select("kind", "value", "grp", "new"), marked.where("not good").select("kind", "value", "grp")
        done = good if done is None else done.unionByName(good)
        if rest.isEmpty():
            return done.select("kind", "value", "new")
        taken = taken.unionByName(good.select("grp", "new"))
        todo = rest.withColumn("new", draw(salt)("kind", "value"))
    last = rest.withColumn("new", F.concat(F.lit("["), F.col("kind"), F.lit(" "), F.left(F.sha2("value", 256), F.lit(16)), F.lit("]")))
    return done.unionByName(last).select("kind", "value", "new")


def surrogates(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """(pii_kind, pii_text, surrogate) of every distinct item, distinct and consistent.

    Names are mapped word by word, and a word has one surrogate wherever it stands, so all forms of a person move
    together: with and without a middle initial, in capitals, surname first. Words and initials are mapped one to one, so
    different names stay different. Other values are mapped as wholes, without regard to letter case. No surrogate word or
    value is one that was found.
    """
    items_ = cut(found.select("pii_kind", "pii_text").distinct())

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(name, k, sep, w, normal_word(w), given, initial(w, key)) for name in pdf["pii_text"] for k, (sep, w, given) in enumerate(name_parts(name))]
            yield pd.DataFrame(rows, columns=["pii_text", "k", "sep", "w", "value", "given", "init"])

    p = cut(items_.where("pii_kind = 'NAME'").mapInPandas(parts, "pii_text string, k int, sep string, w string, value string, given boolean, init string"))
    words = p.where("init is null").groupBy("value").agg((F.avg(F.col("given").cast("int")) >= 0.5).alias("given"))

    @F.pandas_udf("string")
    def kinds(word: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series([word_kind(w, g) for w, g in zip(word, given)], dtype=object)

    words = cut(words.select(kinds("value", "given").alias("kind"), "value", F.lit("word").alias("grp")))
    # So many syllables that words of one length are far more than needed; 96 is the least number of forms of a syllable.
    size = max(2, math.ceil(math.log(max(2, words.count()) * 64) / math.log(96)))

    def word_draw(salt: int):
        @F.pandas_udf("string")
        def f(kind: pd.Series, value: pd.Series) -> pd.Series:
            return pd.Series([drawn_word(v, k, salt, key, size) for k, v in zip(kind, value)], dtype=object)

        return f

    def value_draw(salt: int):
        @F.pandas_udf("string")
        def f(kind: pd.Series, value: pd.Series) -> pd.Series:
            return pd.Series([surrogate(k, v, salt, key) for k, v in zip(kind, value)], dtype=object)

        return f

    new_words = _distinct_draws(words, word_draw, words).select("value", "new")
    shown = F.when((F.col("w") == F.upper("w")) & (F.length("w") > 1), F.upper("new")).when(F.left("w", F.lit(1)) != F.lower(F.left("w", F.lit(1))), F.concat(F.upper(F.left("new", F.lit(1))), F.expr("substring(new, 2)"))).otherwise(F.col("new"))
    put = p.join(new_words, "value", "left").withColumn("s", F.concat("sep", F.coalesce("init", shown)))
    names = put.groupBy("pii_text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x.s), "").alias("surrogate")).withColumn("pii_kind", F.lit("NAME"))
    other = items_.where("pii_kind <> 'NAME'")
    # Values that differ in letter case only are one; the first of them is drawn for.
    folded = other.withColumn("fold", F.lower("pii_text"))
    one = folded.groupBy("pii_kind", "fold").agg(F.min("pii_text").alias("value"))
    drawn = _distinct_draws(one.select(F.col("pii_kind").alias("kind"), "value", F.col("pii_kind").alias("grp")), value_draw, other.select(F.col("pii_kind").alias("grp"), F.col("pii_text").alias("value")))
    back = folded.join(one, ["pii_kind", "fold"]).join(drawn.withColumnRenamed("kind", "pii_kind"), ["pii_kind", "value"])
    return names.select("pii_kind", "pii_text", "surrogate").unionByName(back.select("pii_kind", "pii_text", F.col("new").alias("surrogate")))


def with_surrogates(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """(doc_id, text): every text with surrogates in place of its items; texts without items stay as they are."""
    found = cut(items(docs).distinct())
    per = found.join(surrogates(found, key), ["pii_kind", "pii_text"]).groupBy("doc_id").agg(F.collect_set(F.struct("pii_kind", "pii_text", "surrogate")).alias("table"))

    @F.pandas_udf("string")
    def put(text: pd.Series, table: pd.Series) -> pd.Series:
        out = []
        for t, rows in zip(text, table):
            known = {(r["pii_kind"], r["pii_text"]): r["surrogate"] for r in rows} if rows is not None else {}
            parts, at = [], 0
            for a, b, kind in spans(t) if known else ():
                parts += [t[at:a], known.get((kind, t[a:b]), f"[{kind}]")]
                at = b
            out.append(None if t is None else "".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    return docs.where("doc_id is not null").select("doc_id", "text").join(per, "doc_id", "left").select("doc_id", put("text", "table").alias("text"))


def p10_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return items(read_table(spark, data_dir, "documents")).distinct()


def p10_surrogates(spark: SparkSession, data_dir: str) -> DataFrame:
    """(doc_id, pii_kind, pii_text, surrogate) for every item of every text."""
    found = cut(items(read_table(spark, data_dir, "documents")).distinct())
    return found.join(surrogates(found, secret(spark)), ["pii_kind", "pii_text"]).select("doc_id", "pii_kind", "pii_text", "surrogate")


def p10_placeholders(spark: SparkSession, data_dir: str) -> DataFrame:
    """(doc_id, text): every text with typed placeholders."""

    @F.pandas_udf("string")
    def put(s: pd.Series) -> pd.Series:
        return s.map(placeholder_text, na_action="ignore")

    d = read_table(spark, data_dir, "documents").where("doc_id is not null").select("doc_id", "text")
    return spread(d, "doc_id").select("doc_id", put("text").alias("text"))


def p10_surrogate_texts(spark: SparkSession, data_dir: str) -> DataFrame:
    """(doc_id, text): every text with surrogates in place of its items."""
    return with_surrogates(read_table(spark, data_dir, "documents"), secret(spark))
