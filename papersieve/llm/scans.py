"""Repair of text from scanned pages: page furniture, broken words, misread characters, continuous paragraphs.

Lines are labelled header, body or break by a hidden Markov model over layout features (place on the page, form, relative
length, flow between neighbours, repetition on other pages, how the line begins). A break is a blank line or a line that
begins a paragraph. The tables start from weak seeds and are re-estimated on Viterbi paths over all records (hard EM; the
features of a line are one code, and only counts of codes and moves, of fixed number, reach the driver). Words are then
taken from the running text with broken words joined over line and page ends, counted over all records, and a word is held
to be misread if one known confusion turns it into a word that is far more frequent. The places of the PLAIN most frequent
words that are not misread are left out of the last pass, as nothing can follow for them.

Defined results: null or empty text gives no rows; records without page marks take blank lines as possible page ends;
is_scanned and ocr_confidence are not trusted, the layout decides.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.session import cut, read_table, spread

STATES = ("header", "body", "break", "break")  # the last state is a blank line, which shows itself
SLIGHT = 1e-3  # weight of what tells break from body, so it never decides between text and furniture
EM_ROUNDS = 2
PLAIN = 50_000  # most frequent sound words that are sent to all tasks, so their places need no row
# Fixed values: (true, misread) character confusions of scanned Latin text.
CONFUSIONS = (
    ("e", "c"), ("t", "f"), ("i", "!"), ("o", "0"), ("s", "5"), ("l", "1"), ("d", "cl"), ("u", "ii"), ("m", "rn"),
    ("h", "b"), ("g", "q"), ("n", "u"), ("w", "vv"), ("é", "6"), ("B", "8"), ("S", "5"), ("O", "0"), ("I", "1"),
    ("rn", "m"), ("ü", "ii"), ("ä", "a'"), ("ö", "o'"), ("ü", "u'"),
)
MARKS = "-‐¬­"
_PAGE = re.compile(r"^\s*(?:[-–—\[(|]\s*)?(?:(?:page|pg\.?|p\.|pág\.?|página|seite|s\.|पृष्ठ|पान|หน้า)\s*)?(?:[\d०-९]{1,4}|[ivxlc]{1,6})(?:\s*(?:/|of|von|de|sur)\s*\d{1,4})?(?:\s*[-–—\])|])?(?:\s*頁|ページ)?\s*$", re.IGNORECASE)
_FURNITURE = re.compile(r"^\s*(?:\d{1,4}\s{2,}\S.*|\S.*?\s{2,}\d{1,4}|vol\.\s*\d+,?\s*no\.\s*\d+.*|.*\bet al\.|\S.*\s[|·•]\s*\d{1,4}|\d{1,4}\s*[|·•]\s*\S.*)\s*$", re.IGNORECASE)
_END = re.compile(r"[.?!।॥。！？…:;][\"'”’»)\]]*\s*$")
_BROKEN = re.compile(rf"[^\W\d_][{MARKS}]\s*$")
_LATIN = re.compile(r"[A-Za-zÀ-ÿ]")
_OTHER = re.compile(r"[ऀ-ॿ぀-ヿ一-鿿฀-๿]")
_NUMBERS = re.compile(r"\d+")

# The code of a line has one digit for each feature; begin tells a line that follows an unfinished, a full or a short
# finished line, or a blank one.
FEATURES = {"edge": 5, "form": 5, "length": 4, "flow": 8, "repeat": 2, "script": 2, "long": 2, "begin": 4}
CODES = math.prod(FEATURES.values())
BLANK = -1


def _edges(text: str, starts: list[int], pages: list[int] | None) -> list[int]:
    """0 inner line, 1/2 first and second of a page, 3/4 last and second last; blank lines stay 0."""
    lines = text.split("\n")
    n = len(lines)
    page_of = np.zeros(n, int)
    if pages and len(pages) > 0:
        page_of = np.searchsorted(np.array(sorted(pages)), np.array(starts), side="right")
    else:
        block = 0
        for i, line in enumerate(lines):
            page_of[i] = block
            block += not line.strip()
    out = [0] * n
    by: dict[int, list[int]] = {}
    for i, line in enumerate(lines):
        if line.strip():
            by.setdefault(int(page_of[i]), []).append(i)
    for rows in by.values():
        if len(rows) > 1:
            out[rows[1]], out[rows[-2]] = 2, 4
        out[rows[-1]] = 3
        out[rows[0]] = 1
    return out


def _foreign(text: str) -> bool:
    """More letters of other scripts than Latin ones."""
    return not text.isascii() and _OTHER.search(text) is not None and len(_OTHER.findall(text)) > len(_LATIN.findall(text))


def line_codes(text: str, pages: list[int] | None) -> np.ndarray:
    """The layout features of every line as one number; BLANK for a blank line."""
    lines = text.split("\n")
    starts = list(np.cumsum([0] + [len(x) + 1 for x in lines[:-1]]))
    edges = _edges(text, starts, pages)
    full = sorted(len(x) for x in lines if x.strip())
    width = max(1, full[int(len(full) * 0.7)]) if full else 1
    foreign = _foreign(text)
    # Only lines at page edges are looked for on other pages.
    key = [re.sub(r"\s+", " ", _NUMBERS.sub("#", x)).strip().lower()[:28] if e else "" for x, e in zip(lines, edges)]
    seen = Counter(k for k in key if k)
    solid = [i for i, x in enumerate(lines) if x.strip()]
    near = {i: (solid[j - 1] if j else None, solid[j + 1] if j + 1 < len(solid) else None) for j, i in enumerate(solid)}
    plain = [bool(edges[i] and len(x) < 90 and (_PAGE.match(x) or _FURNITURE.match(x) or x.strip().isupper())) for i, x in enumerate(lines)]
    ends = {i: bool(_END.search(lines[i])) for i in solid}
    out = np.full(len(lines), BLANK, np.int32)
    for i in solid:
        line = lines[i]
        s = line.strip()
        first, closed = s[0], ends[i]
        if len(s) > 110:
            form = 0  # an unwrapped paragraph
        elif _PAGE.match(s):
            form = 1
        elif len(s) < 60 and _FURNITURE.match(s):
            form = 2
        elif len(s) > 6 and s.isupper():
            form = 3
        else:
            form = 4 if (first.isupper() and not closed and not _BROKEN.search(line)) else 0
        ratio = len(s) / width
        length = 0 if ratio < 0.45 else 1 if ratio < 0.72 else 2 if ratio < 0.92 else 3
        a, b = near[i]
        # Neighbours that are plainly furniture are looked through.
        while a is not None and plain[a]:
            a = near[a][0]
        while b is not None and plain[b]:
            b = near[b][1]
        prev_open = a is not None and not ends[a]
        next_goes_on = b is not None and lines[b].strip()[:1].islower()
        if first.islower():
            flow = 0
        elif closed:
            flow = 1 if not prev_open else 2
        elif prev_open and next_goes_on:
            flow = 3
        elif prev_open:
            flow = 4
        elif next_goes_on:
            flow = 5
        else:
            flow = 6 if b is not None else 7
        after_blank = not i or not lines[i - 1].strip()
        begin = 0 if prev_open or first.islower() else 3 if after_blank else 1 if a is not None and len(lines[a].strip()) >= 0.8 * width else 2
        script = len(s) > 3 and (foreign or not s.isascii()) and foreign != _foreign(s)
        code = ((edges[i] * 5 + form) * 4 + length) * 8 + flow
        out[i] = (((code * 2 + (edges[i] > 0 and seen[key[i]] > 1)) * 2 + script) * 2 + (len(s) > 110)) * 4 + begin
    return out


def _digits() -> dict[str, np.ndarray]:
    """Feature values of every code."""
    rest, out = np.arange(CODES), {}
    for name, size in reversed(FEATURES.items()):
        out[name] = rest % size
        rest = rest // size
    return out


class LineModel:
    """Hidden Markov model of lines; emissions are products over the layout features.

    A line that begins a paragraph is laid out as running text, so break shares the tables of body. How the line begins and
    what it follows tell the two apart, at a slight weight beside the rest.
    """

    def __init__(self, emitted: np.ndarray, moves: np.ndarray):
        """emitted: counts (state, code) of lines that are not blank; moves: counts (state, next state)."""
        digit = _digits()
        text = emitted[1] + emitted[2]
        self.score = np.zeros((3, CODES))
        for st, counts in ((0, emitted[0]), (1, text)):
            for name in ("length", "flow", "repeat", "script"):
                row = np.bincount(digit[name], counts, FEATURES[name]) + 0.5
                self.score[st] += np.log(row / row.sum())[digit[name]]
            # The place decides how a form is to be read, so edge and form are scored together.
            joint = digit["edge"] * 5 + digit["form"]
            row = np.bincount(joint, counts, 25) + 0.2
            self.score[st] += np.log(row / row.sum())[joint]
        self.score[0][digit["long"] == 1] = -1e6  # an unwrapped paragraph is no furniture
        self.score[2] = self.score[1]
        for st in (1, 2):
            row = np.bincount(digit["begin"], emitted[st], 4) + 0.5
            self.score[st] = self.score[st] + SLIGHT * np.log(row / row.sum())[digit["begin"]]
        # Moves between furniture, text and blank lines; then the kind of text.
        of = np.array([0, 1, 1, 2])
        m = np.zeros((3, 3))
        np.add.at(m, (of[:, None], of[None]), moves)
        m = np.log((m + 1) / (m + 1).sum(1, keepdims=True))
        kind = (moves[:, 1:3] + 1) / (moves[:, 1:3] + 1).sum(1, keepdims=True)
        self.move = m[of[:, None], of[None]]
        self.move[:, 1:3] += SLIGHT * np.log(kind)

    def label(self, codes: np.ndarray) -> list[str]:
        return [STATES[k] for k in self.path(codes)]

    def path(self, codes: np.ndarray) -> list[int]:
        """The Viterbi path from a blank line on."""
        if not len(codes):
            return []
        gain, move = self.score[:, codes].T.tolist(), self.move.tolist()
        (hh, hb, hk, hz), (bh, bb, bk, bz), (kh, kb, kk, kz), (zh, zb, zk, zz) = move
        low = -1e12
        h, b, k, z = low, low, low, 0.0
        back = []
        for c, (eh, eb, ek) in zip(codes.tolist(), gain):
            if c < 0:
                to = max((h + hz, 0), (b + bz, 1), (k + kz, 2), (z + zz, 3))
                back.append((0, 0, 0, to[1]))
                h, b, k, z = low, low, low, to[0]
                continue
            th, tb, tk = max((h + hh, 0), (b + bh, 1), (k + kh, 2), (z + zh, 3)), max((h + hb, 0), (b + bb, 1), (k + kb, 2), (z + zb, 3)), max((h + hk, 0), (b + bk, 1), (k + kk, 2), (z + zk, 3))
            back.append((th[1], tb[1], tk[1], 0))
            h, b, k, z = th[0] + eh, tb[0] + eb, tk[0] + ek, low
        st, out = max((h, 0), (b, 1), (k, 2), (z, 3))[1], []
        for ptr in reversed(back):
            out.append(st)
            st = ptr[st]
        return out[::-1]


def _seed_states() -> np.ndarray:
    """Weak seeds by code: furniture by its form at a page edge, or unfinished lines there that break the flow; a break is
    a line behind a short finished one."""
    d = _digits()
    edge, form, flow, length = d["edge"], d["form"], d["flow"], d["length"]
    odd = np.isin(flow, (3, 4)) & (length < 3) | (d["repeat"] == 1) | (d["script"] == 1) | (form == 3) | np.isin(flow, (6, 7)) & np.isin(edge, (1, 3)) & (length < 2)
    header = (edge > 0) & (np.isin(form, (1, 2)) | np.isin(form, (3, 4)) & odd)
    return np.where(header, 0, np.where(d["begin"] >= 2, 2, 1))


def _count(model: LineModel | None, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seeds = None if model else _seed_states()
    emitted, moves = np.zeros(3 * CODES, np.int64), np.zeros((4, 4), np.int64)
    for pdf in batches:
        for codes in pdf["codes"]:
            states = np.array(model.path(codes)) if model else np.where(codes < 0, 3, seeds[codes])
            solid = codes >= 0
            emitted += np.bincount(states[solid] * CODES + codes[solid], minlength=3 * CODES)
            np.add.at(moves, (np.concatenate([[3], states[:-1]]), states), 1)
    at = np.flatnonzero(emitted)
    rows = [pd.DataFrame({"kind": "e", "at": at, "n": emitted[at]}), pd.DataFrame({"kind": "m", "at": np.arange(16), "n": moves.ravel()})]
    yield pd.concat(rows)


def fit(recs: DataFrame) -> LineModel:
    """Hard EM over all records (codes); a round brings back at most one count for each state and code."""
    model = None
    for _ in range(EM_ROUNDS + 1):
        rows = recs.select("codes").mapInPandas(partial(_count, model), "kind string, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect()
        emitted, moves = np.zeros(3 * CODES), np.zeros(16)
        for r in rows:
            (emitted if r["kind"] == "e" else moves)[r["at"]] = r["n"]
        model = LineModel(emitted.reshape(3, CODES), moves.reshape(4, 4))
    return model


def records(spark: SparkSession, data_dir: str) -> DataFrame:
    x = read_table(spark, data_dir, "extracted_docs").where("full_text is not null and full_text <> '' and ext_id is not null")
    return spread(x.select("ext_id", F.col("full_text").alias("text"), F.col("pages.char_start").alias("starts")), "ext_id").dropDuplicates(["ext_id"])


def featured(recs: DataFrame) -> DataFrame:
    """(ext_id, text, codes), written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes = [line_codes(t, list(s) if s is not None else None) for t, s in zip(pdf["text"], pdf["starts"])]
            yield pd.DataFrame({"ext_id": pdf["ext_id"], "text": pdf["text"], "codes": codes})

    return cut(recs.select("ext_id", "text", "starts").mapInPandas(run, "ext_id long, text string, codes array<int>"))


def is_page_number(line: str) -> bool:
    return bool(_PAGE.match(line))


_TOKEN = re.compile(r"[^\W_][^\s\"“”«»„()\[\]]*")
_TRIM = ".,;:?।॥。…’'”»"


def running_words(text: str, labels: list[str]) -> list[tuple[str, int, int, int, str]]:
    """(word, line, line of the rest or -1, characters on the first line, mark) over the running text."""
    lines = text.split("\n")
    body = [i for i, st in enumerate(labels) if st != "header" and lines[i].strip()]
    out = []
    carry: tuple[str, int, str] | None = None
    for j, i in enumerate(body):
        line = lines[i].rstrip()
        words = [m.group() for m in _TOKEN.finditer(line)]
        if carry:
            head, at, mark = carry
            rest = re.match(r"\s*[^\s\"“”«»„()\[\]]*", line).group().strip()
            plain = rest.rstrip(_TRIM + "!" * (rest.count("!") == 1 and rest.endswith("!")))
            out.append((head + plain, at, i, len(head), mark))
            words = [m.group() for m in _TOKEN.finditer(line[re.match(r"\s*[^\s\"“”«»„()\[\]]*", line).end() :])]
            carry = None
        if words and j + 1 < len(body) and line[-1:] and line[-1] in MARKS and len(words[-1]) > 1 and line.endswith(words[-1]):
            carry = (words[-1].rstrip(MARKS), i, line[-1])
            words = words[:-1]
        for w in words:
            out.append((w.rstrip(_TRIM), i, -1, 0, ""))
    return [w for w in out if w[0]]


def variants(word: str) -> list[tuple[str, int]]:
    """(word with one confusion undone, place of the confusion)."""
    out = []
    for true, wrong in CONFUSIONS:
        at = word.find(wrong)
        while at >= 0:
            out.append((word[:at] + true + word[at + len(wrong) :], at))
            at = word.find(wrong, at + 1)
    return out


def survey(recs: DataFrame, model: LineModel) -> DataFrame:
    """(ext_id, line_no, word, n, sure): the furniture lines (word is the kind), and the words of the running text in lower
    case (no ext_id) with the number of their places; sure leaves out words broken at a plain hyphen, which may be
    compounds. Words are counted before they leave a task."""
    net = recs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, sure = Counter(), Counter()
        for pdf in batches:
            rows = []
            for i, text, codes in zip(pdf["ext_id"], pdf["text"], pdf["codes"]):
                labels = net.value.label(codes)
                rows += [(i, k, "page_number" if is_page_number(line) else "header", 1, 1) for k, (st, line) in enumerate(zip(labels, text.split("\n"))) if st == "header"]
                for w, _, _, _, mark in running_words(text, labels):
                    w = w.lower()
                    every[w] += 1
                    if mark != "-":
                        sure[w] += 1
            yield pd.DataFrame(rows, columns=["ext_id", "line_no", "word", "n", "sure"]).astype({"ext_id": "Int64", "line_no": "Int32"})
            if len(every) > 200_000:
                yield _counts(every, sure)
                every, sure = Counter(), Counter()
        yield _counts(every, sure)

    return recs.mapInPandas(run, "ext_id long, line_no int, word string, n long, sure long")


def _counts(every: Counter, sure: Counter) -> pd.DataFrame:
    out = pd.DataFrame({"word": list(every), "n": list(every.values()), "sure": [sure[w] for w in every]})
    return out.assign(ext_id=pd.array([None] * len(out), "Int64"), line_no=pd.array([None] * len(out), "Int32"))[["ext_id", "line_no", "word", "n", "sure"]]


def places(recs: DataFrame, model: LineModel, plain: list[str]) -> DataFrame:
    """(ext_id, word, lw, line_no, rest_line, head, mark): the words of the running text that are broken or not plain."""
    net, known = recs.sparkSession.sparkContext.broadcast(model), recs.sparkSession.sparkContext.broadcast(frozenset(plain))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text, codes in zip(pdf["ext_id"], pdf["text"], pdf["codes"]):
                for w, at, rest, head, mark in running_words(text, net.value.label(codes)):
                    if rest >= 0 or w.lower() not in known.value:
                        rows.append((i, w, w.lower(), at, rest, head, mark))
            yield pd.DataFrame(rows, columns=["ext_id", "word", "lw", "line_no", "rest_line", "head", "mark"])

    return recs.mapInPandas(run, "ext_id long, word string, lw string, line_no int, rest_line int, head int, mark string")


def misread_words(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, at, v): words, in lower case, that one confusion turns into a far more frequent word. counts (word, n) has all
    places, vocab (word, n) the sure ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(x, n, v, at) for x, n in zip(pdf["word"], pdf["n"]) for v, at in variants(x)]
            yield pd.DataFrame(rows, columns=["word", "n", "v", "at"])

    seen = counts.where(F.length("word") >= 2).where(F.col("word").rlike("[a-zà-ÿ]"))
    tried = seen.mapInPandas(run, "word string, n long, v string, at int")
    known = vocab.select(F.col("word").alias("v"), F.col("n").alias("m"))
    # A mark inside a word is no letter, so any known word will do; letters need a clear excess.
    odd = F.col("word").rlike("[a-zà-ÿ][0156!8]|[0156!8][a-zà-ÿ]")
    excess = F.when(odd, F.col("m") >= 1).when(F.length("word") <= 3, (F.col("m") >= 20) & (F.col("m") >= 20 * F.col("n"))).otherwise((F.col("m") >= 4) & (F.col("m") >= 5 * F.col("n")))
    return tried.join(known, "v").where(excess).groupBy("word").agg(F.max_by("at", "m").alias("at"), F.max_by("v", "m").alias("v"))


def split_words(w: DataFrame, vocab: DataFrame) -> DataFrame:
    """(ext_id, line_no, joined): broken words whose mark must vanish; a compound keeps its hyphen."""
    broken = w.where("rest_line >= 0")
    head, rest = F.expr("left(lw, head)"), F.expr("substring(lw, head + 1)")
    b = broken.withColumn("hyphened", F.concat(head, F.lit("-"), rest)).withColumn("first", head).withColumn("second", rest)
    named = lambda c: vocab.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    # Only the words at line ends are looked up, so each join carries few rows against the vocabulary.
    keys = b.select("lw", "hyphened", "first", "second").distinct()
    for c in ("lw", "hyphened", "first", "second"):
        keys = keys.join(named(c), c, "left").na.fill(0, [f"n_{c}"])
    keep = (F.col("n_hyphened") > F.col("n_lw")) | ((F.col("n_lw") == 0) & (F.col("n_hyphened") == 0) & (F.col("n_first") >= 3) & (F.col("n_second") >= 3) & (F.length("first") > 3) & (F.length("second") > 3))
    compound = F.col("n_hyphened") > F.col("n_lw")
    joined = F.when(F.col("mark").isin("¬", "\u00ad"), F.lit(True)).when(F.col("mark") == "-", ~keep).otherwise(~compound)
    return b.join(keys, ["lw", "hyphened", "first", "second"]).select("ext_id", "line_no", "rest_line", F.expr("left(word, head)").alias("first_part"), "mark", joined.alias("joined"))


def _repairs(recs: DataFrame) -> tuple[LineModel, DataFrame, DataFrame, DataFrame]:
    """The line model, the furniture lines, the misread words (at, v) and the broken words; recs has codes."""
    model = fit(recs)
    seen = cut(survey(recs, model))
    counts = cut(seen.where("ext_id is null").groupBy("word").agg(F.sum("n").alias("n"), F.sum("sure").alias("sure")))
    vocab = counts.where("sure > 0").select("word", F.col("sure").alias("n"))
    bad = cut(misread_words(counts.select("word", "n"), vocab).select(F.col("word").alias("lw"), "at", "v"))
    sound = counts.join(bad.select(F.col("lw").alias("word")), "word", "left_anti")
    plain = [r["word"] for r in sound.orderBy(F.desc("n"), "word").limit(PLAIN).select("word").collect()]
    w = cut(places(recs, model, plain))
    furniture = seen.where("ext_id is not null").select("ext_id", "line_no", F.col("word").alias("kind"))
    return model, furniture, w.join(bad, "lw"), split_words(w, vocab)


def found(recs: DataFrame) -> DataFrame:
    """(ext_id, line_no, kind) with kinds header, page_number, split_word, misread; recs (ext_id, text, starts)."""
    _, furniture, hit, broken = _repairs(featured(recs))
    mis = hit.select("ext_id", F.when((F.col("rest_line") >= 0) & (F.col("at") >= F.col("head")), F.col("rest_line")).otherwise(F.col("line_no")).alias("line_no"), F.lit("misread").alias("kind"))
    split = broken.where("joined").select("ext_id", "line_no", F.lit("split_word").alias("kind"))
    return furniture.unionByName(mis).unionByName(split).distinct()


def _like(found_word: str, repaired: str) -> str:
    """The repaired word in the letter case of the found one."""
    return repaired.capitalize() if found_word[:1].isupper() and found_word[1:2].islower() else repaired.upper() if found_word.isupper() and len(found_word) > 1 else repaired


def rebuild(text: str, labels: list[str], joins: dict[str, bool], fixes: dict[str, str]) -> list[str]:
    """Continuous paragraphs: furniture dropped, broken words joined, misread words replaced."""
    lines = text.split("\n")
    paragraphs: list[str] = []
    now, glue, last_break = "", "", False
    for line, st in zip(lines, labels):
        if st == "header":
            continue
        s = line.strip()
        if not s:
            last_break = bool(now)
            continue
        # A blank line ends a paragraph only if its text is finished; page ends run through sentences.
        # So does a line that begins one by its layout.
        if now and not glue and (st == "break" and _END.search(now) or last_break and (_END.search(now) or s[:1].isupper() and not now[-1:].isalnum())):
            paragraphs.append(now)
            now = ""
        last_break = False
        now = (now[:-1] if glue == "cut" else now) + s if glue else (now + " " + s if now else s)
        glue = ""
        if _BROKEN.search(line):
            key = re.split(r"\s", line.rstrip())[-1]
            glue = "cut" if joins.get(key, True) else "keep"
    if now:
        paragraphs.append(now)
    if fixes:
        pattern = re.compile("|".join(sorted((rf"(?<![^\W\d_]){re.escape(k)}(?![^\W_])" for k in fixes), key=len, reverse=True)), re.IGNORECASE)
        paragraphs = [pattern.sub(lambda m: _like(m.group(), fixes[m.group().lower()]), x) for x in paragraphs]
    return paragraphs


def paragraphs(recs: DataFrame) -> DataFrame:
    """(ext_id, paragraph_no, text): the repaired text of every record."""
    recs = featured(recs)
    model, _, hit, broken = _repairs(recs)
    net = recs.sparkSession.sparkContext.broadcast(model)
    fixes = hit.groupBy("ext_id").agg(F.collect_set(F.struct("lw", "v")).alias("fixes"))
    joins = broken.groupBy("ext_id").agg(F.collect_set(F.struct("first_part", "mark", "joined")).alias("joins"))
    per = recs.join(fixes, "ext_id", "left").join(joins, "ext_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text, codes, fx, jn in zip(pdf["ext_id"], pdf["text"], pdf["codes"], pdf["fixes"], pdf["joins"]):
                labels = net.value.label(codes)
                table = {x["lw"]: x["v"] for x in fx} if fx is not None else {}
                glued = {x["first_part"] + x["mark"]: x["joined"] for x in jn} if jn is not None else {}
                rows += [(i, k, x) for k, x in enumerate(rebuild(text, labels, glued, table))]
            yield pd.DataFrame(rows, columns=["ext_id", "paragraph_no", "text"])

    return per.mapInPandas(run, "ext_id long, paragraph_no int, text string")


def p5_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return found(records(spark, data_dir))


def p5_paragraphs(spark: SparkSession, data_dir: str) -> DataFrame:
    return paragraphs(records(spark, data_dir))
