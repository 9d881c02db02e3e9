"""Sentence boundaries across languages and scripts.

A semi-Markov dynamic programme chooses whole spans between candidate cuts. Every span is scored jointly on its
length, its opening words, its closing words and the balance of its quotations and brackets; the best-scoring
covering of a block wins. Blank lines and the line borders of headings are hard cuts, so a block is a paragraph.

Defined results: null or blank text gives no rows; repeated rows give equal rows, which callers make distinct; offsets
are code points counted from 0, the end is exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.session import read_table, spread

# Abbreviations that do not end a sentence when something follows.
ABBREVIATIONS = frozenset(
    """dr prof mr mrs ms st fig figs eq vol no pp p cf vs e.g i.e al rs kg approx ch chap sec ed eds dept jr sr
    abb tab s bzw ca vgl z b d h u a nr bd hrsg str inkl evtl usw ff
    env art ex m mme mlle av
    sra srta ud uds pág pag aprox ej núm núms dña
    डॉ प्रो प्रा श्री श्रीमती रु कु सौ पृ क्र सं""".split()
)
# Abbreviations which often close a sentence; what follows decides.
SOFT_ABBREVIATIONS = frozenset("etc usw al ff p.m a.m kg u.s u.k inc ltd co".split())
# Words after which an ordinal point in German stays inside the sentence.
ORDINAL_FOLLOWERS = frozenset(
    """januar februar märz april mai juni juli august september oktober november dezember durchgang kapitel abschnitt
    jahrhundert auflage band teil""".split()
)
TERMINATORS = ".?!।॥。！？…"
FULL_STOPS_CJK = "。！？"
CLOSERS = "\"'”’»)]）」』】›“"
OPENERS = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "【": "】", "“": "”", "«": "»", "„": "“"}
CLOSING = {v: k for k, v in OPENERS.items()}
_MARK = re.compile("[" + re.escape("".join(sorted({*OPENERS, *CLOSING, '"'}))) + "]")

_CANDIDATE = re.compile(r"[.?!।॥。！？…]+(?:[   ]?[»]|[\"'”’)\]）」』】›“])*")
_BLANK_LINE = re.compile(r"\n[ \t ]*(?:\n[ \t ]*)+")
_HEADING_NUMBER = re.compile(r"^\s*(?:\d+(?:\.\d+)*|[IVX]+|[A-Z])[.)]\s+\S")
_WORD_BREAKS = "([„“«\"'‘「（"
_WORD_BREAK = re.compile(rf"[\s{re.escape(_WORD_BREAKS)}]")
_LETTERS = re.compile(r"\w+")
_GAP = re.compile("[ \t\n\u00a0\u202f]*")
_ANY_BLANK = re.compile(r"\s*")
_BLANK_RUN = re.compile("[ \u00a0\n]+")
_RUN = re.compile(r"[.?!।॥。！？…]+")
_SHORT_DEVANAGARI = re.compile(r"[ऀ-ॿ]{1,4}")
_THAI = re.compile(r"[฀-๿]")


def _is_thai(ch: str) -> bool:
    return "฀" <= ch <= "๿"


def _is_heading(line: str, nxt: str, prev_closed: bool) -> bool:
    """A line of its own that is not running text: short, unterminated, after a closed unit, before a new opening."""
    s = line.strip()
    if not s or len(s) > 80 or not prev_closed:
        return False
    if s[-1] in TERMINATORS or s[-1] in ",;:-‐":
        return False
    words = s.split()
    if _HEADING_NUMBER.match(s):
        return len(words) <= 8
    if _THAI.search(s):
        return len(s) <= 25 and " " not in s
    if any("぀" <= c <= "鿿" for c in s):
        return len(s) <= 12
    if len(words) > 6:
        return False
    # A wrapped line is filled up to the line width; a heading is far shorter than a wrapped line.
    first = nxt.lstrip()[:1]
    if first and first.islower():
        return False
    return len(s) <= 45 and not s[0].islower()


class _Block:
    """A paragraph with what the spans of the dynamic programme ask for, each in constant or logarithmic time."""

    def __init__(self, text: str):
        self.text = text
        self.size = len(text)
        self.breaks: list[int] | None = None

    def word_start(self, end: int) -> int:
        """Start of the word that ends before a place; the places of all breaks are listed once a word is very long."""
        text = self.text
        for k in range(end, max(0, end - 40), -1):
            c = text[k - 1]
            if c in _WORD_BREAKS or c.isspace():
                return k
        if end <= 40:
            return 0
        if self.breaks is None:
            self.breaks = [m.end() for m in _WORD_BREAK.finditer(self.text)]
        k = bisect_right(self.breaks, end)
        return self.breaks[k - 1] if k else 0

    def lower_start(self, at: int) -> bool:
        """The first word is in small letters throughout; a unit such as pH is not."""
        return self.text[at : at + 1].islower() and (m := _LETTERS.match(self.text, at)) is not None and m.group().islower()


def _brackets(text: str) -> tuple[list[int], list[int], list[int], list[int]]:
    """Prefix sums over the brackets and quotation marks of a block: (places, depth behind each, unmatched so far,
    straight double quotes so far). Pairs are matched once for the whole block."""
    at, matched, stack, straight = [], [], [], []
    for m in _MARK.finditer(text):
        c, k = m.group(), len(at)
        at.append(m.start())
        matched.append(0)
        straight.append(c == '"')
        if c == "“" and stack and text[at[stack[-1]]] == "„":
            matched[stack.pop()] = 1
            matched[k] = -1
        elif c in OPENERS:
            stack.append(k)
        elif c in CLOSING and stack and OPENERS[text[at[stack[-1]]]] == c:
            matched[stack.pop()] = 1
            matched[k] = -1
    depth, lone, quotes = [0], [0], [0]
    for x, q in zip(matched, straight):
        depth.append(depth[-1] + x)
        lone.append(lone[-1] + (not x and not q))
        quotes.append(quotes[-1] + q)
    return at, depth, lone, quotes


def _cut_score(b: _Block, start: int, end: int) -> float:
    """Evidence for a boundary after the terminator run text[start:end], from the closing and the opening words."""
    block = b.text
    at = _GAP.match(block, end).end()
    gap = at - end
    if at == b.size:
        return 6.0
    first, last, nxt = block[start], block[end - 1], block[at]
    if first in FULL_STOPS_CJK:
        # A quotation that goes on with its reporting clause is one unit with it.
        if last in "」』）】" and nxt in "とというのがはをにで":
            return -8.0
        return 5.0
    if first in "।॥":
        return 5.0 if nxt not in ",;" else -6.0
    if nxt in ",;:":
        return -8.0
    if first == ".":
        ws = b.word_start(start)
        if gap == 0:
            # No blank: inside decimals, addresses, initials; a lost blank only before a capital after a real word.
            if nxt.isdigit() or b.lower_start(at) or nxt in "./@-_":
                return -9.0
            before = block[start - 1 : start] if ws < start else ""
            if not (nxt.isupper() or nxt in "¿¡«“„\"(") or start - ws <= 2 or not before.isalpha() or block.rfind(".", ws, start) >= 0:
                return -9.0
            return 2.5 if before.islower() else -4.0
        if b.lower_start(at):
            return -7.0
        if block.startswith("..", start):
            return 3.0
        if end - start == 1:
            word = block[ws:start]
            bare = word.lower().lstrip("¿¡").rstrip(".")
            if bare in SOFT_ABBREVIATIONS:
                return -6.0 if nxt.isdigit() else 2.0
            if bare in ABBREVIATIONS:
                return -7.0
            if len(bare) == 1 and bare.isalpha():
                return -6.0
            if word[:-1] and "." in word and all(len(x) <= 1 for x in word.split(".")):
                return -5.0 if nxt.isupper() is False else 0.5
            if bare.isdigit() and len(bare) <= 2:
                follower = m.group().lower() if (m := _LETTERS.match(block, at)) else ""
                if follower in ORDINAL_FOLLOWERS:
                    return -8.0
            if nxt.isdigit() and _SHORT_DEVANAGARI.fullmatch(bare):
                return -2.0
        return 4.0
    # Question and exclamation marks.
    if b.lower_start(at):
        return -7.0
    if gap == 0 and not (nxt.isupper() or nxt in "¿¡«“„\"(" or ord(nxt) > 0x2E7F):
        return -5.0
    return 4.0


def _length_score(n: int) -> float:
    if n < 3:
        return -3.0
    if n < 8:
        return -0.6
    if n > 600:
        return -1.0 - (n - 600) / 400
    return 0.0


LEAST_CUT = -2.5  # of a cut's own score and its opening score, below which no best covering holds the cut


def _candidates(b: _Block) -> dict[int, float]:
    """Places that may end a sentence, with the score of their closing and opening words."""
    block = b.text
    found: dict[int, float] = {}
    for m in _CANDIDATE.finditer(block):
        start, end = m.start(), m.end()
        found[end] = max(found.get(end, -99.0), _cut_score(b, start, end))
        if end - start > 1 and block[end - 1] in "\"'“" and end < b.size and block[end].isalnum():
            # The mark may open the next quotation instead of closing this one.
            stop = _RUN.match(block, start).end()
            found[stop] = _cut_score(b, start, stop)
    # Scripts without full stops: a blank next to Thai text may end a sentence. A hard line break by itself is no
    # evidence that could reach LEAST_CUT.
    for m in _BLANK_RUN.finditer(block) if _THAI.search(block) else ():
        i, j = m.start(), m.end()
        if i == 0 or j >= b.size or i in found:
            continue
        p, q = block[i - 1], block[j]
        if _is_thai(p) or (p.isdigit() and _THAI.search(block, max(0, i - 12), i)):
            found[i] = 3.0 if _is_thai(q) else (-3.0 if q in "(（" or q.isdigit() else 1.5)
        elif _is_thai(q) and p in ")）":
            found[i] = -3.0
    return found


def _block_spans(block: str) -> list[tuple[int, int]]:
    """Best covering of one paragraph by sentence spans, as offsets without outer blanks.

    The score of two neighbouring spans exceeds that of their union by at most 2.5 besides the score of the cut between
    them (the length score by no more, and the union has no more unmatched marks), so cuts that cost more are left out
    beforehand. Spans are tried from the nearest start backwards until no earlier one can win; beyond 600 characters the
    length score is linear, so one start is the best of all earlier ones with as many unmatched marks. All bounds are
    exact.
    """
    b = _Block(block)
    heads, tails, scores, opens = [_ANY_BLANK.match(block).end()], [], [], [0.0]
    if heads[0] == b.size:
        return []
    for p, score in sorted(_candidates(b).items()):
        if not 0 < p < b.size:
            continue
        head = _ANY_BLANK.match(block, p).end()
        if head == b.size:
            break
        opening = -2.0 if b.lower_start(head) else -4.0 if block[head] in ",;:)]）」”»" else 0.0
        if score + opening >= LEAST_CUT and p > heads[-1]:
            tails.append(p)
            scores.append(score)
            heads.append(head)
            opens.append(opening)
    tails.append(len(block.rstrip()))
    scores.append(0.0)
    n = len(heads)
    if n == 1:
        return [(heads[0], tails[0])]
    at, depth, lone, quotes = _brackets(block)
    mark_head, mark_tail = [bisect_left(at, h) for h in heads], [bisect_left(at, t) for t in tails]
    # worth[i]: of the covering before head i with the opening of the span there; most: the greatest so far; far: the
    # start of the greatest worth[i] + heads[i] / 400, which is the best one for spans on the long end of the length score.
    worth, most, far, back = [0.0], [0.0], [0], []
    for j in range(n):
        tail, mark, value, start, low = tails[j], mark_tail[j], float("-inf"), j, depth[mark_tail[j]]
        known = mark
        for i in range(j, -1, -1):
            length, k = tail - heads[i], mark_head[i]
            if k < known:
                low = min(low, min(depth[k:known]))
                known = k
            # Unmatched marks that every span from here or from further back has, too.
            least = 5.0 * min(3, lone[mark] - lone[k] + depth[mark] - low)
            if length >= 8 and most[i] + _length_score(length) - least <= value:
                break
            bad = depth[k] + depth[mark] - 2 * low + lone[mark] - lone[k] + (quotes[mark] - quotes[k]) % 2
            score = worth[i] + _length_score(length) - 5.0 * min(3, bad)
            if score > value:
                value, start = score, i
            if length > 600 and far[i] < i:
                q = mark_head[far[i]]
                lowest = min(low, min(depth[q:known], default=low))
                bad = depth[q] + depth[mark] - 2 * lowest + lone[mark] - lone[q] + (quotes[mark] - quotes[q]) % 2
                if 5.0 * min(3, bad) == least:
                    score = worth[far[i]] + _length_score(tail - heads[far[i]]) - least
                    if score > value:
                        value, start = score, far[i]
                    break
        back.append(start)
        if j + 1 < n:
            worth.append(value + scores[j] + opens[j + 1])
            most.append(max(most[-1], worth[-1]))
            best = far[-1]
            far.append(j + 1 if worth[j + 1] + heads[j + 1] / 400 > worth[best] + heads[best] / 400 else best)
    out, j = [], n - 1
    while j >= 0:
        out.append((heads[back[j]], tails[j]))
        j = back[j] - 1
    return out[::-1]


def _blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """Paragraphs and headings as (start, end, is_heading)."""
    pieces, at = [], 0
    for m in _BLANK_LINE.finditer(text):
        pieces.append((at, m.start()))
        at = m.end()
    pieces.append((at, len(text)))
    for a, b in pieces:
        lines, p = [], a
        for line in text[a:b].split("\n"):
            lines.append((p, p + len(line)))
            p += len(line) + 1
        start, closed = a, True
        for k, (la, lb) in enumerate(lines):
            line = text[la:lb]
            nxt = text[lines[k + 1][0] : lines[k + 1][1]] if k + 1 < len(lines) else ""
            if _is_heading(line, nxt, closed):
                if start < la:
                    yield start, la, False
                yield la, lb, True
                start = min(lb + 1, b)
                closed = True
                continue
            s = line.rstrip()
            if s:
                closed = s[-1] in TERMINATORS or (s[-1] in CLOSERS and s.rstrip(CLOSERS)[-1:] in tuple(TERMINATORS)) or bool(_THAI.search(s[-6:]))
        if start < b:
            yield start, b, False


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Every sentence unit of a text as (start, end), code points, blanks trimmed."""
    if not text:
        return []
    out = []
    for a, b, heading in _blocks(text):
        block = text[a:b]
        if heading:
            out.append((a + len(block) - len(block.lstrip()), a + len(block.rstrip())))
        else:
            out += [(a + s, a + e) for s, e in _block_spans(block)]
    return [(s, e) for s, e in out if s < e]


def split_sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, start_char, end_char, sentence) for every sentence of every text; ids may repeat."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, s, e, t[s:e]) for i, t in zip(pdf[id_col], pdf[text_col]) if t for s, e in sentence_spans(t)]
            yield pd.DataFrame(rows, columns=[id_col, "start_char", "end_char", "sentence"])

    src = spread(df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, text_col), id_col)
    return src.mapInPandas(run, f"{id_col} {id_type}, start_char int, end_char int, sentence string")


def p7_found(spark: SparkSession, data_dir: str) -> DataFrame:
    p = read_table(spark, data_dir, "preprocessed")
    return split_sentences(p, "prep_id", "original_full_text").select("prep_id", "start_char", "end_char").distinct()


def p7_unit_sentences(spark: SparkSession, data_dir: str) -> DataFrame:
    """(unit_id, start_char, end_char, sentence): the sentences inside the archived units."""
    u = read_table(spark, data_dir, "sentence_units")
    return split_sentences(u, "unit_id", "original_text").distinct()
