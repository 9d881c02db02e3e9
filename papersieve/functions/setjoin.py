"""All pairs of two columns of distinct strings whose token set ratio reaches a threshold, without loss.

A ratio of t comes about in one of two ways. Either the common words make up t / (2 - t) of the letters of one side: then
the letters of the common words of all pairs of two blocks, a product of matrices, tell the ratio. Or the letters agree:
then the lengths differ by that factor at most, and blocks of strings of near lengths are compared under a bound of the
common letter pairs, which needs no order of the words, and one of the subsequence that the other words have in common,
by bit vectors over many pairs at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve.functions.similarity import lcs_length, token_set_ratio, token_set_udf
from papersieve.session import cut, partitions, spread

BLOCK = 2000  # strings in a block
MANY = 8192  # strings in a block of those that look for their best
WIDE_STEP = 2.0  # lengths of such a block; the cost of a call counts for more here than a near length
WIDE = 32768  # strings in a block of the side that is searched for the best
PART = 40_000  # strings at most that look for their best together
OFTEN = 64  # strings of a block from which on a word has a row of its own
LIKELY = 0.6  # part of the shorter rest that may be in common, for which a pair is scored to raise the threshold
BITS = 1024  # of the letter pairs of a string
STEP = 1.1  # lengths of a block, largest by smallest
CLASSES = 91  # of letters; those of ASCII texts differ
COPIES = 16  # of a letter that a string counts with; more of them are taken for common
SPARSE = 0.005  # part of a block pair that has a word in common, below which it is added by itself
MOST = 8192  # pairs whose subsequences are bounded at once


def set_words(col: Column) -> Column:
    """Distinct words as token_set_ratio splits them."""
    return F.array_distinct(F.filter(F.split(col, r"[\p{IsWhite_Space}\x1c-\x1f]+"), lambda w: w != ""))


class Block:
    """Strings by length, with their words, the places of these in the sorted set, and the bits of the letter pairs."""

    def __init__(self, texts: list[str], least: list[float]):
        made = sorted(((sorted(set(s.split())), s, m) for s, m in zip(texts, least)), key=lambda r: sum(map(len, r[0])) + len(r[0]))
        self.texts, self.least = [r[1] for r in made], np.array([r[2] for r in made]) / 100
        self.sets = [frozenset(r[0]) for r in made]
        self.size = np.array([sum(map(len, r[0])) + len(r[0]) - 1 for r in made])
        self.ids: dict[str, int] = {}
        rows = [[self.ids.setdefault(w, len(self.ids)) for w in r[0]] for r in made]
        n, most = len(made), max(map(len, rows), default=0)
        self.words = np.full((n, most), len(self.ids), dtype=np.int32)
        for i, r in enumerate(rows):
            self.words[i, : len(r)] = r
        self.letters = np.array([len(w) + 1 for w in self.ids] + [0], dtype=np.int64)
        self.codes = self.places = self.word_places = self.rows = self.plan = None
        self.made = [" ".join(r[0]) for r in made]

    def with_letters(self) -> "Block":
        """What only the comparison of letters needs, made once."""
        if self.codes is not None:
            return self
        n, most = self.words.shape
        self.has = np.zeros((n, len(self.ids) + 1), dtype=bool)
        self.has[np.arange(n)[:, None], self.words] = True
        self.has[:, -1] = False
        self.filled = (self.words < len(self.ids)).sum(1)
        code, inside = _points(self.made)
        self.codes = _classes(code, inside)
        of = np.bincount((np.arange(n)[:, None] * 32 + code % 32)[inside], minlength=n * 32).reshape(n, 32)
        bags = (np.arange(COPIES) < of[:, :, None]).reshape(n, -1)
        self.beyond = np.maximum(of - COPIES, 0).sum(1)
        pair = np.sort(np.where(inside[:, 1:], code[:, :-1] * 1_114_112 + code[:, 1:], np.iinfo(np.int64).max), axis=1)
        # The n-th copy of a letter pair has its own bit, so the bits of both sides count pairs with repetitions.
        at = np.broadcast_to(np.arange(pair.shape[1]), pair.shape)
        first = np.maximum.accumulate(np.where(np.diff(pair, axis=1, prepend=-1) != 0, at, 0), axis=1)
        real = pair < np.iinfo(np.int64).max
        bits = np.zeros((n, BITS), dtype=bool)
        bits[np.nonzero(real)[0], _mix(pair[real], (at - first)[real])] = True
        self.lost = real.sum(1) - bits.sum(1)
        self.columns, self.bags = (np.ascontiguousarray(np.packbits(b, axis=1).view(np.uint64).T) for b in (bits, bags))
        return self

    def word_rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The letters of a frequent word, with a blank, in the strings that have it, one row a word; the row of each word or
        -1; the strings by word, and where each word's begin."""
        if self.rows is None:
            flat = self.words.ravel()
            order = np.argsort(flat, kind="stable")
            of, at = order // max(1, self.words.shape[1]), np.searchsorted(flat[order], np.arange(len(self.ids) + 1))
            row = np.full(len(self.ids) + 1, -1, dtype=np.int32)
            # Longer words do not fit the small numbers, which is all that short strings need.
            often = np.flatnonzero((np.diff(at) >= OFTEN) & (self.letters[:-1] <= 255))
            row[often] = np.arange(len(often))
            dense = np.zeros((len(often), len(self.texts)), dtype=np.uint8)
            for k, w in enumerate(often):
                dense[k, of[at[w] : at[w + 1]]] = self.letters[w]
            self.rows = dense, row, of, at
        return self.rows

    def by_prefix(self) -> list[tuple[int, list[int], int]]:
        """Every string with its words, frequent ones first, in the order of these, so that it has most in common with the one
        before; and how many of the first words are the same."""
        if self.plan is None:
            count = np.bincount(self.words.ravel(), minlength=len(self.ids) + 1)
            count[-1] = 0
            rank = np.empty(len(count), dtype=np.int32)
            rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
            ranks = np.sort(rank[self.words], axis=1)
            order = np.lexsort(ranks.T[::-1])
            same = np.cumprod(ranks[order[1:]] == ranks[order[:-1]], axis=1).sum(1)
            word, size = np.argsort(rank), (self.words < len(self.ids)).sum(1)
            self.plan, before = [], 0
            for i, k in zip(order.tolist(), [0, *same.tolist()]):
                # Long strings have sums of their own, so none may go on from theirs.
                self.plan.append((i, word[ranks[i, : size[i]]].tolist(), min(k, before, int(size[i]))))
                before = int(size[i]) if self.size[i] < 255 else 0
        return self.plan

    def masks(self) -> np.ndarray:
        """(word of 64 places, string, class): the places of letters."""
        if self.places is None:
            self.places = _places(self.codes, CLASSES + 1)
        return self.places

    def word_masks(self) -> np.ndarray:
        """(word of 64 places, string, slot): the places of words."""
        if self.word_places is None:
            # A word's blank has its slot; the last word's is cut off.
            end = np.cumsum(np.where(self.words < len(self.ids), self.letters[self.words], 0), axis=1)
            start = np.pad(end[:, :-1], ((0, 0), (1, 0)))[:, : end.shape[1]]
            end = np.minimum(end, self.size[:, None])
            ones = np.array([(1 << k) - 1 for k in range(65)], dtype=np.uint64)
            of = [64 * k for k in range(max(1, -(-self.codes.shape[1] // 64)))]
            self.word_places = np.stack([ones[np.clip(end - k, 0, 64)] & ~ones[np.clip(start - k, 0, 64)] for k in of])
        return self.word_places


def _mix(pair: np.ndarray, nth: np.ndarray) -> np.ndarray:
    h = (pair.astype(np.uint64) * np.uint64(31) + nth.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(BITS)


def _ids_in(p: Block, q: Block) -> np.ndarray:
    """The number in q of every word of p; one past the last for those that q has not."""
    return np.array([q.ids.get(w, len(q.ids)) for w in p.ids] + [len(q.ids)], dtype=np.int32)


def common_letters(p: Block, q: Block) -> np.ndarray:
    """Letters of the common words, each with a blank, of all pairs."""
    out = np.zeros((len(p.texts), len(q.texts)), dtype=np.float32)
    to = _ids_in(p, q)
    here = np.flatnonzero(to[:-1] < len(q.ids))
    if not len(here):
        return out

    def rows(b: Block) -> tuple[np.ndarray, np.ndarray]:
        flat = b.words.ravel()
        order = np.argsort(flat, kind="stable")
        return order // max(1, b.words.shape[1]), np.searchsorted(flat[order], np.arange(len(b.ids) + 1))

    (pr, pa), (qr, qa) = rows(p), rows(q)
    np_, nq = pa[here + 1] - pa[here], qa[to[here] + 1] - qa[to[here]]
    dense = np_ * nq > SPARSE * out.size
    many = here[dense]
    a, b = np.zeros((len(p.texts), len(many)), dtype=np.float32), np.zeros((len(many), len(q.texts)), dtype=np.float32)
    for k, w in enumerate(many):
        a[pr[pa[w] : pa[w + 1]], k] = p.letters[w]
        b[k, qr[qa[to[w]] : qa[to[w] + 1]]] = 1
    if len(many):
        out = a @ b
    for w in here[~dense]:
        out[pr[pa[w] : pa[w + 1], None], qr[qa[to[w]] : qa[to[w] + 1]]] += p.letters[w]
    return out


def by_words(p: Block, q: Block, best: bool) -> list[tuple[str, str, float]]:
    """Pairs whose common words reach the threshold of the first side's string, with the ratio of these; with best, only
    those of the largest ratio of each string."""
    s = common_letters(p, q) - 1
    shorter = np.minimum(p.size[:, None], q.size[None, :]).astype(np.float32)
    t = p.least[:, None].astype(np.float32)
    i, j = np.nonzero((s > 0) & (2 * s >= (t - 1e-5) * (s + shorter)))
    one, less = s[i, j].astype(np.float64), np.minimum(p.size[i], q.size[j])
    ratio = 100.0 * (1 - (less - one) / (one + less))
    keep = ratio >= 100 * p.least[i] - 1e-7
    if best:
        top = np.zeros(len(p.texts))
        np.maximum.at(top, i, ratio)
        keep &= ratio >= top[i] - 1e-7
    return [(p.texts[a], q.texts[b], float(r)) for a, b, r in zip(i[keep], j[keep], ratio[keep])]


def _rest_bounds(p: Block, q: Block, i: np.ndarray, j: np.ndarray, p_in_q: np.ndarray, q_in_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of strings: the letters of the common words, each with a blank, and an upper bound of the longest common
    subsequence of the other words, by bit vectors over all pairs at once. Letters count by class."""
    # Empty slots come last, so what all of the strings lack is left out.
    mine, other = (b.words[k, : int(b.filled[k].max(initial=0))] for b, k in ((p, i), (q, j)))
    both = q.has[j[:, None], p_in_q[mine]]
    s = (both * p.letters[mine]).sum(1)
    theirs = p.has[i[:, None], q_in_p[other]]
    them = np.bitwise_or.reduce(np.where(theirs, np.uint64(0), q.word_masks()[:, j, : other.shape[1]]), axis=2)
    wide = int(q.size[j].max(initial=0))
    left = np.unpackbits(np.ascontiguousarray(them.T).view(np.uint8), axis=1, count=wide, bitorder="little").astype(bool)
    # The letters that are left move together.
    count = left.sum(1)
    packed = np.full((len(j), int(count.max(initial=0))), CLASSES, dtype=np.uint8)
    packed[np.arange(packed.shape[1]) < count[:, None]] = q.codes[j, :wide][left]
    parts = max(1, -(-int(p.size[i].max(initial=0)) // 64))
    free = [np.bitwise_or.reduce(np.where(both, np.uint64(0), p.word_masks()[w, i, : mine.shape[1]]), axis=1) for w in range(parts)]
    return s, _subsequences(p.masks()[:parts], i, packed, count, free)


def lcs_bounds(left: list[str], right: list[str]) -> np.ndarray:
    """Upper bounds of the longest common subsequences of many pairs of texts; letters count by their class."""
    a, b = _classes(*_points(left)), _classes(*_points(right))
    return _subsequences(_places(a, CLASSES + 1), np.arange(len(left)), b, (b != CLASSES).sum(1), None)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of every text, one text a row, and which of them are there."""
    if not texts:
        return np.zeros((0, 1), dtype=np.int64), np.zeros((0, 1), dtype=bool)
    code = np.array(texts).view(np.uint32).reshape(len(texts), -1).astype(np.int64)
    return code, np.arange(code.shape[1]) < np.array(list(map(len, texts)))[:, None]


def _classes(code: np.ndarray, inside: np.ndarray) -> np.ndarray:
    return np.where(inside, code % CLASSES, CLASSES).astype(np.uint8)


def _places(values: np.ndarray, kinds: int) -> np.ndarray:
    """(word of 64 places, row, value): bits of the places of every value below the last one."""
    n, wide = values.shape
    out, at = np.zeros((max(1, -(-wide // 64)), n, kinds), dtype=np.uint64), np.arange(n)
    for k in range(wide):
        out[k // 64, at, values[:, k]] |= np.uint64(1 << k % 64)
    out[:, :, kinds - 1] = 0
    return out


def _subsequences(places: np.ndarray, i: np.ndarray, codes: np.ndarray, count: np.ndarray, free: list[np.ndarray] | None) -> np.ndarray:
    """Longest common subsequences of the rows i of places, at the places of free, and the first count of the codes."""
    # Pairs with long rests come first, so none takes more steps than it needs.
    parts, order = len(places), np.argsort(-count, kind="stable")
    free = [np.full(len(i), ~np.uint64(0))] * parts if free is None else [f[order] for f in free]
    base = (i - i.min(initial=0))[order].astype(np.intp) * (CLASSES + 1)
    steps = np.ascontiguousarray(codes[order].T)
    alive = len(i) - np.searchsorted(np.sort(count), np.arange(codes.shape[1]), side="right")
    span = slice(int(i.min(initial=0)), int(i.max(initial=-1)) + 1)
    tables = [np.ascontiguousarray(places[w, span]).ravel() for w in range(parts)]
    rows = [np.full(len(i), ~np.uint64(0)) for _ in range(parts)]
    for step, n in zip(steps, alive):
        at, over = base[:n] + step[:n], None
        for w in range(parts):
            r, u = rows[w][:n], tables[w].take(at)
            u &= free[w][:n]
            u &= r
            one = r + u
            carry, over = over, one < r
            if carry is not None:
                one += carry
                over |= one < carry
            r -= u
            r |= one
    most = np.zeros(len(i), dtype=np.int64)
    most[order] = sum(np.bitwise_count(~r).astype(np.int64) for r in rows)
    return most


def _bits_in_common(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(many & one[:, None]).sum(0, dtype=np.int16)


def compare(p: Block, q: Block) -> list[tuple[str, str]]:
    """Pairs that reach the threshold of the first side's string by their letters."""
    return [(p.texts[i], y) for i, y, _ in compare_rows(p, q)]


def compare_rows(p: Block, q: Block) -> list[tuple[int, str, float]]:
    """The same as (place in p, string, ratio of the letters); a string with a threshold of 1 is left out."""
    p, q = p.with_letters(), q.with_letters()
    p_in_q, q_in_p, found = _ids_in(p, q), _ids_in(q, p), []
    many = bool(q.beyond.any())
    for i, (n, t) in enumerate(zip(p.size, p.least)):
        lo, hi = np.searchsorted(q.size, [n * t / (2 - t) - 1e-6, n * (2 - t) / t + 1e-6])
        if lo >= hi or n < 1 or t >= 1 - 1e-12:
            continue
        # Letters of a common subsequence that follow each other on both sides are a common letter pair; every letter left
        # out parts one such pair at most. Two more for the words at either end, whose blank another order moves.
        common = _bits_in_common(p.bags[:, i], q.bags[:, lo:hi])
        if many and p.beyond[i]:
            common = common + np.minimum(q.beyond[lo:hi], p.beyond[i])
        # The least of all first, then each pair's own.
        at = np.flatnonzero(common >= np.int64(np.ceil(t / 2 * (q.size[lo] + n) - 1e-6)))
        total, common = q.size[lo + at] + n, common[at]
        keep = common >= t / 2 * total - 1e-6
        at, total = at[keep], total[keep]
        pairs = _bits_in_common(p.columns[:, i], q.columns[:, lo + at]) + np.minimum(q.lost[lo + at], p.lost[i])
        keep = pairs >= (1.5 * t - 1) * total - 3 - 1e-6
        at = at[keep]
        found.append((np.full(len(at), i), lo + at))
    out = []
    if found:
        left, right = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        for k in range(0, len(left), MOST):
            i, j = left[k : k + MOST], right[k : k + MOST]
            s, most = _rest_bounds(p, q, i, j, p_in_q, q_in_p)
            # Letters that the rests must have in common.
            least = p.least[i] / 2 * (p.size[i] + q.size[j]) - s
            for a, b, m in zip(i[ok := most >= least - 1e-6], j[ok], least[ok]):
                both = p.sets[a] & q.sets[b]
                x, y = " ".join(sorted(p.sets[a] - both)), " ".join(sorted(q.sets[b] - both))
                most_ab = lcs_length(x, y) if x and y else None
                if (both if most_ab is None else most_ab >= m - 1e-6):
                    same = sum(map(len, both)) + len(both)
                    out.append((int(a), q.texts[b], 1.0 if most_ab is None else 2 * (same + most_ab) / (p.size[a] + q.size[b])))
    return out


class Best:
    """The best partners of some strings, over blocks of the other side, each seen twice: first the words of all blocks,
    then their letters, under the best that the words and a few scored pairs have shown."""

    def __init__(self, texts: list[str], threshold: float):
        texts = sorted(texts, key=len)
        self.blocks = [Block(texts[k : k + MANY], [threshold] * len(texts[k : k + MANY])) for k in range(0, len(texts), MANY)]
        self.threshold = threshold
        self.found: list[list[set[str]]] = [[set() for _ in b.texts] for b in self.blocks]

    def words(self, q: Block) -> None:
        """Takes the best by common words; raises the threshold also by the letters of the pair with most words in common."""
        dense, row, of, at = q.word_rows()
        least = int(q.size[0])
        for p, found in zip(self.blocks, self.found):
            # The sums of the first words are kept for the next string, which mostly begins with the same ones.
            kept = np.zeros((p.words.shape[1] + 1, len(q.texts)), dtype=np.uint8)
            sums = [kept[0]] * (p.words.shape[1] + 1)
            to = _ids_in(p, q)
            rows = np.where(to < len(q.ids), row[to], -2).tolist()
            to = to.tolist()
            for i, words, same in p.by_prefix():
                n, t = p.size[i], p.least[i]
                if n < 255:
                    for k in range(same, len(words)):
                        w = words[k]
                        r = rows[w]
                        if r >= 0:
                            sums[k + 1] = np.add(sums[k], dense[r], out=kept[k + 1])
                        elif r == -2:
                            sums[k + 1] = sums[k]
                        else:
                            kept[k + 1] = sums[k]
                            kept[k + 1, of[at[to[w]] : at[to[w] + 1]]] += np.uint8(q.letters[to[w]])
                            sums[k + 1] = kept[k + 1]
                    acc = sums[len(words)]
                else:
                    acc = np.zeros(len(q.texts), dtype=np.int64)
                    for w in words:
                        if rows[w] != -2:
                            acc[of[at[to[w]] : at[to[w] + 1]]] += q.letters[to[w]]
                k = int(acc.argmax())
                top = int(acc[k]) - 1
                if top > 0 and 2 * top >= (t - 1e-5) * (top + min(n, least)):
                    j = np.flatnonzero(acc >= max(2, int(np.floor(1 + t / (2 - t) * min(n, least) - 1e-3))))
                    one, less = acc[j].astype(np.float64) - 1, np.minimum(n, q.size[j])
                    ratio = 1 - (less - one) / (one + less)
                    most = ratio.max()
                    if most >= t - 1e-9:
                        if most > t + 1e-9:
                            p.least[i] = t = most
                            found[i].clear()
                        found[i].update(q.texts[b] for b in j[ratio >= most - 1e-9])
                m = int(q.size[k])
                if t < 1 and 2 * (top + 1 + LIKELY * (min(n, m) - top - 1)) > t * (n + m):
                    p.least[i] = max(t, token_set_ratio(p.texts[i], q.texts[k]) / 100)

    def letters(self, q: Block) -> None:
        """Takes the best by letters. What has a ratio of 100 needs none."""
        for p, found in zip(self.blocks, self.found):
            lo, hi = p.size[0] * self.threshold / (200 - self.threshold), p.size[-1] * (200 - self.threshold) / self.threshold
            if hi + 1e-6 < q.size[0] or lo - 1e-6 > q.size[-1]:
                continue
            for i, y, score in compare_rows(p, q):
                if score > p.least[i] + 1e-9:
                    p.least[i] = score
                found[i].add(y)

    def rows(self) -> Iterator[tuple[str, str, float]]:
        for p, found in zip(self.blocks, self.found):
            for x, ys in zip(p.texts, found):
                scored = [(y, token_set_ratio(x, y)) for y in ys]
                most = max((r for _, r in scored), default=0.0)
                yield from ((x, y, r) for y, r in scored if r >= most and r >= self.threshold)


def _blocks(df: DataFrame, c: str, block: int = BLOCK, step: float = STEP) -> DataFrame:
    """(k, lo, hi, c, least): blocks of strings of near lengths, with their least and largest length."""
    size = F.length(F.array_join(set_words(F.col(c)), " "))
    rows = cut(df.select(c, "least", size.alias("n")).where("n > 0").withColumn("g", F.floor(F.log("n") / float(np.log(step))).cast("int")))
    parts = rows.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    keyed = rows.join(parts, "g").withColumn("part", F.pmod(F.xxhash64(c), F.col("parts")))
    made = keyed.groupBy("g", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.collect_list(c).alias(c), F.collect_list("least").alias(f"least_{c}"), F.min("least").alias("m"))
    return cut(made.select(F.format_string("%d-%d", "g", "part").alias(f"k_{c}"), F.col("lo").alias(f"lo_{c}"), F.col("hi").alias(f"hi_{c}"), F.col("m").alias(f"m_{c}"), c, f"least_{c}"))


def _block_pairs(a: DataFrame, b: DataFrame, near: Column, work, schema: str) -> DataFrame:
    """What work finds in the pairs of blocks of which near holds. Whole blocks are spread by pairs of keys, so every core
    has some; a block pair is the unit of work."""
    met = a.select("k_x", "lo_x", "hi_x", "m_x").join(b.select("k_y", "lo_y", "hi_y"), near).select("k_x", "k_y")
    both = met.join(a.select("k_x", "x", "least_x"), "k_x").join(b.select("k_y", "y"), "k_y").repartition(partitions(a.sparkSession), "k_x", "k_y")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Block] = {}

        def block(key: str, texts, least) -> Block:
            if key not in made:
                if len(made) >= 16:
                    made.pop(next(iter(made)))
                made[key] = Block(list(texts), list(least))
            return made[key]

        for pdf in batches:
            for kx, ky, x, m, y in zip(pdf["k_x"], pdf["k_y"], pdf["x"], pdf["least_x"], pdf["y"]):
                rows = work(block(f"x{kx}", x, m), block(f"y{ky}", y, np.zeros(len(y))))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return both.mapInPandas(run, schema)


def word_pairs(a: DataFrame, b: DataFrame, best: bool = False) -> DataFrame:
    """(x, y, top): all pairs of two sides' blocks whose common words alone reach the threshold of x, 100 among them, with
    the ratio of these words; with best, all those of the largest such ratio of an x."""
    return _block_pairs(a, b, F.lit(True), lambda p, q: by_words(p, q, best), "x string, y string, top double")


def letter_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y): all pairs of two sides' blocks that reach the threshold of x by their letters."""
    t = F.col("m_x") / 100
    near = (F.col("hi_y") >= F.col("lo_x") * t / (2 - t) - 1e-6) & (F.col("lo_y") <= F.col("hi_x") * (2 - t) / t + 1e-6)
    return _block_pairs(a, b, near, compare, "x string, y string")


def best_pairs(xs: DataFrame, ys: DataFrame, threshold: float) -> DataFrame:
    """(x, y, score): for every x, its y of the largest ratio, all of them, from threshold up. A task has a part of the x and
    sees the blocks of y one after the other, so what it found in one lets it pass over most of the next."""
    spark = xs.sparkSession
    count = max(partitions(spark), -(-xs.count() // PART))
    # One key for each of the partitions, so every task has just one part.
    keys = spark.range(30 * count).groupBy(F.pmod(F.hash("id"), F.lit(count)).alias("part")).agg(F.min("id").alias("id"))
    mine = xs.groupBy(F.pmod(F.xxhash64("x"), F.lit(count)).cast("int").alias("part")).agg(F.collect_list("x").alias("texts"))
    mine = mine.join(keys, "part").select("id", F.lit(-1).alias("turn"), F.lit("").alias("k"), "texts")
    blocks = _blocks(ys.withColumn("least", F.lit(0.0)), "y", WIDE, WIDE_STEP)
    turns = mine.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    both = mine.unionByName(turns.crossJoin(blocks.select(F.col("k_y").alias("k"), F.col("y").alias("texts"))))
    both = both.repartition(count, "id").sortWithinPartitions("id", "turn", "k")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in batches:
            for turn, texts in zip(pdf["turn"], pdf["texts"]):
                if turn < 0:
                    if best:
                        yield pd.DataFrame(best.rows(), columns=["x", "y", "score"])
                    best = Best(list(texts), threshold)
                else:
                    q = Block(list(texts), [0.0] * len(texts))
                    best.letters(q) if turn else best.words(q)
        if best:
            yield pd.DataFrame(best.rows(), columns=["x", "y", "score"])

    return both.mapInPandas(run, "x string, y string, score double")


def similar_pairs(xs: DataFrame, ys: DataFrame, threshold: float, best: bool = False) -> DataFrame:
    """(x, y, score): all pairs of a string of xs (x) and one of ys (y) with a token set ratio from threshold up; with best,
    only those of the largest ratio of an x."""
    has_words = lambda c: F.size(set_words(F.col(c))) > 0
    xs, ys = cut(xs.select("x").where("x is not null").distinct()), cut(ys.select("y").where("y is not null").distinct())
    if best:
        return best_pairs(xs.where(has_words("x")), ys, threshold)
    a, b = _blocks(xs.withColumn("least", F.lit(float(threshold))), "x"), _blocks(ys.withColumn("least", F.lit(0.0)), "y")
    found = cut(word_pairs(a, b)).select("x", "y").unionByName(letter_pairs(a, b)).distinct()
    return spread(found, "x", "y").withColumn("score", token_set_udf("x", "y")).where(F.col("score") >= threshold)
