"""All pairs of two sides' texts whose TF-IDF cosine reaches a threshold, without loss.

The grams of a text stand in one order for all texts, the rarest first, as numbers that begin with the count of the gram.
What a pair has in common from a gram on yields at most the norms of both texts from there on. So the first common gram of
a pair that reaches the threshold is one at which the product of these norms does, and only there partners are looked for:
in lists by gram, of which just the beginning has norms that are large enough.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersieve.session import cut, discard, partitions

BLOCK = 100_000  # texts in a block of the side that is searched
PART = 50_000  # texts whose grams are numbered together
WIDE = 64  # grams of a text that have a place in a row
SHIFT = 32  # bits of a gram's number below its count
SLACK = 1e-4  # for sums of single precision


def text_grams(bag: str) -> list[str]:
    """Words and pairs of neighbouring words of the lines of a text."""
    out = []
    for line in bag.split("\n"):
        w = line.split(" ")
        out += w
        out += [f"{a} {b}" for a, b in zip(w, w[1:])]
    return out


class Vectors:
    """Texts as rows: their grams in order, weights, norms, and the squared norm (of 1) from each gram on."""

    def __init__(self, codes: list[np.ndarray], norms: np.ndarray, total: int):
        flat = np.concatenate(codes) if len(codes) else np.zeros(0, dtype=np.int64)
        row = np.repeat(np.arange(len(codes), dtype=np.int32), [len(c) for c in codes])
        first = np.ones(len(flat), dtype=bool)
        first[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(first)
        self.norm, self.code, self.row = norms, flat[at], row[at]
        self.y = np.diff(np.append(at, len(flat))) * (np.log((1.0 + total) / (1 + (self.code >> SHIFT))) + 1)
        self.start = np.searchsorted(self.row, np.arange(len(codes) + 1))
        self.x = self.y / norms[self.row]
        square = self.x * self.x
        run = np.concatenate([[0.0], np.cumsum(square)])
        self.since = np.maximum(run[self.start[self.row + 1]] - run[1:], 0.0) + square


class Lists:
    """The texts of a block by gram, those with the largest norm from it on first."""

    def __init__(self, v: Vectors):
        self.norm, self.start, self.y = v.norm, v.start, v.y
        self.grams, local = np.unique(v.code, return_inverse=True)
        self.local = local.astype(np.int32)
        order = np.lexsort((-v.since, self.local))
        self.texts = v.row[order]
        self.keys = self.local[order] + np.clip(1 - v.since[order], 0, 1 - 1e-9)
        self.begin = np.searchsorted(self.local[order], np.arange(len(self.grams) + 1))
        self.met = np.zeros(len(v.norm), dtype=bool)
        self.weights, self.single = np.zeros(len(self.grams) + 1), np.zeros(len(self.grams) + 1, dtype=np.float32)
        # The first grams of every text as one row, for a sum of single precision; long texts are always scored.
        size = np.diff(v.start)
        wide = min(WIDE, int(size.max(initial=0)))
        self.long, place = size > wide, np.arange(len(v.row)) - v.start[v.row]
        self.row_grams = np.full((len(v.norm), wide), len(self.grams), dtype=np.int32)
        self.row_x = np.zeros((len(v.norm), wide), dtype=np.float32)
        some = place < wide
        self.row_grams[v.row[some], place[some]], self.row_x[v.row[some], place[some]] = self.local[some], v.x[some]

    def partners(self, q: Vectors, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, text, cosine in percent) of all pairs with a common gram, from least up."""
        t = least / 100
        gram = np.minimum(np.searchsorted(self.grams, q.code), max(0, len(self.grams) - 1))
        known = self.grams[gram] == q.code if len(self.grams) else np.zeros(len(q.code), dtype=bool)
        lo = self.begin[gram] if len(self.grams) else np.zeros(len(q.code), dtype=np.int64)
        hi = np.searchsorted(self.keys, gram + 1 - t * t / np.maximum(q.since, 1e-300) + 1e-6, side="right")
        hi = np.where(known, np.clip(hi, lo, self.begin[gram + 1] if len(self.grams) else lo), lo)
        use = np.flatnonzero(hi > lo)
        bounds = np.searchsorted(q.row[use], np.arange(len(q.norm) + 1)).tolist()
        lo_, hi_ = lo[use].tolist(), hi[use].tolist()
        gram = np.where(known, gram, len(self.grams))
        texts, met, out = self.texts, self.met, []
        for i in range(len(q.norm)):
            a, b = bounds[i], bounds[i + 1]
            if a == b:
                continue
            for k in range(a, b):
                met[texts[lo_[k] : hi_[k]]] = True
            found = np.flatnonzero(met)
            met[found] = False
            own = slice(q.start[i], q.start[i + 1])
            self.single[gram[own]] = q.x[own]
            self.single[-1] = 0
            # Indices are within bounds, and clipping is faster than checking that.
            near = np.einsum("ij,ij->i", self.single.take(self.row_grams.take(found, 0, mode="clip"), mode="clip"), self.row_x.take(found, 0, mode="clip"))
            found = found[(near >= t - SLACK) | self.long[found]]
            self.single[gram[own]] = 0
            if len(found):
                self.weights[gram[own]] = q.y[own]
                self.weights[-1] = 0
                size = self.start[found + 1] - self.start[found]
                ends = np.cumsum(size)
                at = np.arange(ends[-1]) + np.repeat(self.start[found] - (ends - size), size)
                cosine = 100 * np.add.reduceat(self.weights[self.local[at]] * self.y[at], ends - size) / (q.norm[i] * self.norm[found])
                self.weights[gram[own]] = 0
                keep = cosine >= least
                if keep.any():
                    out.append((np.full(int(keep.sum()), i), found[keep], cosine[keep]))
        return tuple(np.concatenate([o[k] for o in out]) for k in range(3)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def placed(df: DataFrame, n: int, c: str) -> DataFrame:
    """One partition for each number from 0 to n - 1 of the column c."""
    rows = df.sparkSession.range(30 * n + 100).groupBy(F.pmod(F.hash("id"), F.lit(n)).cast("int").alias("p")).agg(F.min("id").alias("id")).collect()
    keys = {r.p: r.id for r in rows}
    return df.repartition(n, F.element_at(F.array(*(F.lit(keys.get(p, -p)).cast("long") for p in range(n))), (F.col(c) + 1).cast("int")))


def cosine_pairs(texts: DataFrame, total: int, least: float) -> DataFrame:
    """(q_id, c_id, cosine) of texts (side, id, words); the texts of an id count as one. Equal ones are compared once. texts is
    a table that cut wrote; it is deleted as soon as it has been read."""
    spark = texts.sparkSession
    bags = texts.where("words <> ''").groupBy("side", "id").agg(F.array_join(F.sort_array(F.collect_list("words")), "\n").alias("bag"))
    # What is written here lets Spark delete the shuffle files of the stages before.
    kinds = cut(bags.groupBy("side", "bag").agg(F.count("*").alias("n")).withColumn("no", F.monotonically_increasing_id()), reclaim=True)
    members = cut(bags.join(kinds.hint("merge"), ["side", "bag"]).select("side", "no", "id"), reclaim=True)
    discard(texts)
    size = {r.side: r["count"] for r in kinds.groupBy("side").count().collect()}
    parts = max(partitions(spark), -(-sum(size.values()) // PART))
    kinds = kinds.withColumn("part", F.pmod(F.xxhash64("no"), F.lit(parts)).cast("int"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: dict[int, tuple[Counter, Counter]] = {}
        for pdf in batches:
            for part, side, bag, n in zip(pdf["part"], pdf["side"], pdf["bag"], pdf["n"]):
                c = tally.setdefault(part, (Counter(), Counter()))[side == "c"]
                for g in set(text_grams(bag)):
                    c[g] += n
        for part, (q, c) in tally.items():
            names = list(q.keys() | c.keys())
            yield pd.DataFrame({"part": part, "g": names, "q": [q[g] for g in names], "c": [c[g] for g in names]})

    met = cut(placed(kinds.select("part", "side", "bag", "n"), parts, "part").mapInPandas(count, "part int, g string, q long, c long"), reclaim=True)
    known = cut(met.groupBy("g").agg(F.sum("q").alias("q"), F.sum("c").alias("c")).withColumn("id", F.monotonically_increasing_id()), reclaim=True)
    inside = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    wide = (known.agg(F.max(inside)).first()[0] or 0) + 1
    # A gram of one side only has its count, negative, as it adds to norms alone.
    number = F.shiftleft(F.col("q") + F.col("c"), SHIFT) + F.shiftright("id", 33) * wide + inside
    coded = known.select("g", F.when((F.col("q") > 0) & (F.col("c") > 0), number).otherwise(-F.col("q") - F.col("c")).alias("v"))
    book = met.select("part", "g").join(coded.hint("merge"), "g").select("part", F.lit(0).alias("turn"), F.lit("").alias("side"), F.col("g").alias("s"), "v")
    both = book.unionByName(kinds.select("part", F.lit(1).alias("turn"), "side", F.col("bag").alias("s"), F.col("no").alias("v")))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, names, weight = None, {}, {}
        for pdf in batches:
            rows = []
            for part, turn, side, s, v in zip(pdf["part"], pdf["turn"], pdf["side"], pdf["s"], pdf["v"]):
                if part != here:
                    here, names = part, {}
                if not turn:
                    names[s] = v
                    continue
                codes, squares = [], 0.0
                for g, f in Counter(text_grams(s)).items():
                    c = names[g]
                    df = c >> SHIFT if c > 0 else -c
                    w = weight.get(df) or weight.setdefault(df, math.log((1.0 + total) / (1 + df)) + 1)
                    squares += (f * w) ** 2
                    if c > 0:
                        codes += [c] * f
                if codes:
                    rows.append((side, v, math.sqrt(squares), sorted(codes)))
            yield pd.DataFrame(rows, columns=["side", "no", "norm", "codes"])

    vectors = placed(both, parts, "part").sortWithinPartitions("part", "turn").mapInPandas(code, "side string, no long, norm double, codes array<long>")
    # Every block of one side meets every part of the other, which goes by it and so may be large.
    blocks = max(1, -(-size.get("c", 0) // BLOCK))
    runs = max(1, -(-spark.sparkContext.defaultParallelism // blocks))
    of = lambda n: F.pmod(F.xxhash64("no", F.lit(1)), F.lit(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    cells = F.when(F.col("side") == "c", F.transform(upto(runs), lambda j: of(blocks) * runs + j)).otherwise(F.transform(upto(blocks), lambda k: k * runs + of(runs)))
    grid = placed(vectors.select(F.explode(cells).alias("cell"), (F.col("side") == "q").alias("asks"), "no", "norm", "codes"), blocks * runs, "cell").sortWithinPartitions("cell", "asks")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, lists, held = None, None, []
        for pdf in batches:
            for (cell, asks), rows in pdf.groupby(["cell", "asks"]):
                if cell != here:
                    here, lists, held = cell, None, []
                if not asks:
                    held.append(rows)
                    continue
                if held:
                    texts = pd.concat(held)
                    lists, nos, held = Lists(Vectors(list(texts["codes"]), texts["norm"].to_numpy(), total)), texts["no"].to_numpy(), []
                    del texts
                if lists is not None:
                    i, j, cosine = lists.partners(Vectors(list(rows["codes"]), rows["norm"].to_numpy(), total), least)
                    yield pd.DataFrame({"x": rows["no"].to_numpy()[i], "y": nos[j], "cosine": cosine})

    found = grid.mapInPandas(search, "x long, y long, cosine double")
    of_side = lambda side, no, c: members.where(F.col("side") == side).select(F.col("no").alias(no), F.col("id").alias(c)).hint("merge")
    return found.join(of_side("q", "x", "q_id"), "x").join(of_side("c", "y", "c_id"), "y").select("q_id", "c_id", "cosine")
