"""String similarities: token sets, best windows, TF-IDF of a pair, with Catalyst bounds before any Python."""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papersieve.functions.gramjoin import cosine_pairs
from papersieve.session import cut

ALONE = " "  # before the words of a text without grams, as no gram begins with it
KAPPA = 1.4054651081081644  # 1 + ln(3/2): the weight of a gram that only one of two texts holds


def lcs_length(x: str, y: str) -> int:
    """Longest common subsequence by bit vectors over the shorter string."""
    if len(x) > len(y):
        x, y = y, x
    masks: dict[str, int] = {}
    for i, c in enumerate(x):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for c in y:
        u = row & masks.get(c, 0)
        row = (row + u | row - u) & full
    return len(x) - bin(row).count("1")


def ratio(x: str, y: str) -> float:
    """100 times one minus the insertions and deletions over the summed lengths."""
    return 100.0 * 2 * lcs_length(x, y) / (len(x) + len(y)) if x or y else 100.0


def token_set_ratio(x: str | None, y: str | None) -> float:
    """Best of the ratios among the common words and either whole word set; 0 if a side is empty."""
    a, b = set((x or "").split()), set((y or "").split())
    if not a or not b:
        return 0.0
    common, left, right = " ".join(sorted(a & b)), " ".join(sorted(a - b)), " ".join(sorted(b - a))
    if common and not (left and right):
        return 100.0
    one = f"{common} {left}" if common else left
    two = f"{common} {right}" if common else right
    best = ratio(one, two)
    if common:
        s, p, q = len(common), len(one), len(two)
        best = max(best, 100.0 * (1 - (p - s) / (s + p)), 100.0 * (1 - (q - s) / (s + q)))
    return best


@lru_cache(maxsize=4096)
def partial_ratio(x: str, y: str) -> float:
    """Best ratio of the shorter string with a window of the longer one, windows cut at the ends included."""
    if len(x) > len(y):
        x, y = y, x
    if not x:
        return 100.0 if not y else 0.0
    n = len(x)
    spans = [y[max(0, i) : i + n] for i in range(1 - n, len(y))]
    return max(ratio(x, w) for w in set(spans))


@F.pandas_udf(T.DoubleType())
def token_set_udf(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(a, b) for a, b in zip(x, y)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def partial_udf(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(a or "", b or "") for a, b in zip(x, y)], dtype="float64")


@lru_cache(maxsize=4096)
def partial_exceeds(x: str, y: str, gate: float) -> bool:
    """Whether partial_ratio is above the gate; ends at the first window that shows it."""
    if len(x) > len(y):
        x, y = y, x
    n = len(x)
    if not n:
        return partial_ratio(x, y) > gate
    # Whole windows first, as a cut one holds less.
    starts = [*range(len(y) - n + 1), *range(-1, -n, -1), *range(len(y) - n + 1, len(y))]
    return any(ratio(x, w) > gate for w in dict.fromkeys(y[max(0, i) : i + n] for i in starts))


def partial_above(gate: float):
    """partial_exceeds as a column function."""

    @F.pandas_udf(T.BooleanType())
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([partial_exceeds(a or "", b or "", gate) for a, b in zip(x, y)], dtype="bool")

    return of


def token_set_bound(x: Column, y: Column) -> Column:
    """An upper bound of token_set_ratio from lengths alone: the difference of two strings is at least that of their
    lengths. It is exact where a closed term decides, so most pairs never reach Python."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    a, b = words(x), words(y)
    joined = lambda arr: F.length(F.array_join(arr, " "))
    common, left, right = F.array_intersect(a, b), F.array_except(a, b), F.array_except(b, a)
    s, p, q = joined(common), joined(left), joined(right)
    gap = F.when((s > 0), 1).otherwise(0)
    la, lb = s + gap + p, s + gap + q
    lengths = 1 - F.abs(p - q) / (la + lb)
    one, two = 1 - (gap + p) / (s + la), 1 - (gap + q) / (s + lb)
    best = F.when(s > 0, F.greatest(lengths, one, two)).otherwise(lengths)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when((s > 0) & ((p == 0) | (q == 0)), 100.0).otherwise(100.0 * best)


def grams(col: Column) -> Column:
    """Words of two or more letters and pairs of neighbouring words, in lower case, with repetitions."""
    w = F.regexp_extract_all(F.lower(col), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))
    return F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>")))


def jaccard(x: Column, y: Column) -> Column:
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    a, b = words(x), words(y)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(100.0 * F.size(F.array_intersect(a, b)) / union)


def pair_tfidf(x: Column, y: Column) -> Column:
    """TF-IDF cosine of a model fitted on exactly the two texts, in percent: grams of both weigh 1, others KAPPA."""
    a, b = grams(x), grams(y)
    count = lambda arr, g: F.size(F.filter(arr, lambda w: w == g)).cast("double")
    both = F.array_intersect(a, b)
    total = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda s, g: s + f(g))
    dot = total(both, lambda g: count(a, g) * count(b, g))
    k2 = KAPPA * KAPPA
    na = total(both, lambda g: count(a, g) ** 2) + k2 * total(F.array_except(a, b), lambda g: count(a, g) ** 2)
    nb = total(both, lambda g: count(b, g) ** 2) + k2 * total(F.array_except(b, a), lambda g: count(b, g) ** 2)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), jaccard(x, y)).otherwise(100.0 * dot / (F.sqrt(na) * F.sqrt(nb)))


def gram_cosine(a: list[str], b: list[str]) -> float:
    """pair_tfidf of two texts by their grams; of texts without grams by their marked words."""
    x, y = Counter(a), Counter(b)
    both = x.keys() & y.keys()
    if not both:
        return 0.0
    if a[0].startswith(ALONE):
        return 100.0 * len(both) / len(x.keys() | y.keys())
    k2 = KAPPA * KAPPA
    mine, theirs = (sum(c[g] ** 2 for g in both) for c in (x, y))
    na, nb = (own + k2 * (sum(n * n for n in c.values()) - own) for own, c in ((mine, x), (theirs, y)))
    return 100.0 * sum(x[g] * y[g] for g in both) / (math.sqrt(na) * math.sqrt(nb))


@F.pandas_udf(T.DoubleType())
def gram_cosine_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([gram_cosine(list(x), list(y)) for x, y in zip(a, b)], dtype="float64")


def pair_tfidf_bound(a: Column, b: Column) -> Column:
    """An upper bound of pair_tfidf from the grams of both texts, by the sizes of their sets alone.

    Grams of one side only have a squared weight of KAPPA ** 2 at least each; the others, of which no more occurrences are
    left, have at most that number times the largest count it allows.
    """
    both = F.size(F.array_intersect(a, b))

    def part(x: Column, y: Column) -> Column:
        only = F.size(F.array_except(x, y))
        left = F.size(x) - only
        most = left * (left - both + 1)
        return F.when(both == 0, 0.0).otherwise(F.sqrt(most / (most + KAPPA * KAPPA * only)))

    return 100.0 * part(a, b) * part(b, a)


def pair_tfidf_frame(pairs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, cosine) of pair_tfidf for many pairs: one row per gram and pair, summed twice, instead of scans of arrays."""
    side = lambda c, a, b: pairs.select(*keys, F.explode(grams(F.col(c))).alias("g"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    f = side(x, 1, 0).unionByName(side(y, 0, 1)).groupBy(*keys, "g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    k2 = KAPPA * KAPPA
    square = lambda c, o: F.sum(F.when(F.col(o) > 0, 1.0).otherwise(k2) * F.col(c) * F.col(c))
    return f.groupBy(*keys).agg((100.0 * F.sum(F.col("a") * F.col("b")) / (F.sqrt(square("a", "b")) * F.sqrt(square("b", "a")))).alias("cosine"))


def batch_tfidf(queries: DataFrame, corpus: DataFrame, least: float = 0.0) -> DataFrame:
    """(q_id, c_id, cosine) in percent of all pairs with a common gram and at least so much, by one TF-IDF model of word
    grams fitted on both sides (id, t). No side is bounded, so none goes to the driver to be broadcast."""
    words = F.array_join(F.regexp_extract_all(F.lower("t"), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)), " ")
    of = lambda df, side: df.select(F.lit(side).alias("side"), "id", words.alias("words"))
    texts = cut(of(queries, "q").unionByName(of(corpus, "c")), reclaim=True)
    return cosine_pairs(texts, texts.count(), least)
