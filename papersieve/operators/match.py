"""Sentence matching in stages: exact (equal or contained), fuzzy, semantic. Each stage takes what the former left.

All stages work on distinct cleaned sentences; copies are attached again at the end, so a sentence that a third of all
texts share is compared once. Ties go to the earliest source sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papersieve.functions.setjoin import similar_pairs
from papersieve.functions.similarity import ALONE, KAPPA, gram_cosine_udf, grams, partial_above
from papersieve.functions.text import tokens
from papersieve.session import cut

EXACT, FUZZY_MATCH, SEMANTIC_MATCH = "Exact Match", "Fuzzy Match", "Semantic Similarity"
FUZZY = 80.0
SEMANTIC = 75.0
GATE = 55.0


def source_index(src: DataFrame) -> DataFrame:
    """(clean, source_id, src_idx): the first place of every distinct source sentence."""
    return src.groupBy("clean").agg(F.min(F.struct("source_id", "sent_idx")).alias("at")).select("clean", "at.source_id", F.col("at.sent_idx").alias("src_idx"))


def exact_equal(docs: DataFrame, src: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, source_id, src_idx): sentences that a source holds word for word."""
    return docs.join(source_index(src), "clean").select("doc_id", "sent_idx", "source_id", "src_idx")


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short, long): pairs of distinct sentences of which the first is part of the second, as characters.

    The first and the last word of the short one may be word fragments in the long one, but its inner words must stand
    there as words; the rarest of them (by its count among the long ones) is the only join key.
    """
    words = long.select(F.col("clean").alias("long"), F.explode(F.array_distinct(tokens(F.col("clean")))).alias("w"))
    counts = words.groupBy("w").agg(F.count("*").alias("n"))
    t = tokens(F.col("clean"))
    inner = short.select(F.col("clean").alias("short"), F.explode(F.array_distinct(F.slice(t, F.lit(2), F.size(t) - 2))).alias("w"))
    # An inner word that no long sentence has excludes the short one at once.
    rare = inner.join(counts, "w", "left").groupBy("short").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w")).alias("k")).where("k.n > 0").select("short", "k.w")
    return rare.join(words, "w").where(F.expr("contains(long, short)")).select("short", "long").distinct()


def exact_matches(docs: DataFrame, src: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, source_id, src_idx): equal or contained either way; the first source sentence wins."""
    d, s = docs.select("clean").distinct(), source_index(src)
    c = s.select("clean")
    pairs = contained(d, c).select(F.col("short").alias("clean"), F.col("long").alias("other")).unionByName(contained(c, d).select(F.col("long").alias("clean"), F.col("short").alias("other"))).distinct()
    pairs = pairs.join(s.withColumnRenamed("clean", "other"), "other")
    first = pairs.groupBy("clean").agg(F.min(F.struct("source_id", "src_idx")).alias("at"))
    return docs.join(first, "clean").select("doc_id", "sent_idx", "at.source_id", "at.src_idx")


def fuzzy_best(docs: DataFrame, src: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """(doc_id, sent_idx, source_id, src_idx, score): the best source sentence by token set ratio, from threshold up."""
    d, s = docs.select("clean").distinct(), source_index(src)
    scored = similar_pairs(d.withColumnRenamed("clean", "x"), s.select(F.col("clean").alias("y")), threshold, best=True)
    at = scored.withColumnsRenamed({"x": "clean", "y": "other"}).join(s.withColumnRenamed("clean", "other"), "other")
    best = at.groupBy("clean").agg(F.max_by(F.struct("source_id", "src_idx", "score"), F.struct("score", F.negative("source_id"), F.negative("src_idx"))).alias("m"))
    return docs.join(best, "clean").select("doc_id", "sent_idx", "m.source_id", "m.src_idx", F.round("m.score", 1).alias("score"))


def semantic_first(docs: DataFrame, src: DataFrame, threshold: float = SEMANTIC, min_tokens: int = 8) -> DataFrame:
    """(doc_id, sent_idx, source_id, src_idx, score): the first of all source sentences that reaches the threshold by the
    TF-IDF cosine of the pair and the gate by its best window. Both read the sentence as it stands for the cosine and its
    cleaned form for the window.

    A pair reaches the threshold only if the grams that one text has alone hold no more than a certain part of its squared
    counts. So of a text's grams, in one order for all texts, the first common one comes within that part: only such grams
    are keys, those of the fewest pairs first. Nothing is lost.
    """
    t = threshold / 100
    r = (1 - t * t) / (t * t * KAPPA * KAPPA)
    alone = max(r / (1 + r), 1 - t) + 1e-9
    numbered = lambda df: cut(df.withColumn("g", _semantic_grams(F.col("sentence"))).where(F.size("g") > 0).withColumn("n", F.monotonically_increasing_id()))
    mine = numbered(docs.where(F.size(tokens(F.col("clean"))) >= min_tokens).select("sentence", "clean").distinct())
    theirs = numbered(src.groupBy("sentence", "clean").agg(F.min(F.struct("source_id", "sent_idx")).alias("at")))
    of = lambda df, side: df.select(F.lit(side).alias("side"), "n", F.explode("g").alias("g")).groupBy("side", "n", "g").agg(F.count("*").alias("f"))
    counts = of(mine, 0).unionByName(of(theirs, 1))
    pairs = counts.groupBy("g").agg((F.count(F.when(F.col("side") == 0, 1)) * F.count(F.when(F.col("side") == 1, 1))).alias("pairs"))
    text = W.partitionBy("side", "n")
    squares = F.sum(F.col("f") * F.col("f"))
    ranked = counts.join(pairs, "g").select("side", "n", "g", "pairs", squares.over(text).alias("all"), F.max("f").over(text).alias("most"), F.coalesce(squares.over(text.orderBy("pairs", "g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    keys = cut(ranked.where((F.col("pairs") > 0) & (F.col("before") <= alone * F.col("all"))).select("side", "n", "g", "all", "most"))
    # The dot product is at most the squares of one side times the largest count of the other.
    near = lambda a, b: F.col(f"{a}_all") * t * t <= F.col(f"{b}_all") * F.col(f"{a}_most") ** 2 + 1e-6
    side = lambda k, c: keys.where(F.col("side") == k).select("g", F.col("n").alias(c), F.col("all").alias(f"{c}_all"), F.col("most").alias(f"{c}_most"))
    met = side(0, "x").join(side(1, "y"), "g").where(near("x", "y") & near("y", "x")).select("x", "y").distinct()
    tried = met.join(mine.select(F.col("n").alias("x"), "g"), "x").join(theirs.select(F.col("n").alias("y"), F.col("g").alias("h")), "y")
    reached = tried.withColumn("score", gram_cosine_udf("g", "h")).where(F.col("score") >= threshold).select("x", "y", "score")
    scored = reached.join(mine.select(F.col("n").alias("x"), "sentence", "clean"), "x").join(theirs.select(F.col("n").alias("y"), "at", F.col("clean").alias("other_clean")), "y")
    gated = scored.where(partial_above(GATE)("clean", "other_clean"))
    best = gated.groupBy("sentence", "clean").agg(F.min(F.struct("at.source_id", "at.sent_idx", "score")).alias("m"))
    return docs.join(best, ["sentence", "clean"]).select("doc_id", "sent_idx", "m.source_id", F.col("m.sent_idx").alias("src_idx"), F.round("m.score", 1).alias("score"))


def _semantic_grams(c: Column) -> Column:
    """The grams of a text; where it has none, its words, marked as such, so they meet no gram."""
    words = F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    return F.when(F.size(grams(c)) > 0, grams(c)).otherwise(F.transform(words, lambda w: F.concat(F.lit(ALONE), w)))


def staged_matches(docs: DataFrame, src: DataFrame, semantic: bool = True) -> DataFrame:
    """All stages, or all but the semantic one: (doc_id, sent_idx, source_id, src_idx, score, algorithm), at most one match
    per sentence. Each stage is written once, as the next one and the result both read it."""
    keys = ["doc_id", "sent_idx"]
    exact = cut(exact_matches(docs, src).withColumn("score", F.lit(100.0)).withColumn("algorithm", F.lit(EXACT)))
    rest = docs.join(exact.select(*keys), keys, "left_anti")
    fuzzy = fuzzy_best(rest, src).withColumn("algorithm", F.lit(FUZZY_MATCH))
    if not semantic:
        return exact.unionByName(fuzzy)
    fuzzy = cut(fuzzy)
    rest = rest.join(fuzzy.select(*keys), keys, "left_anti")
    return exact.unionByName(fuzzy).unionByName(semantic_first(rest, src).withColumn("algorithm", F.lit(SEMANTIC_MATCH)))
