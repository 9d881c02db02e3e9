"""Scores of a submission from its matches, as one aggregation per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the risk bands, in percent, and the weights of the algorithms.
RISK_BANDS = (("Very Low", 10.0), ("Low", 25.0), ("Moderate", 40.0), ("High", 60.0))
FUZZY_WEIGHT, SEMANTIC_WEIGHT = 0.85, 0.70


def risk_level(pct: Column) -> Column:
    out = F.lit("Very High")
    for name, most in reversed(RISK_BANDS):
        out = F.when(pct <= most, name).otherwise(out)
    return out


def breakdown(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per document: words and counts per algorithm, effective words, percentages and the risk level.

    matches: (doc_id, algorithm, words); docs: (doc_id, doc_words). Documents without matches have zeros; documents
    without words have a percentage of 0.
    """
    of = lambda name: F.lower(F.col("algorithm")).contains(name)
    m = matches.groupBy("doc_id").agg(
        *(F.coalesce(F.sum(F.when(of(a), F.greatest(F.lit(1), F.col("words")))), F.lit(0)).cast("long").alias(f"{a}_words") for a in ("exact", "fuzzy", "semantic")),
        *(F.count_if(of(a)).alias(f"{a}_count") for a in ("exact", "fuzzy", "semantic")),
    )
    cols = [f"{a}_{k}" for k in ("words", "count") for a in ("exact", "fuzzy", "semantic")]
    j = docs.join(m, "doc_id", "left").na.fill(0, cols)
    effective = F.col("exact_words") + (F.col("fuzzy_words") * FUZZY_WEIGHT).cast("int") + (F.col("semantic_words") * SEMANTIC_WEIGHT).cast("int")
    pct = lambda w: F.when(F.col("doc_words") > 0, F.least(F.lit(100.0), w / F.col("doc_words") * 100)).otherwise(0.0)
    overall = pct(effective)
    return j.select("doc_id", "doc_words", *cols, effective.cast("long").alias("effective_words"), F.round(overall, 6).alias("overall_pct"), F.round(pct(F.col("exact_words")), 6).alias("exact_pct"), risk_level(overall).alias("risk_level"))
