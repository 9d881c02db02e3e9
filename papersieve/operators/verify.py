"""Verification of submissions: staged matches with their context, classified, and the scores that follow.

Sentences are those with offsets, before the bibliography and of MIN_WORDS words or more. A sentence has at most one
match: exact, else fuzzy, else semantic. Defined results: documents without sentences or matches have scores of 0; null
texts are no submissions' words; ties of sources go to the first sentence of the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve.functions.text import clean_for_analysis, tokens, url_domain, word_count
from papersieve.operators import audit, citations, match, profile, score, segment
from papersieve.session import cut

CATEGORIES = ("Quoted + Cited", "Quoted (Uncited)", "Copied + Cited Without Quotation", "Common Knowledge", "Copied + No Citation", "Paraphrased + Cited", "Paraphrased (Uncited)")


def sentences(df: DataFrame, id_col: str, text_col: str, min_words: int = segment.MIN_WORDS) -> DataFrame:
    """Sentences with offsets and their compared form: (id, sent_idx, start_char, end_char, sentence, clean)."""
    s = segment.sentences_with_offsets(df, id_col, text_col, min_words).withColumn("clean", clean_for_analysis(F.col("sentence")))
    return s.where(F.size(tokens(F.col("clean"))) >= min_words)


def submitted(docs: DataFrame) -> DataFrame:
    """Sentences of the bodies with is_quoted, is_cited and is_common."""
    body = cut(audit.bodies(docs))
    all_s = segment.sentences_with_offsets(body, "doc_id", "text")
    flagged = citations.annotate(all_s, citations.spans(body, "doc_id", "body"), "doc_id")
    inside = flagged.join(body.select("doc_id", "ref_start"), "doc_id").where("not (ref_start > 0 and start_char >= ref_start)").drop("ref_start")
    s = inside.withColumn("clean", clean_for_analysis(F.col("sentence")))
    return s.where(F.size(tokens(F.col("clean"))) >= segment.MIN_WORDS).withColumn("is_common", profile.common_phrase(F.col("clean")))


def category(algorithm: Column, quoted: Column, cited: Column, common: Column) -> Column:
    exact = F.when(quoted & cited, CATEGORIES[0]).when(quoted, CATEGORIES[1]).when(cited, CATEGORIES[2]).when(common, CATEGORIES[3]).otherwise(CATEGORIES[4])
    other = F.when(cited, CATEGORIES[5]).when(common, CATEGORIES[3])
    return F.when(algorithm == match.EXACT, exact).when(algorithm == match.FUZZY_MATCH, other.otherwise(CATEGORIES[4])).otherwise(other.otherwise(CATEGORIES[6]))


def ignored(quoted: Column, cited: Column, common: Column, filter_common: bool = True) -> Column:
    """Formulaic sentences that are neither quoted nor cited count as no match."""
    return F.lit(filter_common) & common & ~quoted & ~cited


def confidence(algorithm: Column, value: Column) -> Column:
    return F.when((algorithm == match.EXACT) | ((algorithm == match.FUZZY_MATCH) & (value >= 90)), "High").otherwise("Medium")


def classified(matches: DataFrame, filter_common: bool = True) -> DataFrame:
    """Adds match_category, confidence and is_ignored to matches with algorithm, score and the flags of the sentence."""
    a, q, c, k = (F.col(x) for x in ("algorithm", "is_quoted", "is_cited", "is_common"))
    return matches.withColumn("match_category", category(a, q, c, k)).withColumn("confidence", confidence(a, F.col("score"))).withColumn("is_ignored", ignored(q, c, k, filter_common))


def verified_matches(docs: DataFrame, src: DataFrame) -> DataFrame:
    """One row per matched sentence with its place, source, score, algorithm, flags, category and confidence. src:
    (source_id, title, url, text_content, source_type, reliability), one row per source."""
    mine = cut(submitted(docs))
    theirs = cut(sentences(src, "source_id", "text_content"))
    found = match.staged_matches(mine.select("doc_id", "sent_idx", "sentence", "clean"), theirs)
    m = found.join(mine.drop("clean"), ["doc_id", "sent_idx"])
    s = src.select("source_id", F.col("title").alias("source_name"), url_domain(F.col("url")).alias("source_domain"), "source_type", "reliability")
    return classified(m).join(s, "source_id", "left")


def scores(matches: DataFrame, docs: DataFrame, refs: DataFrame, found_issues: DataFrame, exclude_quotes: bool = True) -> DataFrame:
    """One row per document: words, counts and percentages by algorithm, quotation, citation, risk and commonness, the
    coverage of citations, the share of verified references, and the risk level."""
    words = F.greatest(F.lit(1), word_count(F.col("sentence")))
    live, quoted = ~F.col("is_ignored"), F.col("is_quoted")
    counted = live & ~quoted if exclude_quotes else live
    of = lambda name: F.lower("algorithm").contains(name)
    uncited = F.lower("match_category").contains("no citation") | (~quoted & ~F.col("is_cited"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, words)), F.lit(0)).cast("long")
    parts = {
        "exact_words": total(counted & of("exact")), "fuzzy_words": total(counted & of("fuzzy")), "semantic_words": total(counted & of("semantic")), "quoted_words": total(live & quoted),
        "high_risk_words": total(counted & uncited), "cited_words": total(counted & F.col("is_cited")), "common_words": total(counted & ~uncited & F.lower("match_category").contains("common")),
        "exact_count": F.count_if(counted & of("exact")), "fuzzy_count": F.count_if(counted & of("fuzzy")), "semantic_count": F.count_if(counted & of("semantic")),
        "quoted_count": F.count_if(live & quoted), "ignored_count": F.count_if(~live),
    }
    m = matches.groupBy("doc_id").agg(*(c.alias(n) for n, c in parts.items()))
    r = refs.groupBy("doc_id").agg(F.count_distinct("ref_id").alias("refs_total"), F.count_distinct(F.when(F.col("status").isin("VERIFIED", "PARTIALLY VERIFIED"), F.col("ref_id"))).alias("refs_verified"))
    i = found_issues.groupBy("doc_id").agg(F.count("*").alias("issues"))
    j = docs.select("doc_id", word_count(F.coalesce("text", F.lit(""))).alias("doc_words")).join(m, "doc_id", "left").join(r, "doc_id", "left").join(i, "doc_id", "left").na.fill(0)
    effective = F.col("exact_words") + F.floor(F.col("fuzzy_words") * score.FUZZY_WEIGHT) + F.floor(F.col("semantic_words") * score.SEMANTIC_WEIGHT)
    pct = lambda w: F.when(F.col("doc_words") > 0, F.least(F.lit(100.0), w / F.col("doc_words") * 100)).otherwise(0.0)
    shares = [F.round(pct(F.col(f"{x}_words")), 1).alias(f"{x}_pct") for x in ("exact", "fuzzy", "semantic", "quoted", "high_risk", "cited", "common")]
    some = F.col("doc_words") > 0
    coverage = F.when(some, F.round(100 - F.least(F.lit(80.0), F.col("issues") * 5.0), 1)).otherwise(100.0)
    checked = F.when(some & (F.col("refs_total") > 0), F.round(F.col("refs_verified") / F.col("refs_total") * 100, 1)).otherwise(100.0)
    return j.select("doc_id", "doc_words", *parts, effective.cast("long").alias("matched_words"), F.round(pct(effective), 1).alias("overall_pct"), *shares, coverage.alias("citation_coverage"), checked.alias("reference_verification"), score.risk_level(pct(effective)).alias("risk_level"))


SCORED_SECTIONS = ("Title", "Abstract", "Introduction", "Literature Review", "Methodology", "Results", "Discussion", "Conclusion")


def section_shares(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, section, section_words, matched_words, pct) of the sections found, by the offsets of the matches."""
    s = profile.sections(docs, "doc_id", "text").where(F.col("section").isin(*SCORED_SECTIONS))
    part = F.expr("substring(text, CAST(start_char AS INT) + 1, CAST(greatest(0, end_char - start_char) AS INT))")
    # Sections of a document are few; the text goes to them once, and only their sizes go on.
    sized = docs.select("doc_id", "text").join(s, "doc_id").select("doc_id", "section", F.col("start_char").alias("a"), F.col("end_char").alias("b"), F.greatest(F.lit(1), word_count(part)).alias("section_words"))
    m = matches.where("not is_ignored").select("doc_id", "start_char", word_count(F.col("sentence")).alias("words")).groupBy("doc_id", "start_char").agg(F.sum("words").alias("words"))
    hit = sized.join(m, "doc_id", "left").withColumn("in", F.coalesce((F.col("start_char") >= F.col("a")) & (F.col("start_char") < F.col("b")), F.lit(False)))
    per = hit.groupBy("doc_id", "section", "section_words").agg(F.coalesce(F.sum(F.when(F.col("in"), F.col("words"))), F.lit(0)).cast("long").alias("matched_words"))
    return per.withColumn("pct", F.round(F.least(F.lit(100.0), F.col("matched_words") / F.col("section_words") * 100), 1))
