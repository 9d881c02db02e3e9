"""Projections, filters and stored forms of the register: documents, sources, matches, references, issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papersieve.functions.text import strip, word_count

FILTERS = ("All", "Exact", "Fuzzy", "Semantic", "Quoted")


def highlight_class(algorithm: Column, quoted: Column) -> Column:
    """Quoted prevails over exact, exact over semantic; whatever is left is fuzzy."""
    a = F.lower(algorithm)
    return F.when(quoted, "quoted").when(a.contains("exact"), "exact").when(a.contains("semantic"), "semantic").otherwise("fuzzy")


def highlighted(matches: DataFrame, active: str = "All") -> DataFrame:
    """Matches that a filter shows, without ignored ones."""
    if active not in FILTERS:
        raise ValueError(f"no filter {active}")
    keep = F.lit(True) if active == "All" else F.col("is_quoted") if active == "Quoted" else F.lower("algorithm").contains(active.lower())
    return matches.where(~F.col("is_ignored") & keep)


def clamped(start: Column, end: Column, sentence: Column, size: Column) -> tuple[Column, Column]:
    """A span inside a text of a size; a missing start is 0, a missing end follows from the sentence."""
    s = F.coalesce(start, F.lit(0))
    return F.least(s, size), F.least(F.coalesce(end, s + F.length(sentence)), size)


def at_point(matches: DataFrame, points: DataFrame) -> DataFrame:
    """(doc_id, pos, sent_idx): for every point of a document the first match, by its order, that it lies in."""
    hit = points.join(matches.select("doc_id", "sent_idx", "start_char", "end_char"), "doc_id").where(F.col("pos").between(F.col("start_char"), F.col("end_char")))
    return hit.groupBy("doc_id", "pos").agg(F.min("sent_idx").alias("sent_idx"))


def _or(col: str, default) -> Column:
    return F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(default)).alias(col)


def document_rows(docs: DataFrame) -> DataFrame:
    """Stored documents as the register shows them."""
    return docs.select(
        "doc_id", "filename", F.coalesce(F.date_format("upload_date", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("upload_date"), _or("student_name", "Student"), _or("prn_number", "-"), _or("course_name", "MCA"),
        _or("academic_year", "2025-2026"), _or("guide_name", "-"), F.coalesce(F.nullif("paper_title", F.lit("")), F.col("filename")).alias("paper_title"),
    )


def source_rows(src: DataFrame) -> DataFrame:
    """Stored sources as lists show them, one row per source: the latest delivery."""
    latest = src.groupBy("source_id").agg(F.max_by(F.struct(*[c for c in src.columns if c != "source_id"]), "created_at").alias("s")).select("source_id", "s.*")
    return latest.select("source_id", "title", "author", "publication_year", "publisher", "url", "source_type", "word_count", F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("created_at"))


def reference_rows(refs: DataFrame) -> DataFrame:
    """Stored references with their defaults, one row per reference: the latest load."""
    latest = refs.groupBy("ref_id").agg(F.max_by(F.struct(*[c for c in refs.columns if c != "ref_id"]), F.coalesce("loaded_at", "extracted_at")).alias("r")).select("ref_id", "r.*")
    text = lambda c, d: F.coalesce(F.col(c), F.lit(d)).alias(c)
    return latest.select("ref_id", "document_id", "ref_number", text("raw_text", ""), text("title", ""), text("authors", ""), text("journal", ""), "year", text("volume", ""), text("issue", ""), text("pages", ""), text("doi", ""), F.coalesce(F.nullif("status", F.lit("")), F.lit("NOT VERIFIED")).alias("status"), F.coalesce("is_duplicate", F.lit(False)).alias("is_duplicate"))


def match_rows(matches: DataFrame) -> DataFrame:
    """Stored matches as the report shows them: rounded scores, defaults, shortened text."""
    cut_at = lambda c, n: F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 3)), F.lit("..."))).otherwise(F.col(c))
    return matches.select("doc_id", "sent_idx", F.round("score", 1).alias("score"), F.left("algorithm", F.lit(10)).alias("algorithm"), cut_at("sentence", 130).alias("snippet"), cut_at("source_name", 65).alias("source_name"), F.coalesce("source_type", F.lit("Journal")).alias("source_type"), F.coalesce("reliability", F.lit("High")).alias("reliability"))


def archived_results(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """A stored document with its matches: counts, and shares as counts by words."""
    n = lambda a: F.count_if(F.lower("algorithm").contains(a)).alias(f"{a}_count")
    m = matches.groupBy("doc_id").agg(n("exact"), n("fuzzy"), n("semantic"), F.count_if("is_quoted").alias("quoted_count"))
    kinds = ("exact", "fuzzy", "semantic", "quoted")
    j = docs.select("doc_id", word_count(F.coalesce("text", F.lit(""))).alias("words")).join(m, "doc_id", "left").na.fill(0)
    return j.select("doc_id", "words", *(f"{k}_count" for k in kinds), *(F.round(F.col(f"{k}_count") / F.greatest(F.lit(1), F.col("words")) * 100, 1).alias(f"{k}_pct") for k in kinds))


def paragraph_pages(docs: DataFrame, words_per_page: int = 400) -> DataFrame:
    """(doc_id, paragraph_no, page_number, start_char, words): paragraphs between blank lines, spread evenly over as many
    pages as the words fill; what is left over stands on the last page."""
    t = docs.where("text is not null").select("doc_id", word_count(F.col("text")).alias("all_words"), F.split("text", "\n\n").alias("p"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("all_words") / words_per_page).cast("int"))
    per = F.greatest(F.lit(1), F.floor(F.size("p") / pages).cast("int"))
    e = t.select("doc_id", pages.alias("pages"), per.alias("per"), F.posexplode("p").alias("paragraph_no", "para"))
    before = F.coalesce(F.sum(F.length("para") + 2).over(W.partitionBy("doc_id").orderBy("paragraph_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return e.select("doc_id", "paragraph_no", F.least(F.floor(F.col("paragraph_no") / F.col("per")) + 1, F.col("pages")).cast("int").alias("page_number"), before.cast("long").alias("start_char"), word_count(F.col("para")).alias("words"))


def scanned_files(pages: DataFrame, least_chars: int = 40, share: float = 0.3) -> DataFrame:
    """(file_id, pages, scanned_pages, is_scanned): pages (file_id, chars, images) with little text and an image."""
    poor = (F.col("chars") < least_chars) & (F.col("images") > 0)
    return pages.groupBy("file_id").agg(F.count("*").alias("pages"), F.count_if(poor).alias("scanned_pages")).withColumn("is_scanned", F.col("scanned_pages") / F.col("pages") >= share)


def new_sources(raw: DataFrame) -> DataFrame:
    """Rows to insert as sources: a title is needed, a year counts only if it is digits, the text gives hash and size."""
    text = F.coalesce("text_content", F.lit(""))
    return raw.where(F.coalesce(strip(F.col("title")), F.lit("")) != "").select(
        strip(F.col("title")).alias("title"), "author", F.when(F.col("year").rlike(r"^\d{1,9}$"), F.col("year")).cast("int").alias("publication_year"), "url", "text_content", F.sha2(text, 256).alias("hash"), word_count(text).alias("word_count")
    )


def without_source(sources: DataFrame, matches: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources without the deleted ones, and matches whose source of those becomes null."""
    g = gone.select("source_id").distinct()
    dead = matches.join(g.withColumn("dead", F.lit(True)), "source_id", "left")
    return sources.join(g, "source_id", "left_anti"), dead.withColumn("source_id", F.when(F.col("dead").isNull(), F.col("source_id"))).drop("dead")


def persist(folder: str, documents: DataFrame, matches: DataFrame, references: DataFrame, issues: DataFrame) -> None:
    """Append one analysis to the four tables of a folder; children carry the document's key, documents come last, so a
    document that is there has all its children."""
    for name, df in (("matches", matches), ("references", references), ("citation_issues", issues), ("documents", documents)):
        df.write.mode("append").parquet(f"{folder}/{name}")
