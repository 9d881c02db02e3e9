"""Citation audit: the citations of a body against the document's bibliography.

A body is the text before the first bibliography heading. Every citing place that has no reference is an issue row, as is
every reference that nothing cites. Defined results: null texts cite nothing; documents without references have no issues
of missing or mismatched ones; references without a number or with number 0 are never unused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve.operators import citations, profile

KINDS = ("Missing Reference", "Citation Mismatch", "Unused Reference")


def bodies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, ref_start, body): the start of the bibliography section, -1 without one, and the text before it."""
    start = profile.sections(docs, id_col, text_col).where("section = 'References'").select(id_col, F.col("start_char").cast("int").alias("ref_start"))
    t = docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).join(start, id_col, "left").na.fill(-1, ["ref_start"])
    return t.withColumn("body", F.when(F.col("ref_start") > 0, F.left(text_col, F.col("ref_start"))).otherwise(F.col(text_col)))


def first_word(col: Column) -> Column:
    """The first word of the first entry of an author list, lower case."""
    return F.lower(F.regexp_extract(F.split_part(col, F.lit(","), F.lit(1)), r"(\S+)", 1))


def cited_places(body: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ref_number): one row for every place that cites a number."""
    bodies_ = body.select(id_col, F.explode(F.regexp_extract_all("body", F.lit(citations.IEEE), F.lit(1))).alias("b"))
    return bodies_.select(id_col, F.explode(citations.expand_numbers(F.col("b"))).alias("ref_number"))


def named_places(body: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, citation_text, author, cited_year): one row for every author-year citation."""
    c = body.select(id_col, F.explode(F.regexp_extract_all("body", F.lit(citations.AUTHOR_YEAR), F.lit(1))).alias("citation_text"))
    word = F.lower(F.regexp_extract("citation_text", r"([A-Za-z]+)", 1))
    return c.select(id_col, "citation_text", word.alias("author"), F.regexp_extract("citation_text", r"(19\d{2}|20\d{2})", 1).cast("int").alias("cited_year"))


def named_matches(named: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, author, cited_year, ref_number): the first reference, by its place, whose first author word holds the cited
    one or the other way round, with a year at most one apart or none. Citations and references meet by document; equal
    author words of a document are one row, so a long bibliography is compared with its distinct citations only."""
    c = named.select("doc_id", "author", "cited_year").distinct()
    r = refs.select("doc_id", first_word(F.col("authors")).alias("word"), F.col("year").alias("ref_year"), "ref_number", "ref_id").where("word <> ''")
    r = r.groupBy("doc_id", "word", "ref_year").agg(F.min(F.struct("ref_id", "ref_number")).alias("at"))
    both = (F.expr("contains(word, author)") | F.expr("contains(author, word)")) & (F.col("ref_year").isNull() | (F.abs(F.col("cited_year") - F.col("ref_year")) <= 1))
    return c.join(r, "doc_id").where(both).groupBy("doc_id", "author", "cited_year").agg(F.min("at").alias("at")).select("doc_id", "author", "cited_year", "at.ref_number")


def issues(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, issue_type, citation_text, ref_number) of all documents; refs (doc_id, ref_id, ref_number, authors, year,
    title) may hold repeated rows."""
    one = refs.groupBy("ref_id").agg(*(F.min(c).alias(c) for c in ("doc_id", "ref_number", "authors", "year", "title")))
    body = bodies(docs)
    numbers, named = cited_places(body), named_places(body)
    have = one.select("doc_id").distinct()
    known = one.where("ref_number is not null").select("doc_id", "ref_number").distinct()
    missing = numbers.join(known.select("doc_id").distinct(), "doc_id", "left_semi").join(known, ["doc_id", "ref_number"], "left_anti")
    hit = named_matches(named, one)
    wrong = named.join(have, "doc_id", "left_semi").join(hit, ["doc_id", "author", "cited_year"], "left_anti")
    cited = numbers.select("doc_id", "ref_number").unionByName(hit.select("doc_id", "ref_number")).where("ref_number is not null").distinct()
    idle = one.where("ref_number <> 0").join(cited, ["doc_id", "ref_number"], "left_anti").withColumn("word", first_word(F.col("authors")))
    # The author words of a document's idle references are looked up in one pass over its text.
    words = idle.where(F.length("word") > 3).groupBy("doc_id").agg(F.collect_set("word").alias("words"))
    said = words.join(docs.select("doc_id", F.lower("text").alias("t")), "doc_id").select("doc_id", F.explode(F.filter("words", lambda w: F.contains(F.col("t"), w))).alias("word"))
    unused = idle.join(said, ["doc_id", "word"], "left_anti")
    return (
        missing.select("doc_id", F.lit(KINDS[0]).alias("issue_type"), F.format_string("[%d]", "ref_number").alias("citation_text"), "ref_number")
        .unionByName(wrong.select("doc_id", F.lit(KINDS[1]).alias("issue_type"), "citation_text", F.lit(None).cast("int").alias("ref_number")))
        .unionByName(unused.select("doc_id", F.lit(KINDS[2]).alias("issue_type"), F.concat(F.lit("Ref #"), F.col("ref_number").cast("string"), F.lit(": "), F.left(F.coalesce("title", F.lit("")), F.lit(45)), F.lit("...")).alias("citation_text"), "ref_number"))
    )


def issue_counts(found: DataFrame) -> DataFrame:
    """(doc_id, missing, mismatched, unused, issues)."""
    n = lambda kind: F.count_if(F.col("issue_type") == kind)
    return found.groupBy("doc_id").agg(n(KINDS[0]).alias("missing"), n(KINDS[1]).alias("mismatched"), n(KINDS[2]).alias("unused"), F.count("*").alias("issues"))


def reference_estimate(body: DataFrame) -> DataFrame:
    """(doc_id, numbered, lines, estimate) of the bibliography sections: numbered beginnings, lines over 20 characters, and
    the larger of both."""
    rest = body.where("ref_start > 0").select("doc_id", F.expr("substring(text, ref_start + 1)").alias("t"))
    numbered = F.size(F.regexp_extract_all("t", F.lit(r"(?m)(^\s*\[\d+\]|^\s*\d+\.\s+)"), F.lit(1)))
    lines = F.size(F.filter(F.split("t", "\n"), lambda x: F.length(F.trim(x)) > 20))
    return rest.select("doc_id", numbered.alias("numbered"), lines.alias("lines"), F.greatest(numbered, lines).alias("estimate"))
