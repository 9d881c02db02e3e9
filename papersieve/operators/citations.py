"""Citations, quotations and their checks against the bibliography."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papersieve.session import spread

# The citation and quotation patterns.
IEEE = r"\[\s*(\d+(?:\s*[-–,\s]\s*\d+)*)\s*\]"
AUTHOR_YEAR = r"(\b[A-Z][a-zA-Z]+(?:\s+et\s+al\.)?\s*,?\s*\((?:19\d{2}|20\d{2})[a-z]?\)|\(\s*[A-Z][a-zA-Z]+(?:(?:\s+(?:and|&)\s+|\s*,\s*)[A-Z][a-zA-Z]+)?(?:\s+et\s+al\.)?\s*,\s*(?:19\d{2}|20\d{2})[a-z]?\s*(?:,\s*p{1,2}\.?\s*\d+)?\s*\))"
DOI = r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)\b"
URL = r"(https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b(?:[-a-zA-Z0-9()@:%_\+.~#?&//=]*))"
DOUBLE_QUOTES = r'"([^"\n]{10,500})"'
SINGLE_QUOTES = r"'([^'\n]{15,500})'"
KINDS = (("IEEE", IEEE), ("Author-Year", AUTHOR_YEAR), ("DOI", DOI), ("URL", URL))
QUOTES = (("Double", DOUBLE_QUOTES), ("Single", SINGLE_QUOTES))


def extract(col: Column) -> Column:
    """Array of (citation_type, citation_text) in the order IEEE, Author-Year, DOI, URL."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("citation_type"), x.alias("citation_text")))

    return F.concat(*(of(k, p) for k, p in KINDS))


def citations(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, citation_type, citation_text), one row per occurrence; null texts give none."""
    return df.where(F.col(text_col).isNotNull()).select(id_col, F.explode(extract(F.col(text_col))).alias("c")).select(id_col, "c.*")


def expand_numbers(col: Column) -> Column:
    """Numbers of an IEEE citation body: commas split, ranges with a hyphen or dash are filled; descending ranges and
    blank-separated numbers give none, and numbers of more than six digits are no reference numbers."""
    parts = F.filter(F.transform(F.split(col, "[,;]"), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d{1,6}$|^\d{1,6}\s*[-–]\s*\d{1,6}$"))
    low = lambda p: F.regexp_extract(p, r"^(\d+)", 1).cast("int")
    high = lambda p: F.regexp_extract(p, r"(\d+)$", 1).cast("int")
    return F.flatten(F.transform(parts, lambda p: F.when(low(p) <= high(p), F.sequence(low(p), high(p))).otherwise(F.array().cast("array<int>"))))


def cited_numbers(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ref_number): every distinct number that a text cites in brackets."""
    bodies = df.where(F.col(text_col).isNotNull()).select(id_col, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(IEEE), F.lit(1))).alias("body"))
    return bodies.select(id_col, F.explode(expand_numbers(F.col("body"))).alias("ref_number")).distinct()


def missing_references(cited: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, ref_number): cited numbers that the document's bibliography lacks; documents without one are left out."""
    have = refs.select("doc_id").distinct()
    return cited.join(have, "doc_id", "left_semi").join(refs.select("doc_id", "ref_number").distinct(), ["doc_id", "ref_number"], "left_anti")


def unused_references(cited: DataFrame, refs: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, ref_number): references neither cited by number nor by an author word (over 3 letters) in the text."""
    open_refs = refs.join(cited, ["doc_id", "ref_number"], "left_anti")
    first = F.regexp_replace(F.lower(F.element_at(F.split(F.trim("authors"), r"\s+"), 1)), "[.,;]+$", "")
    named = open_refs.withColumn("word", first).join(docs.select("doc_id", F.lower("text").alias("lower_text")), "doc_id", "left")
    used = (F.length("word") > 3) & F.coalesce(F.expr("contains(lower_text, word)"), F.lit(False))
    return named.where(~F.coalesce(used, F.lit(False))).select("doc_id", "ref_number").distinct()


def author_year_parts(cit: DataFrame) -> DataFrame:
    """Author token (lower case, first word) and year of Author-Year citations."""
    t = F.regexp_replace("citation_text", r"^\(\s*", "")
    return cit.where("citation_type = 'Author-Year'").withColumn("author", F.lower(F.regexp_extract(t, r"^([A-Za-z]+)", 1))).withColumn("year", F.regexp_extract("citation_text", r"(19\d{2}|20\d{2})", 1).cast("int"))


def author_year_mismatch(cit: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, author, year): author-year citations for which no reference of the document has the author's word and a
    year at most one apart (or none)."""
    c = author_year_parts(cit).select("doc_id", "author", "year").distinct()
    r = refs.select("doc_id", F.lower("authors").alias("ref_authors"), F.col("year").alias("ref_year"))
    near = F.col("ref_year").isNull() | (F.abs(F.col("year") - F.col("ref_year")) <= 1)
    hit = c.join(r, "doc_id").where(F.expr("contains(ref_authors, author)") & near).select("doc_id", "author", "year").distinct()
    return c.join(r.select("doc_id").distinct(), "doc_id", "left_semi").join(hit, ["doc_id", "author", "year"], "left_anti")


def find_spans(text: str | None) -> list[tuple[str, str, int, int, bool]]:
    """(kind, text, start, end, near a citation) of quotations, and citations with False, in code points."""
    if not text:
        return []
    cites = [(k, m.group(0), m.start(), m.end()) for k, p in KINDS for m in re.finditer(p, text)]
    out = [(k, t, a, b, False) for k, t, a, b in cites]
    for kind, p in QUOTES:
        for m in re.finditer(p, text):
            near = any(abs(a - m.end()) < 100 or abs(b - m.start()) < 40 for _, _, a, b in cites)
            out.append((f"{kind} quote", m.group(1), m.start(), m.end(), near))
    return out


def spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, span_text, start_char, end_char, has_adjacent_citation) with code point offsets."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *s) for i, t in zip(pdf[id_col], pdf[text_col]) for s in find_spans(t)]
            yield pd.DataFrame(rows, columns=[id_col, "kind", "span_text", "start_char", "end_char", "has_adjacent_citation"])

    return spread(df.where(F.col(text_col).isNotNull()).select(id_col, text_col), id_col).mapInPandas(run, f"{id_col} {id_type}, kind string, span_text string, start_char int, end_char int, has_adjacent_citation boolean")


def annotate(sentences: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """Adds is_quoted and is_cited to sentences (id, start_char, end_char): overlap with a quotation; a citation inside,
    near the end, or up to 50 characters behind and before the next sentence; or an adjacent citation of the first
    overlapping quotation, double quotes before single ones. Spans are one array per document, so no interval join is
    needed."""
    per = found.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct((F.col("kind") == "Single quote").alias("single"), "start_char", "end_char", "kind", "has_adjacent_citation"))).alias("spans"))
    nxt = F.lead("start_char").over(W.partitionBy(id_col).orderBy("start_char"))
    s = sentences.withColumn("next_start", F.coalesce(nxt, F.lit(2**31 - 1))).join(per, id_col, "left")
    quotes = F.filter("spans", lambda x: x.kind.endswith("quote") & (x.end_char > F.col("start_char")) & (x.start_char < F.col("end_char")))
    cite = F.exists(
        "spans",
        lambda c: (~c.kind.endswith("quote"))
        & (
            c.start_char.between(F.col("start_char"), F.col("end_char"))
            | c.end_char.between(F.col("start_char"), F.col("end_char"))
            | ((c.start_char >= F.col("end_char")) & (c.start_char <= F.col("next_start")) & (c.start_char - F.col("end_char") <= 50))
            | (F.abs(c.start_char - F.col("end_char")) <= 40)
        ),
    )
    first = F.try_element_at(quotes, F.lit(1))
    cited = F.coalesce(cite, F.lit(False)) | F.coalesce(first["has_adjacent_citation"], F.lit(False))
    return s.withColumn("is_quoted", F.coalesce(F.size(quotes) > 0, F.lit(False))).withColumn("is_cited", cited).drop("spans", "next_start")
