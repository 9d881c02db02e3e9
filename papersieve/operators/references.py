"""Bibliographies: section, entries, fields, duplicates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papersieve.functions.text import strip, title_key
from papersieve.session import spread

# The heading of a bibliography and the number before an entry.
HEADING = r"(?im)^(?:references\s+and\s+bibliography|references|bibliography|works\s+cited|literature\s+cited|sources)\s*$"
NUMBER = r"^(?:\[\s*(\d+)\s*\]|(\d+)\.\s+)"
_NUMBERED = re.compile(r"^\s*(?:\[\d+\]|\d+\.\s)", re.MULTILINE)
_NUMBER = re.compile(NUMBER)
_OPENING = re.compile(r"[A-Z][a-zA-Z\s.,\-&]{2,30}\s*\(?(?:19|20)\d{2}")


def section_start(text: str | None) -> int:
    """Offset behind the first heading line of a bibliography, -1 if there is none."""
    m = re.search(HEADING, text or "")
    return m.end() if m else -1


def entries(section: str | None, least: int = 15) -> list[tuple[int, str]]:
    """(number, entry) of a bibliography: a number prefix, a blank line or (unnumbered) an author-year opening after a
    finished line begins a new entry; entries shorter than least are dropped but keep their place in the count."""
    found: list[str] = []
    now: list[str] = []
    numbered = bool(_NUMBERED.search(section or ""))
    for raw in [*(section or "").splitlines(), ""]:
        line = raw.strip()
        opens = bool(_NUMBER.match(line)) if numbered else bool(now and now[-1][-1] in '."' and _OPENING.match(line))
        if now and (not line or opens):
            found.append(" ".join(now))
            now = []
        if line:
            now.append(line)
    out = []
    for k, e in enumerate(found, 1):
        if len(e) >= least:
            m = _NUMBER.match(e)
            out.append((int(m.group(1) or m.group(2)) if m else k, e))
    return out


def split_bibliographies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ref_number, raw_text) of every text that has a bibliography."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, t in zip(pdf[id_col], pdf[text_col]):
                at = section_start(t)
                if at >= 0:
                    rows += [(i, n, e) for n, e in entries(t[at:])]
            yield pd.DataFrame(rows, columns=[id_col, "ref_number", "raw_text"])

    return spread(df.where(F.col(text_col).isNotNull()).select(id_col, text_col), id_col).mapInPandas(run, f"{id_col} {id_type}, ref_number int, raw_text string")


def _opt(col: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def fields(raw: Column) -> dict[str, Column]:
    """Field columns of an entry: number, DOI, year, volume, issue, pages, title, authors."""
    number = F.coalesce(_opt(raw, NUMBER, 1), _opt(raw, NUMBER, 2)).cast("int")
    work = strip(F.regexp_replace(raw, NUMBER, ""))
    doi = F.regexp_replace(_opt(work, r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)\b"), r"\.+$", "")
    work = F.regexp_replace(work, r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b", "")
    year = _opt(work, r"\b(19\d\d|20\d\d)[a-z]?\b").cast("int")
    apa = r"^(.*?)\s*[\(\[]?\s*(?:19\d\d|20\d\d)[a-z]?\s*[\)\]]?\.?\s+([^.]*)(?:\.|$)"
    quoted = _opt(work, r'["“]([^"”]+)["”]')
    title = F.coalesce(quoted, _opt(strip(F.regexp_extract(work, apa, 2)), r"^(.+)$"), F.left(raw, F.lit(80)))
    authors = F.coalesce(_opt(F.regexp_replace(strip(F.regexp_extract(work, apa, 1)), r"[.,]+$", ""), r"^(.+)$"), F.lit("Unknown Authors"))
    vol = r"(?i)(?:vol(?:ume)?\.?\s*(\d+)|(\d+)\s*\(\s*(\d+)\s*\))"
    pages = r"(?i)(?:pp?\.?\s*(\d+[-–]\d+|\d+)|:\s*(\d+[-–]\d+))"
    return {
        "ref_number": number, "doi": doi, "year": year, "volume": F.coalesce(_opt(work, vol, 1), _opt(work, vol, 2)), "issue": _opt(work, vol, 3),
        "pages": F.coalesce(_opt(work, pages, 1), _opt(work, pages, 2)), "title": title, "authors": authors,
    }


def duplicates(refs: DataFrame) -> DataFrame:
    """(doc_id, ref_id, first_ref_id): references whose normalised title (over 10 letters) came before in the document."""
    k = refs.where(F.length(title_key(F.col("title"))) > 10).withColumn("k", title_key(F.col("title")))
    first = F.min("ref_id").over(W.partitionBy("doc_id", "k"))
    return k.withColumn("first_ref_id", first).where("ref_id > first_ref_id").select("doc_id", "ref_id", "first_ref_id").distinct()
