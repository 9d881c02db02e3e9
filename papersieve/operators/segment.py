"""Sentence segmentation of the comparison pipeline, with and without offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersieve.functions.text import ABBREVIATIONS, clean_for_analysis, strip, tokens
from papersieve.session import ensure_parallel, spread

MIN_WORDS = 4
LINEAR = r"([^\n.?!।॥]++(?:[.?!।॥]++\s*+|\n|$))"
_CHUNK = re.compile(r"[^\n.?!।॥]+(?:[.?!।॥]+\s*|$)")
_BREAKS = re.compile(r"[^\w\sऀ-ॿ]")


def fast_sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sent_idx, sentence) by one regular expression inside the JVM; no abbreviation merging, no offsets.

    Text after the last terminator of a line is dropped unless it ends the text. Null and blank texts give no rows.
    """
    src = ensure_parallel(df.where(F.col(text_col).isNotNull()).select(id_col, text_col), id_col)
    # The same pieces as SENTENCE in linear time: an unfinished line is taken with its break, then left out.
    pieces = F.regexp_extract_all(strip(F.col(text_col)), F.lit(LINEAR), F.lit(1))
    t = src.select(id_col, F.filter(pieces, lambda x: x.rlike("[.?!।॥]") | ~x.endswith("\n")).alias("s"))
    e = t.select(id_col, F.posexplode("s").alias("sent_idx", "sentence"))
    return e.select(id_col, "sent_idx", strip(F.col("sentence")).alias("sentence")).where("sentence <> ''")


def compared_sentences(df: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, compose: bool = False) -> DataFrame:
    """Sentences with their cleaned form, of at least min_words words: (id, sent_idx, sentence, clean)."""
    s = fast_sentences(df, id_col, text_col).withColumn("clean", clean_for_analysis(F.col("sentence"), compose))
    return s.where(F.size(tokens(F.col("clean"))) >= min_words)


def split_with_offsets(text: str | None, min_words: int = MIN_WORDS, base: int = 0) -> list[tuple[int, int, int, str]]:
    """(index, start, end, sentence) with abbreviation buffering; the end includes trailing blanks."""
    out, parts, start = [], [], None
    for m in _CHUNK.finditer(text or ""):
        chunk = m.group()
        if not chunk.strip():
            continue
        start = m.start() if start is None else start
        parts.append(chunk)
        whole = "".join(parts)
        words = whole.split()
        if words and words[-1].lower() in ABBREVIATIONS and not whole.endswith("\n"):
            continue
        n = len(_BREAKS.sub(" ", whole).split())
        if n >= min_words or len(whole.strip()) >= 15:
            out.append((len(out), base + start, base + start + len(whole), whole.strip()))
        parts, start = [], None
    if parts and "".join(parts).strip() and _BREAKS.sub(" ", "".join(parts)).split():
        whole = "".join(parts)
        out.append((len(out), base + start, base + start + len(whole), whole.strip()))
    return out


def sentences_with_offsets(df: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, sent_idx, start_char, end_char, sentence)."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *r) for i, t in zip(pdf[id_col], pdf[text_col]) for r in split_with_offsets(t, min_words)]
            yield pd.DataFrame(rows, columns=[id_col, "sent_idx", "start_char", "end_char", "sentence"])

    return spread(df.select(id_col, text_col).where(F.col(text_col).isNotNull()), id_col).mapInPandas(run, f"{id_col} {id_type}, sent_idx int, start_char int, end_char int, sentence string")
