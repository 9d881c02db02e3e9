"""File sources: dispatch by suffix, text with encoding fallback, DOCX, validation; bytes come from Spark's binary reader."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("pdf", "docx", "doc", "txt", "rtf", "md")
WORDS_PER_PAGE = 400
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan(spark: SparkSession, folder: str, max_mb: float = 50.0) -> DataFrame:
    """(path, filename, suffix, size, file_hash, content) of the supported files under a folder that are not too large."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return raw.where((F.col("length") <= int(max_mb * 1024 * 1024)) & suffix.isin(*SUFFIXES)).select("path", name.alias("filename"), suffix.alias("suffix"), F.col("length").alias("size"), F.sha2("content", 256).alias("file_hash"), "content")


def decode(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1; a byte order mark is dropped."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def docx_text(data: bytes) -> str:
    """Paragraphs, then tables with cells joined by ' | '."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    line = lambda p: "".join(t.text or "" for t in p.iter(f"{_W}t"))
    paras = [line(p) for p in body.findall(f"{_W}p")]
    rows = [" | ".join(" ".join(line(p) for p in c.findall(f"{_W}p")).strip() for c in r.findall(f"{_W}tc")) for t in body.findall(f"{_W}tbl") for r in t.findall(f"{_W}tr")]
    return "\n\n".join(x for x in [*paras, "\n".join(rows)] if x.strip())


def extract(files: DataFrame) -> DataFrame:
    """(path, filename, file_hash, full_text, word_count, page_count, error) of text and DOCX files.

    Files that can't be read keep their row with an error and a null text; PDF needs a parser that is not part of this
    package and gives the error 'no parser'.
    """
    plain = files.where(F.col("suffix").isin("txt", "md", "rtf")).select("path", "filename", "file_hash", F.trim(decode(F.col("content"))).alias("full_text"), F.lit(None).cast("string").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, n, h, s, c in zip(pdf["path"], pdf["filename"], pdf["file_hash"], pdf["suffix"], pdf["content"]):
                try:
                    rows.append((p, n, h, docx_text(bytes(c)), None) if s == "docx" else (p, n, h, None, "no parser"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError) as e:
                    rows.append((p, n, h, None, f"{type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["path", "filename", "file_hash", "full_text", "error"])

    other = files.where(~F.col("suffix").isin("txt", "md", "rtf")).mapInPandas(run, "path string, filename string, file_hash string, full_text string, error string")
    words = F.when(F.trim(F.coalesce("full_text", F.lit(""))) == "", 0).otherwise(F.size(F.split(F.trim("full_text"), r"\s+")))
    return plain.unionByName(other).withColumn("word_count", words).withColumn("page_count", F.greatest(F.lit(1), F.ceil(words / WORDS_PER_PAGE)).cast("int"))


CAPTION = re.compile(r"(?i)^(?:figure|fig\.?|table|chart)\s*\d+\s*[:.]")
