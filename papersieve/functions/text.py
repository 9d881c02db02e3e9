"""Column functions of the text pipeline: normalisation, cleaning, tokens, keys, escapes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The class of characters that cleaning keeps (letters, numbers, underscore, blanks, Devanagari).
NOT_KEPT = r"[^\p{L}\p{N}_\s\x{0900}-\x{097F}]"
# A sentence is a run without terminators up to its terminators, or the last run of the text.
SENTENCE = r"([^\n.?!।॥]+[.?!।॥]+\s*|[^\n.?!।॥]+$)"
# Abbreviations after which buffering goes on.
ABBREVIATIONS = "al. e.g. i.e. dr. prof. fig. figs. eq. eqs. vol. no. pp. p. vs. ca. etc. cf. ref. refs.".split()


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; plain ASCII passes through untouched."""
    return s.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def normalize_text(col: Column, compose: bool = True) -> Column:
    """NFKC, straight quotes and hyphens, no control characters, single blanks; line breaks stay. Null becomes ''."""
    t = nfkc(col) if compose else col
    t = F.regexp_replace(t, "[“”„‟″‶«»]", '"')
    t = F.regexp_replace(t, "[‘’‚‛′‵`]", "'")
    t = F.regexp_replace(t, "[—–−―]", "-")
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.coalesce(strip(F.regexp_replace(t, r"[ \t\r\f\x0B]+", " ")), F.lit(""))


def clean_for_analysis(col: Column, compose: bool = True) -> Column:
    """The form in which sentences are compared: normalised, lower case, words and blanks only."""
    t = F.regexp_replace(F.lower(normalize_text(col, compose)), NOT_KEPT, " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def tokens(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def word_count(col: Column) -> Column:
    return F.when(strip(col) == "", 0).otherwise(F.size(F.split(strip(col), r"\s+")))


def title_key(col: Column) -> Column:
    """Letters and digits of a title, lower case."""
    return F.regexp_replace(F.lower(col), "[^a-z0-9]", "")


def html_escape(col: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def sanitize_filename(col: Column, default: str = "document") -> Column:
    base = F.element_at(F.split(col, r"[/\\]"), -1)
    safe = F.regexp_replace(F.regexp_replace(base, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[ .]+|[ .]+$", "")
    return F.when(safe == "", default).otherwise(safe)


def stem_title(col: Column) -> Column:
    return F.initcap(F.replace(F.regexp_replace(col, r"\.[^.]*$", ""), F.lit("_"), F.lit(" ")))


def url_domain(col: Column, default: str = "Local Library") -> Column:
    return F.coalesce(F.nullif(F.try_element_at(F.split(col, "/"), F.lit(3)), F.lit("")), F.lit(default))


def truncate(col: Column, most: int, keep: int) -> Column:
    return F.when(F.length(col) > most, F.concat(F.left(col, F.lit(keep)), F.lit("..."))).otherwise(col)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors in percent, within [0, 100]; a zero vector gives 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), dot / size * 100)))
