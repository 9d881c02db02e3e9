"""One consistent form for text that looks the same but differs in its characters.

The canonical form composes accents, replaces wide and compatibility letters, drops invisible characters, makes every
run of blanks one blank, unifies hyphens and maps look-alike letters of other scripts to Latin. Text without a character
that the normalization quick-check properties (or the other rules) name is stable and left as it is: only unstable
segments, widened to the blanks around them, are normalised, and the canonical pieces are spliced into the unchanged text.

Letter case, digits, visible accents and word order stay. A Cyrillic or Greek letter is mapped only where it has a Latin
twin and its word holds no letter of its script without one, so real Russian or Greek words keep their letters.

Defined results: null stays null, empty stays empty; the form is idempotent.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.llm.winnow import code_points, kgram_hashes, window_minima
from papersieve.session import cut, read_table, spread

# Letters with a Latin twin, in the order of their scripts.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ"
CYRILLIC_AS = "ABESIJKMHOPCTYXaesijopcyxhdqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοϳ"
GREEK_AS = "ABEZHIKMNOPTYXvoj"
ARMENIAN = "Օոսհցզօ"
ARMENIAN_AS = "Onuhgqo"
HYPHENS = "‐‑﹣－"
SCRIPT_G = "ɡ"
TWINS = {ord(a): b for a, b in zip(CYRILLIC + GREEK + ARMENIAN, CYRILLIC_AS + GREEK_AS + ARMENIAN_AS)}
# Compatibility forms that look the same as their plain form; raised, circled and squared ones do not.
_SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")

_BLANKS = regex.compile(r"[\s\p{Z}]+")
_INVISIBLE = regex.compile(r"[\p{Cf}͏ᅟᅠㅤ⠀︀-️]")
_SCRIPTS = r"\p{Cyrillic}\p{Greek}\p{Armenian}"
_FOREIGN_WORD = regex.compile(rf"[\p{{Latin}}{_SCRIPTS}\p{{M}}]*[{_SCRIPTS}][\p{{Latin}}{_SCRIPTS}\p{{M}}]*")
_OWN = regex.compile(f"[{_SCRIPTS}]")


def _plain(ch: str) -> str:
    d = unicodedata.decomposition(ch)
    return unicodedata.normalize("NFKC", ch) if d.startswith(_SAME_LOOK) else ch


def _twins(m: regex.Match) -> str:
    word = m.group()
    if all(ord(c) in TWINS for c in _OWN.findall(word)):
        return word.translate(TWINS)
    return word


def canonical_full(text: str) -> str:
    """The canonical form by normalising everything: the definition that the segment-wise form must equal."""
    if not text:
        return text
    t = "".join(map(_plain, text))
    t = _INVISIBLE.sub("", t)
    t = unicodedata.normalize("NFC", t)
    t = t.translate(_SINGLE)
    t = _FOREIGN_WORD.sub(_twins, t)
    t = unicodedata.normalize("NFC", t)
    return _BLANKS.sub(" ", t).strip(" ")


_SINGLE = {ord(c): "-" for c in HYPHENS} | {ord(SCRIPT_G): "g"}
# What may change: characters that the quick checks of the composed forms don't pass, invisible ones, and look-alikes.
_UNSTABLE = r"\p{NFC_QC=N}\p{NFC_QC=M}\p{NFKC_QC=N}\p{Cf}͏ᅟᅠㅤ⠀︀-️" + _SCRIPTS + HYPHENS + SCRIPT_G
# A segment is a word with such a character: nothing in the definition looks across a blank between visible characters.
# A blank that is one of them (U+00A0) belongs to no word.
_SEGMENT = regex.compile(rf"(?<![^\s\p{{Z}}])[^\s\p{{Z}}{_UNSTABLE}]*+(?![\s\p{{Z}}])[{_UNSTABLE}][^\s\p{{Z}}]*")
_ODD_BLANK = regex.compile(r"[\s\p{Z}]{2}|(?! )[\s\p{Z}]")


def canonical(text: str | None) -> str | None:
    """The canonical form, normalising unstable segments only."""
    if not text:
        return text
    if not text.isascii():
        text = _SEGMENT.sub(lambda m: canonical_full(m.group()), text)
    # A word of invisible characters leaves two blanks side by side, so the splice closes them.
    return (_BLANKS.sub(" ", text) if _ODD_BLANK.search(text) else text).strip(" ")


def with_canonical(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """The frame with the canonical form of a column added; other columns pass through."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(canonical, na_action="ignore")

    return df.withColumn(out_col, form(F.col(text_col)))


K, W = 20, 20


def _units(spark: SparkSession, data_dir: str) -> DataFrame:
    u = read_table(spark, data_dir, "sentence_units").select("unit_id", F.col("normalized_text").alias("raw")).where("raw is not null and unit_id is not null")
    return with_canonical(spread(u, "unit_id").distinct(), "raw", "form").where("form <> ''")


def _sources(spark: SparkSession, data_dir: str) -> DataFrame:
    s = read_table(spark, data_dir, "sources").select("source_id", F.col("text_content").alias("raw")).where("raw is not null and source_id is not null")
    return with_canonical(spread(s, "source_id").distinct(), "raw", "form").where("form <> ''")


def _kept(df: DataFrame, key: str) -> DataFrame:
    """A table of raw texts and their forms, in which a text that is its own form is kept once."""
    t = cut(df.select(key, "raw", F.when(F.col("form") != F.col("raw"), F.col("form")).alias("changed")))
    return t.select(key, "raw", F.coalesce("changed", "raw").alias("form"))


def _identity(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def same_look_units(units: DataFrame) -> DataFrame:
    """(rec_a, rec_b): units with one canonical form and different characters. Units of one spelling are a class."""
    v = units.select(_identity("form").alias("f"), _identity("raw").alias("r"), F.concat(F.lit("U"), F.col("unit_id").cast("string")).alias("rec"))
    many = v.groupBy("f").agg(F.count_distinct("r").alias("n")).where("n > 1").select("f")
    m = v.join(many, "f", "left_semi")
    a, b = m.alias("a"), m.alias("b")
    return a.join(b, "f").where("a.rec < b.rec and a.r <> b.r").select(F.col("a.rec").alias("rec_a"), F.col("b.rec").alias("rec_b")).distinct()


def look_classes(units: DataFrame) -> DataFrame:
    """(cls, rec, spelling, n_units, n_spellings): every unit with the class of its look, named by its smallest unit, the
    number of its spelling in the class, and their sizes; the members are not expanded into pairs."""
    v = units.select(_identity("form").alias("f"), _identity("raw").alias("r"), F.concat(F.lit("U"), F.col("unit_id").cast("string")).alias("rec"))
    per = v.groupBy("f", "r").agg(F.min("rec").alias("first"))
    size = v.groupBy("f").agg(F.min("rec").alias("cls"), F.count_distinct("rec").alias("n_units"), F.count_distinct("r").alias("n_spellings")).where("n_spellings > 1")
    return v.join(size, "f").join(per, ["f", "r"]).select("cls", "rec", F.col("first").alias("spelling"), "n_units", "n_spellings").distinct()


def batch_minima(texts: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, hash): the distinct winnowed anchors of texts of k + w - 1 characters or more, all at once."""
    long = np.array([i for i, t in enumerate(texts) if len(t) >= k + w - 1], np.int64)
    if not len(long):
        return long, np.empty(0, np.uint64)
    points = code_points("".join(texts[i] for i in long))
    sizes = np.array([len(texts[i]) for i in long])
    mins = window_minima(kgram_hashes(points, k), w)
    # Windows that lie within one text; those over a border are left out.
    count = sizes - (k + w - 2)
    owner = np.repeat(np.arange(len(long)), count)
    at = np.repeat(np.cumsum(sizes) - sizes, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    h = mins[at]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    pairs = np.unique(np.rec.fromarrays([owner[new], h[new]], names="o,h"))
    return long[pairs["o"]], pairs["h"]


def _anchored(rows: DataFrame, key: str, lengths: list[int], whole: bool) -> DataFrame:
    """(key, g, h): the winnowed anchors (g = 0) of texts (key, form). For texts shorter than a window: their own gram if
    they are units (whole), or all grams of the lengths that such units have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 512):
                texts, ids = pdf["form"].iloc[start : start + 512].tolist(), pdf[key].iloc[start : start + 512].to_numpy()
                at, h = batch_minima(texts, K, W)
                yield pd.DataFrame({key: ids[at], "g": np.zeros(len(h), np.int32), "h": h.view(np.int64)})
                for i, t in enumerate(texts):
                    for g in [len(t)] if whole and len(t) < K + W - 1 else [] if whole else lengths:
                        grams = np.unique(kgram_hashes(code_points(t), g))
                        yield pd.DataFrame({key: np.full(len(grams), ids[i], np.int64), "g": np.full(len(grams), g, np.int32), "h": grams.view(np.int64)})

    return rows.select(key, "form").mapInPandas(run, f"{key} long, g int, h long")


def shown_in_sources(units: DataFrame, sources: DataFrame) -> DataFrame:
    """(rec_a, rec_b): a source shows a unit's text, but does not hold it in the same characters.

    Each distinct form goes to the sources by its rarest anchor only; the containment itself is then checked on the
    whole forms and the raw texts. Only anchors that a unit has are sent on from the sources.
    """
    keyed = units.withColumn("id", _identity("form"))
    forms = cut(keyed.groupBy("id").agg(F.min("form").alias("form"), F.collect_set("raw").alias("raws")).withColumn("f", F.monotonically_increasing_id()))
    lengths = sorted(r[0] for r in forms.where(F.length("form") < K + W - 1).select(F.length("form").alias("n")).distinct().collect())  # at most K + W - 2 numbers
    wanted = cut(_anchored(forms, "f", lengths, True))
    grams = cut(_anchored(sources, "source_id", lengths, False).join(wanted.select("g", "h").distinct(), ["g", "h"], "left_semi"))
    counts = grams.groupBy("g", "h").agg(F.count("*").alias("n"))
    rare = wanted.join(counts, ["g", "h"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # An anchor that no source holds (n = 0) proves that no source shows the form.
    best = rare.groupBy("f").agg(F.min(F.struct("n", "g", "h")).alias("k")).where("k.n > 0").select("f", "k.g", "k.h")
    pairs = best.join(grams, ["g", "h"]).select("f", "source_id").distinct()
    both = pairs.join(forms.drop("id"), "f").join(sources.select("source_id", F.col("form").alias("sform"), F.col("raw").alias("sraw")), "source_id").where(F.expr("contains(sform, form)"))
    shown = both.select("f", "source_id", F.explode("raws").alias("raw"), "sraw").where(F.expr("not contains(sraw, raw)")).select("f", "source_id", "raw").distinct()
    hit = keyed.join(forms.select("id", "f"), "id").select("f", "raw", "unit_id").join(shown, ["f", "raw"])
    s, u = F.concat(F.lit("S"), F.col("source_id").cast("string")), F.concat(F.lit("U"), F.col("unit_id").cast("string"))
    return hit.select(s.alias("rec_a"), u.alias("rec_b")).distinct()


def p6_found(spark: SparkSession, data_dir: str) -> DataFrame:
    units, sources = _kept(_units(spark, data_dir), "unit_id"), _kept(_sources(spark, data_dir), "source_id")
    return same_look_units(units).unionByName(shown_in_sources(units, sources)).distinct()


def p6_canonical_units(spark: SparkSession, data_dir: str) -> DataFrame:
    """(unit_id, form, changed): the canonical text of every unit."""
    return _units(spark, data_dir).select("unit_id", "form", (F.col("form") != F.col("raw")).alias("changed")).distinct()


def p6_classes(spark: SparkSession, data_dir: str) -> DataFrame:
    return look_classes(_kept(_units(spark, data_dir), "unit_id"))
