"""Functions that SQL can call: similarities, composition, segmentation, citation spans, bibliographies."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from papersieve.functions import similarity
from papersieve.functions.text import nfkc
from papersieve.operators.citations import find_spans
from papersieve.operators.references import entries, section_start
from papersieve.operators.segment import split_with_offsets
from papersieve.session import ship


@udtf(returnType="sent_idx int, start_char int, end_char int, sentence string")
class SplitSentences:
    """Sentences of one text; null gives none."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from split_with_offsets(text)


@udtf(returnType="kind string, span_text string, start_char int, end_char int, has_adjacent_citation boolean")
class FindSpans:
    """Citations and quotations of one text; null gives none."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from find_spans(text)


@udtf(returnType="ref_number int, raw_text string")
class SplitReferences:
    """Entries of the bibliography of one text; a text without one gives none."""

    def eval(self, text: str) -> Iterator[tuple]:
        at = section_start(text)
        if at >= 0:
            yield from entries(text[at:])


def register(spark: SparkSession) -> None:
    """Make token_set_ratio, partial_ratio, nfkc, split_sentences, find_spans and split_references callable from SQL."""
    ship(spark)
    for name, f in (("token_set_ratio", similarity.token_set_udf), ("partial_ratio", similarity.partial_udf), ("nfkc", nfkc)):
        spark.udf.register(name, f)
    for name, t in (("split_sentences", SplitSentences), ("find_spans", FindSpans), ("split_references", SplitReferences)):
        spark.udtf.register(name, t)
