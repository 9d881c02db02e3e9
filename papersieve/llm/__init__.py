"""Training-data operators. Nothing outside this subpackage imports it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Imported here, so a missing library shows when the subpackage is imported and not when its queries are asked for.
from papersieve.llm import langid, lookalikes, mixing, names, oracles, packing, personal, scans, sentences, verbatim, works


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries of the ten problems, over the whole tables with production parameters."""
    found = (
        works.p1_found, works.p1_matches, verbatim.p2_found, verbatim.p2_shared_part, verbatim.p2_classes, names.p3_found, names.p3_entities, langid.p4_found, langid.p4_segments,
        scans.p5_found, scans.p5_paragraphs, lookalikes.p6_found, lookalikes.p6_canonical_units, lookalikes.p6_classes, sentences.p7_found, sentences.p7_unit_sentences,
        packing.p8_assignment, packing.p8_fill, mixing.p9_mix, mixing.p9_shares, personal.p10_found, personal.p10_surrogates, personal.p10_placeholders, personal.p10_surrogate_texts,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
