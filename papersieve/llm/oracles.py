"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

# Letters with a Latin twin.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ"
CYRILLIC_AS = "ABESIJKMHOPCTYXaesijopcyxhdqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοϳ"
GREEK_AS = "ABEZHIKMNOPTYXvoj"

_P2 = """
WITH recs AS (
  SELECT DISTINCT 'S' || source_id AS rec, text_content AS t FROM sources WHERE length(text_content) >= 200
  UNION SELECT DISTINCT 'X' || ext_id, full_text FROM extracted_docs WHERE length(full_text) >= 200),
w AS (SELECT DISTINCT rec, md5(substr(t, i, 200)) AS s FROM (SELECT rec, t, unnest(range(1, length(t) - 198)) AS i FROM recs))
"""

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_HIDDEN = "".join(map(chr, (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)))
_BLANKS = "".join(map(chr, (0xA0, 0x2002, 0x2003, 0x2009, 0x202F, 0x3000, 0x2000, 0x2001, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x200A, 10, 13, 9)))


def _form(col: str) -> str:
    t = f"translate({col}, '{_HIDDEN}', '')"
    t = f"nfc_normalize(replace(replace({t}, 'ﬁ', 'fi'), 'ﬂ', 'fl'))"
    t = f"translate({t}, '{_WIDE}', '{_NARROW}')"
    t = f"translate({t}, '{CYRILLIC}{GREEK}‐‑', '{CYRILLIC_AS}{GREEK_AS}--')"
    t = f"nfc_normalize(translate({t}, '{_BLANKS}', '{' ' * len(_BLANKS)}'))"
    return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"


_P6 = f"""
WITH u AS (SELECT DISTINCT unit_id, normalized_text AS raw, {_form("normalized_text")} AS form FROM sentence_units WHERE normalized_text IS NOT NULL AND normalized_text <> ''),
s AS (SELECT DISTINCT source_id, text_content AS raw, {_form("text_content")} AS form FROM sources WHERE text_content IS NOT NULL)
SELECT DISTINCT rec_a, rec_b FROM (
  SELECT 'U' || a.unit_id AS rec_a, 'U' || b.unit_id AS rec_b FROM u a JOIN u b ON a.form = b.form AND a.raw <> b.raw AND 'U' || a.unit_id < 'U' || b.unit_id
  UNION ALL
  SELECT 'S' || s.source_id, 'U' || u.unit_id FROM u JOIN s ON contains(s.form, u.form) AND NOT contains(s.raw, u.raw))
"""

ORACLES = {
    "p2_found": _P2 + "SELECT DISTINCT a.rec AS rec_a, b.rec AS rec_b FROM w a JOIN w b ON a.s = b.s AND a.rec < b.rec",
    "p6_found": _P6,
}
