"""Pieces of DuckDB SQL for the equivalents of the core queries."""

from __future__ import annotations

from papersieve.functions.text import SENTENCE
from papersieve.operators.citations import AUTHOR_YEAR, DOI, DOUBLE_QUOTES, IEEE, URL
from papersieve.operators.profile import HINDI, MARATHI, SECTIONS
from papersieve.operators.web import BOILERPLATE, HIGH, PREPRINT


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


NFKC = "nfc_normalize(replace(text, 'ำ', 'ํา'))"


def normal(x: str) -> str:
    t = f"regexp_replace({x}, '[“”„‟″‶«»]', '\"', 'g')"
    t = f"regexp_replace({t}, '[‘’‚‛′‵`]', '''', 'g')"
    t = f"regexp_replace({t}, '[—–−―]', '-', 'g')"
    t = rf"regexp_replace({t}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"
    return strip(rf"regexp_replace({t}, '[ \t\r\f\x0B]+', ' ', 'g')")


def clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({normal(x)}), '[^\p{{L}}\p{{N}}_\s\x{{0900}}-\x{{097F}}]', ' ', 'g'), '\s+', ' ', 'g'))"


def wc(x: str) -> str:
    return rf"CASE WHEN {strip(x)} = '' THEN 0 ELSE len(string_split_regex({strip(x)}, '\s+')) END"


WORDS4 = "clean <> '' AND len(string_split(clean, ' ')) >= 4"


def _sentences(name: str, key: str, col: str, table: str) -> str:
    return f"{name} AS (SELECT {key}, i - 1 AS sent_idx, {strip('t')} AS sentence FROM (SELECT {key}, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS i FROM (SELECT {key}, regexp_extract_all({strip(col)}, {q(SENTENCE)}, 1) AS l FROM {table})) WHERE {strip('t')} <> '')"


DOC_SENTENCES = _sentences("s", "doc_id", "text", "documents WHERE text IS NOT NULL")
DOC_CLEAN = DOC_SENTENCES + f", dc AS (SELECT * FROM (SELECT doc_id, sent_idx, sentence, {clean('sentence')} AS clean FROM s) WHERE {WORDS4})"
SRC_CLEAN = _sentences("ss", "source_id", "text_content", "(SELECT DISTINCT source_id, text_content FROM sources WHERE text_content IS NOT NULL)") + f", sc AS (SELECT * FROM (SELECT source_id, sent_idx, {clean('sentence')} AS clean FROM ss) WHERE {WORDS4})"

_KEY = "regexp_replace(lower(title), '[^a-z0-9]', '', 'g')"
TWINS = f"r AS (SELECT DISTINCT ref_id, raw_text, {_KEY} AS k FROM bib_refs WHERE title IS NOT NULL AND raw_text IS NOT NULL), h AS (SELECT DISTINCT hit_id, title AS hit_title, {_KEY} AS k FROM scholar_hits WHERE title IS NOT NULL), tw AS (SELECT ref_id, hit_id, raw_text, hit_title FROM r JOIN h USING (k) WHERE k <> '')"


def _words(x: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(lower({x}), '\s+'), lambda w: w <> ''))"


_I = f"len(list_intersect({_words('raw_text')}, {_words('hit_title')}))"
JACCARD = f"CASE WHEN len({_words('raw_text')}) + len({_words('hit_title')}) - {_I} = 0 THEN 0 ELSE 100.0 * {_I} / (len({_words('raw_text')}) + len({_words('hit_title')}) - {_I}) END"

_G = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def _grams(x: str) -> str:
    w = _G.format(x=x)
    return f"list_concat({w}, list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"


TFIDF = f"""WITH {TWINS}, ga AS (SELECT ref_id, hit_id, g, count(*) AS f FROM (SELECT ref_id, hit_id, unnest({_grams('raw_text')}) AS g FROM tw) GROUP BY ALL),
gb AS (SELECT ref_id, hit_id, g, count(*) AS f FROM (SELECT ref_id, hit_id, unnest({_grams('hit_title')}) AS g FROM tw) GROUP BY ALL),
j AS (SELECT coalesce(ga.ref_id, gb.ref_id) AS ref_id, coalesce(ga.hit_id, gb.hit_id) AS hit_id, ga.f AS fa, gb.f AS fb FROM ga FULL JOIN gb ON ga.ref_id = gb.ref_id AND ga.hit_id = gb.hit_id AND ga.g = gb.g)
SELECT ref_id, hit_id, round(100.0 * sum(coalesce(fa * fb, 0)) / (sqrt(sum(CASE WHEN fa IS NULL THEN 0 WHEN fb IS NULL THEN power(1 + ln(1.5), 2) * fa * fa ELSE fa * fa END)) * sqrt(sum(CASE WHEN fb IS NULL THEN 0 WHEN fa IS NULL THEN power(1 + ln(1.5), 2) * fb * fb ELSE fb * fb END))), 6) AS cosine FROM j GROUP BY 1, 2"""


def _set(x: str) -> str:
    return f"list_distinct(list_filter(string_split(lower({x}), ' '), lambda w: w <> ''))"


_JL = "coalesce(length(array_to_string({l}, ' ')), 0)"
TOKEN_SET_BOUND = f""", b AS (SELECT ref_id, hit_id, {_set('raw_text')} AS a, {_set('hit_title')} AS b FROM tw),
c AS (SELECT ref_id, hit_id, len(a) AS na, len(b) AS nb, {_JL.format(l='list_filter(a, lambda w: list_contains(b, w))')} AS s, {_JL.format(l='list_filter(a, lambda w: NOT list_contains(b, w))')} AS p, {_JL.format(l='list_filter(b, lambda w: NOT list_contains(a, w))')} AS q FROM b),
e AS (SELECT *, CASE WHEN s > 0 THEN 1 ELSE 0 END AS gap FROM c), f AS (SELECT *, s + gap + p AS la, s + gap + q AS lb FROM e)
SELECT ref_id, hit_id, round(CASE WHEN na = 0 OR nb = 0 THEN 0 WHEN s > 0 AND (p = 0 OR q = 0) THEN 100 ELSE 100 * CASE WHEN s > 0 THEN greatest(1 - abs(p - q) / (la + lb), 1 - (gap + p) / (s + la), 1 - (gap + q) / (s + lb)) ELSE 1 - abs(p - q) / (la + lb) END END, 6) AS bound FROM f"""

TOPK = """WITH v AS (SELECT DISTINCT ON (vec_id) vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, greatest(0, least(100, list_cosine_similarity(a.e, b.e) * 100)) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, vec_id, round(s, 4) AS cosine_pct FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS k FROM p) WHERE k <= 5"""

_C = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS citation_type, unnest(regexp_extract_all(text, {q(p)}, 0)) AS citation_text FROM documents WHERE text IS NOT NULL" for k, p in (("IEEE", IEEE), ("Author-Year", AUTHOR_YEAR), ("DOI", DOI), ("URL", URL)))
CITATIONS = f"SELECT doc_id, citation_type, citation_text, count(*) AS n FROM ({_C}) GROUP BY ALL"
CITED = rf"""bodies AS (SELECT doc_id, unnest(regexp_extract_all(text, {q(IEEE)}, 1)) AS body FROM documents WHERE text IS NOT NULL),
part AS (SELECT doc_id, trim(unnest(string_split_regex(body, '[,;]'))) AS p FROM bodies),
lohi AS (SELECT doc_id, CAST(regexp_extract(p, '^(\d+)', 1) AS INT) AS a, CAST(regexp_extract(p, '(\d+)$', 1) AS INT) AS b FROM part WHERE regexp_full_match(p, '\d{{1,6}}|\d{{1,6}}\s*[-–]\s*\d{{1,6}}')),
cited AS (SELECT DISTINCT doc_id, CAST(unnest(range(a, b + 1)) AS INT) AS ref_number FROM lohi WHERE a <= b)"""
MISMATCH = rf"""WITH c AS (SELECT DISTINCT doc_id, lower(regexp_extract(regexp_replace(t, '^\(\s*', ''), '^([A-Za-z]+)', 1)) AS author, CAST(regexp_extract(t, '(19\d{{2}}|20\d{{2}})', 1) AS INT) AS year FROM (SELECT doc_id, unnest(regexp_extract_all(text, {q(AUTHOR_YEAR)}, 1)) AS t FROM documents WHERE text IS NOT NULL)),
r AS (SELECT DISTINCT document_id AS doc_id, lower(authors) AS a, year AS y FROM bib_refs)
SELECT doc_id, author, year FROM c WHERE doc_id IN (SELECT doc_id FROM r) AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = c.doc_id AND contains(r.a, c.author) AND (r.y IS NULL OR abs(c.year - r.y) <= 1))"""
QUOTES = f"SELECT prep_id, quote, count(*) AS n FROM (SELECT prep_id, unnest(regexp_extract_all(t, {q(DOUBLE_QUOTES)}, 1)) AS quote FROM (SELECT DISTINCT prep_id, original_full_text AS t FROM preprocessed WHERE original_full_text IS NOT NULL)) GROUP BY 1, 2"
UNCITED = f"""SELECT doc_id, count(*) FILTER (NOT regexp_matches(p, {q(IEEE)}) AND NOT regexp_matches(p, {q(AUTHOR_YEAR)}) AND NOT (contains(lower(p), 'in this section') OR contains(lower(p), 'we propose') OR contains(lower(p), 'we present') OR contains(lower(p), 'our model'))) AS uncited, count(*) AS paragraphs
FROM (SELECT doc_id, {strip('x')} AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS x FROM documents WHERE text IS NOT NULL)) WHERE length(p) > 150 GROUP BY 1"""

_NUM = r"'^(?:\[\s*(\d+)\s*\]|(\d+)\.\s+)'"
_DOIX = r"'\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)\b'"
_VOL = r"'(?i)(?:vol(?:ume)?\.?\s*(\d+)|(\d+)\s*\(\s*(\d+)\s*\))'"
_PG = r"'(?i)(?:pp?\.?\s*(\d+[-–]\d+|\d+)|:\s*(\d+[-–]\d+))'"
_x = lambda c, p, g: f"nullif(regexp_extract({c}, {p}, {g}), '')"
FIELDS = rf"""WITH w AS (SELECT DISTINCT ref_id, raw_text, {strip(f"regexp_replace(raw_text, {_NUM}, '')")} AS w0 FROM bib_refs WHERE raw_text IS NOT NULL),
v AS (SELECT *, regexp_replace(w0, '\b10\.\d{{4,9}}/[-._;()/:A-Za-z0-9]+\b', '', 'g') AS work FROM w)
SELECT ref_id, CAST(coalesce({_x('raw_text', _NUM, 1)}, {_x('raw_text', _NUM, 2)}) AS INT) AS ref_number, regexp_replace({_x('w0', _DOIX, 1)}, '\.+$', '') AS doi, CAST({_x('work', r"'\b(19\d\d|20\d\d)[a-z]?\b'", 1)} AS INT) AS year,
coalesce({_x('work', _VOL, 1)}, {_x('work', _VOL, 2)}) AS volume, {_x('work', _VOL, 3)} AS issue, coalesce({_x('work', _PG, 1)}, {_x('work', _PG, 2)}) AS pages FROM v"""
REGISTRY = f"""WITH g AS (SELECT lower(trim(doi)) AS k, arg_min(title, hit_id) AS rt, arg_min(year, hit_id) AS ry FROM scholar_hits WHERE doi IS NOT NULL AND doi <> '' GROUP BY 1)
SELECT DISTINCT ref_id, CASE WHEN g.rt IS NULL THEN 'BROKEN LINK' WHEN (year IS NOT NULL AND ry IS NOT NULL AND abs(year - ry) > 1) OR (title IS NOT NULL AND {_KEY} <> regexp_replace(lower(rt), '[^a-z0-9]', '', 'g')) THEN 'PARTIALLY VERIFIED' ELSE 'VERIFIED' END AS status FROM bib_refs b LEFT JOIN g ON lower(trim(b.doi)) = g.k WHERE b.doi IS NOT NULL AND b.doi <> ''"""


def _has(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in parts) + ")"


DOMAINS = f"""WITH h AS (SELECT hit_id, url, reliability, source_type, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host FROM scholar_hits)
SELECT DISTINCT hit_id, CASE WHEN url IS NOT NULL AND url <> '' THEN host END AS host, CASE WHEN url IS NULL OR url = '' THEN reliability WHEN {_has('host', HIGH)} THEN 'High' ELSE 'Medium' END AS reliability,
CASE WHEN url IS NULL OR url = '' THEN source_type WHEN {_has('host', HIGH)} THEN 'Journal / Academic' WHEN {_has('host', PREPRINT)} THEN 'Preprint Repository' WHEN contains(host, 'wikipedia') THEN 'Wikipedia' ELSE source_type END AS source_type FROM h"""
PHRASES = rf"""WITH p AS (SELECT doc_id, unnest(range(0, len(l))) AS p, trim(regexp_replace(unnest(l), '\s+', ' ', 'g')) AS para FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
s AS (SELECT doc_id, p, unnest(range(0, len(l))) AS k, unnest(l) AS s FROM (SELECT doc_id, p, string_split_regex(para, '[.?!]\s+') AS l FROM p WHERE length(para) >= 80)),
g AS (SELECT doc_id, p, k, array_to_string(list_slice(string_split_regex({strip('s')}, '\s+'), 1, 10), ' ') AS phrase FROM s WHERE len(string_split_regex({strip('s')}, '\s+')) >= 8 AND NOT {_has('lower(s)', BOILERPLATE)}),
n AS (SELECT doc_id, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) - 1 AS query_no FROM g) SELECT doc_id, query_no, phrase FROM n WHERE query_no < 4"""

_DEVW = r"list_distinct(regexp_extract_all(text, '[\x{0900}-\x{097F}]+'))"
_marks = lambda m: "[" + ", ".join(map(q, m)) + "]"
LANGUAGE = rf"""WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^\x{{0900}}-\x{{097F}}]', '', 'g')) AS dev_chars, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin_chars,
len(list_intersect({_DEVW}, {_marks(HINDI)})) AS hindi_hits, len(list_intersect({_DEVW}, {_marks(MARATHI)})) + CASE WHEN contains(text, 'ळ') THEN 3 ELSE 0 END AS marathi_hits FROM documents WHERE text IS NOT NULL)
SELECT *, CASE WHEN dev_chars + latin_chars > 0 AND dev_chars / (dev_chars + latin_chars) > 0.4 THEN CASE WHEN marathi_hits > hindi_hits THEN 'Marathi' ELSE 'Hindi' END ELSE 'English' END AS detected FROM c"""

_CASE = "CASE " + " ".join(f"WHEN regexp_matches(lower(t), {q(p)}) THEN {q(n)}" for n, p in SECTIONS) + " END"
_HEADS = f"""l AS (SELECT doc_id, length(text) AS total, unnest(range(0, len(a))) AS line_no, unnest(a) AS line FROM (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char, trim(line) AS t FROM l),
hd AS (SELECT doc_id, start_char, total, {_CASE} AS section FROM o WHERE length(t) > 3 AND length(t) < 80),
nx AS (SELECT *, coalesce(lead(start_char) OVER (PARTITION BY doc_id ORDER BY start_char), total) AS nxt FROM hd WHERE section IS NOT NULL),
sec AS (SELECT doc_id, section, CAST(min(start_char) AS BIGINT) AS start_char, CAST(arg_max(nxt, start_char) AS BIGINT) AS end_char FROM nx GROUP BY 1, 2)"""
SECTIONS_SQL = f"WITH {_HEADS} SELECT doc_id, section, start_char, end_char FROM sec"
STYLE = rf"""WITH {DOC_SENTENCES}, b AS (SELECT doc_id, count(*) AS n_sentences, avg(n) AS m, stddev_pop(n) AS sd FROM (SELECT doc_id, len(list_filter(string_split_regex(sentence, '\s+'), lambda w: w <> '')) AS n FROM s) GROUP BY 1),
w AS (SELECT doc_id, count(*) AS total, count(DISTINCT w) AS kinds FROM (SELECT doc_id, unnest(regexp_extract_all(lower(sentence), '[a-z]{{3,}}')) AS w FROM s) GROUP BY 1)
SELECT doc_id, n_sentences, round(m, 6) AS mean_len, round(sd, 6) AS std_len, round(sd / (m + 1e-5), 6) AS burstiness, round(CASE WHEN coalesce(total, 0) > 50 THEN kinds / total ELSE 0.6 END, 6) AS ttr FROM b LEFT JOIN w USING (doc_id)"""

_FIRST = "f AS (SELECT clean, min(source_id * 1000000 + sent_idx) AS k FROM sc GROUP BY clean)"
SCORES = f"""WITH {DOC_CLEAN}, {SRC_CLEAN}, {_FIRST}, m AS (SELECT doc_id, CAST(sum(greatest(1, {wc('sentence')})) AS BIGINT) AS w, count(*) AS c FROM dc JOIN f USING (clean) GROUP BY 1),
z AS (SELECT d.doc_id, {wc("coalesce(text, '')")} AS doc_words, coalesce(w, 0) AS w, coalesce(c, 0) AS c FROM documents d LEFT JOIN m USING (doc_id)), y AS (SELECT *, CASE WHEN doc_words > 0 THEN least(100.0, w / doc_words * 100) ELSE 0 END AS pct FROM z)
SELECT doc_id, doc_words, w AS exact_words, 0 AS fuzzy_words, 0 AS semantic_words, c AS exact_count, 0 AS fuzzy_count, 0 AS semantic_count, w AS effective_words, round(pct, 6) AS overall_pct, round(pct, 6) AS exact_pct,
CASE WHEN pct <= 10 THEN 'Very Low' WHEN pct <= 25 THEN 'Low' WHEN pct <= 40 THEN 'Moderate' WHEN pct <= 60 THEN 'High' ELSE 'Very High' END AS risk_level FROM y"""
SECTION_SCORES = f"""WITH {DOC_CLEAN}, {SRC_CLEAN}, {_FIRST}, {_HEADS}, m AS (SELECT dc.doc_id, strpos(d.text, sentence) - 1 AS pos, {wc('sentence')} AS words FROM dc JOIN f USING (clean) JOIN documents d ON d.doc_id = dc.doc_id)
SELECT m.doc_id, section, CAST(sum(words) AS BIGINT) AS matched_words, count(*) AS matches FROM m JOIN sec ON sec.doc_id = m.doc_id AND pos >= start_char AND pos < end_char GROUP BY 1, 2"""
