"""Queries of the verification of submissions, the citation audit and the register, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.functions import registry, similarity, text
from papersieve.operators import audit, match, profile, register, verify
from papersieve.plans import sql
from papersieve.plans.catalog import bib, docs, equal_matches, query
from papersieve.session import cut, read_table


def library(spark: SparkSession, d: str) -> DataFrame:
    """One row per source: the latest delivery."""
    s = read_table(spark, d, "sources")
    rest = ["title", "url", "text_content", "source_type", "reliability"]
    return s.groupBy("source_id").agg(F.max_by(F.struct(*rest), "created_at").alias("s")).select("source_id", "s.*")


def verified(spark: SparkSession, d: str) -> DataFrame:
    """The classified matches of a folder, computed once in a session and kept as a table in the shared folder."""
    kept = spark.sparkContext.__dict__.setdefault("_papersieve_verified", {})
    if d not in kept:
        kept[d] = cut(verify.verified_matches(docs(spark, d), library(spark, d)))
    return kept[d]


def audited(spark: SparkSession, d: str) -> DataFrame:
    return audit.issues(docs(spark, d), bib(spark, d).select("doc_id", "ref_id", "ref_number", "authors", "year", "title"))


# Verification


@query()
def verified_matches(spark, d):
    return verified(spark, d)


@query()
def verified_scores(spark, d):
    return verify.scores(verified(spark, d), docs(spark, d), bib(spark, d), audited(spark, d))


@query()
def verified_scores_with_quotes(spark, d):
    return verify.scores(verified(spark, d), docs(spark, d), bib(spark, d), audited(spark, d), exclude_quotes=False)


@query()
def verified_sections(spark, d):
    return verify.section_shares(verified(spark, d), docs(spark, d))


@query()
def verified_report_rows(spark, d):
    return register.match_rows(verified(spark, d))


@query()
def verified_highlights(spark, d):
    """Class and clamped span of every shown match, as the highlighted text needs them."""
    sizes = docs(spark, d).select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    m = register.highlighted(verified(spark, d)).join(sizes, "doc_id")
    start, end = register.clamped(F.col("start_char"), F.col("end_char"), F.col("sentence"), F.col("n"))
    return m.select("doc_id", "sent_idx", register.highlight_class(F.col("algorithm"), F.col("is_quoted")).alias("class"), start.alias("start_char"), end.alias("end_char"))


@query(
    f"WITH {sql.DOC_CLEAN}, {sql.SRC_CLEAN}, f AS (SELECT clean, min(source_id * 1000000 + sent_idx) AS k FROM sc GROUP BY clean), m AS (SELECT doc_id, count(*) AS n FROM dc JOIN f USING (clean) GROUP BY 1), "
    f"z AS (SELECT d.doc_id, {sql.wc(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS words, coalesce(n, 0) AS exact_count FROM documents d LEFT JOIN m USING (doc_id)) "
    "SELECT doc_id, words, exact_count, 0 AS fuzzy_count, 0 AS semantic_count, 0 AS quoted_count, round(exact_count / greatest(1, words) * 100, 1) AS exact_pct, 0.0 AS fuzzy_pct, 0.0 AS semantic_pct, 0.0 AS quoted_pct FROM z"
)
def archived_results(spark, d):
    return register.archived_results(docs(spark, d), equal_matches(spark, d).withColumn("is_quoted", F.lit(False)))


_UNIT = "(SELECT DISTINCT unit_id, is_quoted, is_cited FROM sentence_units)"
_Q, _C = "coalesce(is_quoted, false)", "coalesce(is_cited, false)"


@query(
    f"SELECT unit_id, CASE WHEN {_Q} AND {_C} THEN 'Quoted + Cited' WHEN {_Q} THEN 'Quoted (Uncited)' WHEN {_C} THEN 'Copied + Cited Without Quotation' ELSE 'Copied + No Citation' END AS exact_category, CASE WHEN {_C} THEN 'Paraphrased + Cited' ELSE 'Copied + No Citation' END AS fuzzy_category, "
    f"CASE WHEN {_C} THEN 'Paraphrased + Cited' ELSE 'Paraphrased (Uncited)' END AS semantic_category, CASE WHEN {_Q} THEN 'quoted' ELSE 'exact' END AS exact_class, CASE WHEN {_Q} THEN 'quoted' ELSE 'semantic' END AS semantic_class FROM {_UNIT}"
)
def unit_categories(spark, d):
    """What a match of every archived unit would be called by each stage, by its flags."""
    u = read_table(spark, d, "sentence_units").select("unit_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("is_quoted", "is_cited"))).distinct()
    of = lambda a: verify.category(F.lit(a), F.col("is_quoted"), F.col("is_cited"), F.lit(False))
    look = lambda a: register.highlight_class(F.lit(a), F.col("is_quoted"))
    return u.select("unit_id", of(match.EXACT).alias("exact_category"), of(match.FUZZY_MATCH).alias("fuzzy_category"), of(match.SEMANTIC_MATCH).alias("semantic_category"), look(match.EXACT).alias("exact_class"), look(match.SEMANTIC_MATCH).alias("semantic_class"))


@query("SELECT DISTINCT u.unit_id, least(coalesce(u.start_char, 0), d.n) AS start_char, least(coalesce(u.end_char, coalesce(u.start_char, 0) + length(u.original_text)), d.n) AS end_char FROM sentence_units u JOIN (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents) d USING (doc_id)")
def unit_spans(spark, d):
    sizes = docs(spark, d).select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    u = read_table(spark, d, "sentence_units").join(sizes, "doc_id")
    start, end = register.clamped(F.col("start_char"), F.col("end_char"), F.col("original_text"), F.col("n"))
    return u.select("unit_id", start.alias("start_char"), end.alias("end_char")).distinct()


@query("SELECT doc_id, pos, min(sent_index) AS sent_idx FROM (SELECT DISTINCT doc_id, unnest([0, 100, 1000]) AS pos FROM sentence_units) p JOIN sentence_units u USING (doc_id) WHERE pos BETWEEN start_char AND end_char GROUP BY 1, 2")
def point_lookup(spark, d):
    u = read_table(spark, d, "sentence_units").withColumnRenamed("sent_index", "sent_idx")
    points = u.select("doc_id").distinct().withColumn("pos", F.explode(F.array(F.lit(0), F.lit(100), F.lit(1000))))
    return register.at_point(u, points)


# Citation audit

_TOK = "lower(regexp_extract(split_part(authors, ',', 1), '(\\S+)', 1))"
_BODY = f"{sql._HEADS}, rs AS (SELECT doc_id, start_char AS rs FROM sec WHERE section = 'References'), body AS (SELECT d.doc_id, d.text, coalesce(rs, -1) AS ref_start, CASE WHEN coalesce(rs, -1) > 0 THEN left(d.text, rs) ELSE d.text END AS body FROM documents d LEFT JOIN rs USING (doc_id) WHERE d.text IS NOT NULL)"
_ISSUES = rf"""WITH {_BODY}, bodies AS (SELECT doc_id, unnest(regexp_extract_all(body, {sql.q(audit.citations.IEEE)}, 1)) AS b FROM body),
part AS (SELECT doc_id, trim(unnest(string_split_regex(b, '[,;]'))) AS p FROM bodies),
lohi AS (SELECT doc_id, CAST(regexp_extract(p, '^(\d+)', 1) AS INT) AS a, CAST(regexp_extract(p, '(\d+)$', 1) AS INT) AS b FROM part WHERE regexp_full_match(p, '\d{{1,6}}|\d{{1,6}}\s*[-–]\s*\d{{1,6}}')),
num AS (SELECT doc_id, CAST(unnest(range(a, b + 1)) AS INT) AS ref_number FROM lohi WHERE a <= b),
nam AS (SELECT doc_id, t AS citation_text, lower(regexp_extract(t, '([A-Za-z]+)', 1)) AS author, CAST(regexp_extract(t, '(19\d{{2}}|20\d{{2}})', 1) AS INT) AS y FROM (SELECT doc_id, unnest(regexp_extract_all(body, {sql.q(audit.citations.AUTHOR_YEAR)}, 1)) AS t FROM body)),
r AS (SELECT ref_id, min(document_id) AS doc_id, min(ref_number) AS ref_number, min(authors) AS authors, min(year) AS year, min(title) AS title FROM bib_refs GROUP BY 1),
w AS (SELECT *, coalesce({_TOK}, '') AS word FROM r),
hit AS (SELECT c.doc_id, c.author, c.y, arg_min(w.ref_number, w.ref_id) FILTER (w.ref_number IS NOT NULL) AS nn, arg_min(coalesce(w.ref_number, -1), w.ref_id) AS ref_number FROM (SELECT DISTINCT doc_id, author, y FROM nam) c JOIN w ON w.doc_id = c.doc_id AND word <> '' AND (contains(word, author) OR contains(author, word)) AND (w.year IS NULL OR abs(c.y - w.year) <= 1) GROUP BY 1, 2, 3),
cited AS (SELECT doc_id, ref_number FROM num UNION SELECT doc_id, ref_number FROM hit WHERE ref_number <> -1)
SELECT doc_id, 'Missing Reference' AS issue_type, '[' || ref_number || ']' AS citation_text, ref_number FROM num WHERE doc_id IN (SELECT doc_id FROM r WHERE ref_number IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = num.doc_id AND r.ref_number = num.ref_number)
UNION ALL SELECT doc_id, 'Citation Mismatch', citation_text, NULL FROM nam WHERE doc_id IN (SELECT doc_id FROM r) AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = nam.doc_id AND h.author = nam.author AND h.y = nam.y)
UNION ALL SELECT doc_id, 'Unused Reference', 'Ref #' || ref_number || ': ' || left(coalesce(title, ''), 45) || '...', ref_number FROM w WHERE ref_number <> 0 AND NOT EXISTS (SELECT 1 FROM cited c WHERE c.doc_id = w.doc_id AND c.ref_number = w.ref_number)
AND NOT coalesce(length(word) > 3 AND contains((SELECT lower(text) FROM documents d WHERE d.doc_id = w.doc_id), word), false)"""


@query(_ISSUES)
def citation_issues(spark, d):
    return audited(spark, d)


@query(f"SELECT doc_id, count(*) FILTER (issue_type = 'Missing Reference') AS missing, count(*) FILTER (issue_type = 'Citation Mismatch') AS mismatched, count(*) FILTER (issue_type = 'Unused Reference') AS unused, count(*) AS issues FROM ({_ISSUES}) GROUP BY 1")
def citation_issue_counts(spark, d):
    return audit.issue_counts(audited(spark, d))


@query(rf"WITH {_BODY}, t AS (SELECT doc_id, substr(text, CAST(ref_start AS INT) + 1) AS t FROM body WHERE ref_start > 0), n AS (SELECT doc_id, len(regexp_extract_all(t, '(?m)(^\s*\[\d+\]|^\s*\d+\.\s+)', 1)) AS numbered, len(list_filter(string_split(t, chr(10)), lambda x: length(trim(x)) > 20)) AS lines FROM t) SELECT *, greatest(numbered, lines) AS estimate FROM n")
def reference_estimate(spark, d):
    return audit.reference_estimate(audit.bodies(docs(spark, d)))


# Register


@query("SELECT doc_id, filename, coalesce(strftime(upload_date, '%Y-%m-%d %H:%M:%S'), '') AS upload_date, coalesce(nullif(student_name, ''), 'Student') AS student_name, coalesce(nullif(prn_number, ''), '-') AS prn_number, coalesce(nullif(course_name, ''), 'MCA') AS course_name, coalesce(nullif(academic_year, ''), '2025-2026') AS academic_year, coalesce(nullif(guide_name, ''), '-') AS guide_name, coalesce(nullif(paper_title, ''), filename) AS paper_title FROM documents")
def document_rows(spark, d):
    return register.document_rows(docs(spark, d))


@query("SELECT DISTINCT ON (source_id) source_id, title, author, publication_year, publisher, url, source_type, word_count, coalesce(strftime(created_at, '%Y-%m-%d %H:%M:%S'), '') AS created_at FROM (SELECT * FROM sources ORDER BY source_id, sources.created_at DESC NULLS LAST)")
def source_rows(spark, d):
    return register.source_rows(read_table(spark, d, "sources"))


@query("WITH l AS (SELECT ref_id, max(coalesce(loaded_at, extracted_at)) AS at FROM bib_refs GROUP BY 1) SELECT DISTINCT b.ref_id, document_id, ref_number, coalesce(raw_text, '') AS raw_text, coalesce(title, '') AS title, coalesce(authors, '') AS authors, coalesce(journal, '') AS journal, year, coalesce(volume, '') AS volume, coalesce(issue, '') AS issue, coalesce(pages, '') AS pages, coalesce(doi, '') AS doi, coalesce(nullif(status, ''), 'NOT VERIFIED') AS status, coalesce(is_duplicate, false) AS is_duplicate FROM bib_refs b JOIN l ON b.ref_id = l.ref_id AND coalesce(b.loaded_at, b.extracted_at) = l.at")
def reference_rows(spark, d):
    return register.reference_rows(read_table(spark, d, "bib_refs"))


@query("SELECT DISTINCT ref_id, status FROM bib_refs WHERE status = 'VERIFIED'")
def status_filter(spark, d):
    return read_table(spark, d, "bib_refs").where("status = 'VERIFIED'").select("ref_id", "status").distinct()


@query("SELECT doc_id, paper_title, student_name FROM documents WHERE doc_id = 7")
def document_by_id(spark, d):
    return docs(spark, d).where("doc_id = 7").select("doc_id", "paper_title", "student_name")


@query("SELECT c.course, count(d.doc_id) AS n FROM (SELECT unnest(['MCA', 'Integrated MCA', 'MBA', 'BCA', 'BBA']) AS course UNION SELECT DISTINCT coalesce(nullif(trim(course_name), ''), 'MCA') FROM documents) c LEFT JOIN documents d ON coalesce(nullif(trim(course_name), ''), 'MCA') = c.course GROUP BY 1")
def course_distribution_filled(spark, d):
    known = spark.createDataFrame([(c,) for c in ("MCA", "Integrated MCA", "MBA", "BCA", "BBA")], "course string")
    n = docs(spark, d).groupBy(F.coalesce(F.nullif(F.trim("course_name"), F.lit("")), F.lit("MCA")).alias("course")).agg(F.count("*").alias("n"))
    return known.join(n, "course", "full").na.fill(0, ["n"])


_WC = sql.wc("text")
@query(rf"WITH t AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p, greatest(1, CAST(ceil({_WC} / 400.0) AS INT)) AS pages FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, pages, greatest(1, CAST(floor(len(p) / pages) AS INT)) AS per, unnest(range(0, len(p))) AS paragraph_no, unnest(p) AS para FROM t) SELECT doc_id, paragraph_no, least(paragraph_no // per + 1, pages) AS page_number, CAST(coalesce(sum(length(para) + 2) OVER (PARTITION BY doc_id ORDER BY paragraph_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char, {sql.wc('para')} AS words FROM e")
def paragraph_pages(spark, d):
    return register.paragraph_pages(docs(spark, d))


@query("SELECT file_id, count(*) AS pages, count(*) FILTER (chars < 400 AND images > 0) AS scanned_pages, count(*) FILTER (chars < 400 AND images > 0) / count(*) >= 0.3 AS is_scanned FROM (SELECT ext_id AS file_id, p.page_number AS page, max(p.char_end - p.char_start) AS chars, max(CASE WHEN is_scanned THEN 1 ELSE 0 END) AS images FROM (SELECT ext_id, is_scanned, unnest(pages) AS p FROM extracted_docs) GROUP BY 1, 2) GROUP BY 1")
def scanned_files(spark, d):
    """Files of which three tenths of the pages are short and come from images."""
    p = read_table(spark, d, "extracted_docs").select("ext_id", "is_scanned", F.explode("pages").alias("p"))
    pages = p.groupBy(F.col("ext_id").alias("file_id"), F.col("p.page_number").alias("page")).agg(F.max(F.col("p.char_end") - F.col("p.char_start")).alias("chars"), F.max(F.when(F.col("is_scanned"), 1).otherwise(0)).alias("images"))
    return register.scanned_files(pages, least_chars=400)


@query("WITH gone AS (SELECT DISTINCT source_id FROM sources WHERE source_type IS NULL OR reliability IS NULL), m AS (SELECT doc_id, sent_index, CAST(doc_id % 50 + 1 AS BIGINT) AS source_id FROM sentence_units) SELECT CASE WHEN m.source_id IN (SELECT source_id FROM gone) THEN NULL ELSE m.source_id END AS source_id, count(*) AS n FROM m GROUP BY 1")
def source_deleted(spark, d):
    """Archived units by source after the sources without type or reliability are deleted: their key becomes null."""
    s = read_table(spark, d, "sources")
    m = read_table(spark, d, "sentence_units").select("doc_id", "sent_index", (F.col("doc_id") % 50 + 1).cast("long").alias("source_id"))
    _, left = register.without_source(s, m, s.where("source_type is null or reliability is null"))
    return left.groupBy("source_id").agg(F.count("*").alias("n"))


@query(f"SELECT title, author, publication_year, url, text_content, sha256(coalesce(text_content, '')) AS hash, {sql.wc(chr(99) + 'oalesce(text_content, ' + chr(39) * 2 + ')')} AS word_count FROM (SELECT DISTINCT {sql.strip('title')} AS title, author, publication_year, url, text_content FROM sources) WHERE coalesce(title, '') <> ''")
def sources_to_insert(spark, d):
    raw = read_table(spark, d, "sources").select("title", "author", F.col("publication_year").cast("string").alias("year"), "url", "text_content").distinct()
    return register.new_sources(raw).distinct()


# Functions

_N = "(dev_chars + latin_chars)"


@query(f"SELECT doc_id, detected, round(CASE WHEN {sql.strip('text')} = '' THEN 1.0 WHEN {_N} = 0 THEN 0.5 WHEN detected = 'Hindi' THEN least(0.95, 0.6 + 2.0 * hindi_hits / 18) WHEN detected = 'Marathi' THEN least(0.95, 0.6 + 2.0 * marathi_hits / 17) ELSE least(0.99, greatest(0.7, latin_chars / {_N})) END, 6) AS confidence FROM ({sql.LANGUAGE}) JOIN documents USING (doc_id)")
def language_confidence(spark, d):
    c = profile.language_columns(F.col("text"))
    t = docs(spark, d).where("text is not null").select("doc_id", "text", *(x.alias(n) for n, x in c.items()))
    return t.select("doc_id", "detected", F.round(profile.language_confidence(t), 6).alias("confidence"))


@query(
    r"""WITH q AS (SELECT DISTINCT ref_id, title FROM bib_refs WHERE title IS NOT NULL), c AS (SELECT DISTINCT hit_id, title FROM scholar_hits WHERE title IS NOT NULL),
t AS (SELECT 'q' AS side, ref_id AS id, regexp_extract_all(lower(title), '[\p{L}\p{N}_]{2,}') AS w FROM q UNION ALL SELECT 'c', hit_id, regexp_extract_all(lower(title), '[\p{L}\p{N}_]{2,}') FROM c),
g AS (SELECT side, id, g, count(*) AS f FROM (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM t) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM t), df AS (SELECT g, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf FROM g GROUP BY 1), v AS (SELECT side, id, g, f * idf AS x FROM g JOIN df USING (g)), s AS (SELECT side, id, sqrt(sum(x * x)) AS norm FROM v GROUP BY ALL),
p AS (SELECT a.id AS ref_id, b.id AS hit_id, sum(a.x * b.x) AS dot FROM v a JOIN v b ON a.g = b.g AND a.side = 'q' AND b.side = 'c' GROUP BY 1, 2)
SELECT ref_id, hit_id, round(100 * dot / (x.norm * y.norm), 4) AS cosine FROM p JOIN s x ON x.side = 'q' AND x.id = ref_id JOIN s y ON y.side = 'c' AND y.id = hit_id WHERE 100 * dot / (x.norm * y.norm) >= 50"""
)
def batch_tfidf(spark, d):
    """All references against all hits, by one model of all their titles."""
    q = read_table(spark, d, "bib_refs").where("title is not null").select(F.col("ref_id").alias("id"), F.col("title").alias("t")).distinct()
    c = read_table(spark, d, "scholar_hits").where("title is not null").select(F.col("hit_id").alias("id"), F.col("title").alias("t")).distinct()
    return similarity.batch_tfidf(q, c, least=50.0).select(F.col("q_id").alias("ref_id"), F.col("c_id").alias("hit_id"), F.round("cosine", 4).alias("cosine"))


@query()
def sql_functions(spark, d):
    """The registered functions called from SQL over all extracted files and all reference titles."""
    registry.register(spark)
    read_table(spark, d, "extracted_docs").select("ext_id", "full_text").distinct().createOrReplaceTempView("papersieve_extracted")
    return spark.sql("SELECT x.ext_id, s.sent_idx, s.start_char, s.end_char FROM papersieve_extracted x, LATERAL split_sentences(x.full_text) s")


@query("SELECT DISTINCT source_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(title, '[^A-Za-z ]', '', 'g')), '\\s+', ' ', 'g'), ' ', '_', 'g')) || '.txt' AS filename FROM sources WHERE title IS NOT NULL AND regexp_replace(title, '[^A-Za-z ]', '', 'g') <> ''")
def safe_filenames(spark, d):
    """File names made of the letters of source titles, through the sanitizer."""
    letters = F.regexp_replace("title", "[^A-Za-z ]", "")
    s = read_table(spark, d, "sources").where("title is not null").withColumn("k", letters).where("k <> ''")
    name = F.concat(F.trim(F.replace(F.regexp_replace(F.lower("k"), r"\s+", " "), F.lit(" "), F.lit("_"))), F.lit(".txt"))
    return s.select("source_id", text.sanitize_filename(name).alias("filename")).distinct()
