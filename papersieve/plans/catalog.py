"""All queries of the core, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papersieve.functions import similarity, text
from papersieve.operators import citations, dense, match, profile, references, score, segment, web
from papersieve.plans import sql
from papersieve.session import cut, read_table
from papersieve.sources import sinks

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if oracle:
            _SQL[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents")


def sources(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "sources").select("source_id", "title", "text_content", "url").distinct()


def doc_sentences(spark: SparkSession, d: str) -> DataFrame:
    return segment.compared_sentences(docs(spark, d), "doc_id", "text")


def source_sentences(spark: SparkSession, d: str) -> DataFrame:
    return segment.compared_sentences(sources(spark, d).select("source_id", "text_content").distinct(), "source_id", "text_content")


def bib(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "bib_refs").withColumnRenamed("document_id", "doc_id")


# Text functions and segmentation


@query(f"SELECT doc_id, {sql.clean(sql.NFKC)} AS clean FROM documents WHERE text IS NOT NULL")
def clean_text(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", text.clean_for_analysis(F.col("text")).alias("clean"))


@query(f"WITH {sql.DOC_SENTENCES} SELECT doc_id, sent_idx, sentence FROM s")
def sentence_split(spark, d):
    return segment.fast_sentences(docs(spark, d), "doc_id", "text").withColumn("sent_idx", F.col("sent_idx").cast("long"))


@query(f"WITH {sql.DOC_SENTENCES}, c AS (SELECT doc_id, {sql.clean('sentence')} AS clean FROM s) SELECT sha256(clean) AS sentence_hash, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM c WHERE {sql.WORDS4} GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def sentence_hash_dups(spark, d):
    s = doc_sentences(spark, d).groupBy(F.sha2("clean", 256).alias("sentence_hash"), "doc_id").agg(F.count("*").alias("k"))
    return s.groupBy("sentence_hash").agg(F.sum("k").alias("n"), F.count("*").alias("n_docs")).where("n_docs > 1")


@query()
def sentences_offsets(spark, d):
    return segment.sentences_with_offsets(docs(spark, d), "doc_id", "text")


@query(f"SELECT doc_id, {sql.wc('text')} AS word_count, greatest(1, CAST(ceil({sql.wc('text')} / 400.0) AS INT)) AS page_count, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def word_page_totals(spark, d):
    n = text.word_count(F.col("text"))
    return docs(spark, d).where("text is not null").select("doc_id", n.alias("word_count"), F.greatest(F.lit(1), F.ceil(n / 400.0).cast("int")).alias("page_count"), F.sha2("text", 256).alias("content_hash"))


@query("SELECT DISTINCT ext_id, p.page_number AS page_number, sum(p.word_count) OVER (PARTITION BY ext_id, extracted_at ORDER BY p.page_number) AS words_so_far, p.char_start = sum(p.char_end - p.char_start + 2) OVER (PARTITION BY ext_id, extracted_at ORDER BY p.page_number) - (p.char_end - p.char_start + 2) AS offsets_agree FROM (SELECT ext_id, extracted_at, unnest(pages) AS p FROM (SELECT DISTINCT ON (ext_id, extracted_at) * FROM extracted_docs))")
def page_offsets(spark, d):
    x = read_table(spark, d, "extracted_docs").dropDuplicates(["ext_id", "extracted_at"]).select("ext_id", "extracted_at", F.explode("pages").alias("p"))
    w = W.partitionBy("ext_id", "extracted_at").orderBy("p.page_number")
    size = F.col("p.char_end") - F.col("p.char_start") + 2
    return x.select("ext_id", "p.page_number", F.sum("p.word_count").over(w).alias("words_so_far"), (F.col("p.char_start") == F.sum(size).over(w) - size).alias("offsets_agree")).distinct()


# Matching


@query(f"WITH {sql.DOC_CLEAN}, {sql.SRC_CLEAN}, f AS (SELECT clean, min(source_id * 1000000 + sent_idx) AS k FROM sc GROUP BY clean) SELECT doc_id, sent_idx, k // 1000000 AS source_id, k % 1000000 AS src_idx FROM dc JOIN f USING (clean)")
def exact_match_equi(spark, d):
    return match.exact_equal(doc_sentences(spark, d), source_sentences(spark, d)).select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), "source_id", F.col("src_idx").cast("long").alias("src_idx"))


@query(f"WITH {sql.DOC_CLEAN}, {sql.SRC_CLEAN}, u AS (SELECT DISTINCT clean FROM dc), f AS (SELECT clean, min(source_id * 1000000 + sent_idx) AS k FROM sc GROUP BY clean), m AS (SELECT u.clean, min(f.k) AS k FROM u JOIN f ON contains(u.clean, f.clean) OR contains(f.clean, u.clean) GROUP BY 1) SELECT doc_id, sent_idx, k // 1000000 AS source_id, k % 1000000 AS src_idx FROM dc JOIN m USING (clean)")
def exact_match_containment(spark, d):
    return match.exact_matches(cut(doc_sentences(spark, d)), cut(source_sentences(spark, d))).select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), "source_id", F.col("src_idx").cast("long").alias("src_idx"))


@query()
def fuzzy_best_match(spark, d):
    return match.fuzzy_best(cut(doc_sentences(spark, d)), cut(source_sentences(spark, d)))


@query("SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS first_doc_id FROM documents WHERE text IS NOT NULL QUALIFY doc_id > first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id)")
def duplicate_docs(spark, d):
    k = docs(spark, d).where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    first = k.groupBy("h").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n")).where("n > 1")
    return k.join(first, "h").where("doc_id > first_doc_id").select("doc_id", "first_doc_id")


def title_twins(spark: SparkSession, d: str) -> DataFrame:
    """References and hits with one title key: (ref_id, hit_id, raw_text, title)."""
    r = read_table(spark, d, "bib_refs").where("title is not null and raw_text is not null").select("ref_id", "raw_text", text.title_key(F.col("title")).alias("k")).distinct()
    h = read_table(spark, d, "scholar_hits").where("title is not null").select("hit_id", F.col("title").alias("hit_title"), text.title_key(F.col("title")).alias("k")).distinct()
    return r.join(h.where("k <> ''"), "k").drop("k")


@query(f"WITH {sql.TWINS} SELECT ref_id, hit_id, round({sql.JACCARD}, 6) AS jaccard FROM tw")
def jaccard_pairs(spark, d):
    return title_twins(spark, d).select("ref_id", "hit_id", F.round(similarity.jaccard(F.col("raw_text"), F.col("hit_title")), 6).alias("jaccard"))


@query(sql.TFIDF)
def tfidf_pair_cosine(spark, d):
    c = similarity.pair_tfidf_frame(title_twins(spark, d), ["ref_id", "hit_id"], "raw_text", "hit_title")
    return c.select("ref_id", "hit_id", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {sql.TWINS} {sql.TOKEN_SET_BOUND}")
def token_set_bounds(spark, d):
    t = title_twins(spark, d)
    return t.select("ref_id", "hit_id", F.round(similarity.token_set_bound(F.lower("raw_text"), F.lower("hit_title")), 6).alias("bound"))


@query(sql.TOPK)
def dense_cosine_topk(spark, d):
    return dense.top_neighbours(read_table(spark, d, "embeddings"))


# Citations and references


@query(sql.CITATIONS)
def citation_extract(spark, d):
    return citations.citations(docs(spark, d), "doc_id", "text").groupBy("doc_id", "citation_type", "citation_text").agg(F.count("*").alias("n"))


@query(f"WITH {sql.CITED} SELECT doc_id, ref_number FROM cited")
def citation_range_expand(spark, d):
    return citations.cited_numbers(docs(spark, d), "doc_id", "text")


@query(f"WITH {sql.CITED}, r AS (SELECT DISTINCT document_id AS doc_id, ref_number FROM bib_refs) SELECT doc_id, ref_number FROM cited WHERE doc_id IN (SELECT doc_id FROM r) AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = cited.doc_id AND r.ref_number = cited.ref_number)")
def missing_refs(spark, d):
    return citations.missing_references(citations.cited_numbers(docs(spark, d), "doc_id", "text"), bib(spark, d))


@query(
    f"WITH {sql.CITED}, r AS (SELECT DISTINCT document_id AS doc_id, ref_number, authors FROM bib_refs), w AS (SELECT r.*, regexp_replace(lower(regexp_extract(trim(authors), '^(\\S+)', 1)), '[.,;]+$', '') AS word FROM r WHERE NOT EXISTS (SELECT 1 FROM cited c WHERE c.doc_id = r.doc_id AND c.ref_number = r.ref_number)) "
    "SELECT DISTINCT w.doc_id, w.ref_number FROM w LEFT JOIN documents d ON d.doc_id = w.doc_id WHERE NOT coalesce(length(word) > 3 AND contains(lower(d.text), word), false)"
)
def unused_refs(spark, d):
    return citations.unused_references(citations.cited_numbers(docs(spark, d), "doc_id", "text"), bib(spark, d), docs(spark, d))


@query(sql.MISMATCH)
def author_year_mismatch(spark, d):
    return citations.author_year_mismatch(citations.citations(docs(spark, d), "doc_id", "text"), bib(spark, d))


@query(sql.QUOTES)
def quote_spans(spark, d):
    t = read_table(spark, d, "preprocessed").select("prep_id", F.col("original_full_text").alias("t")).where("t is not null").distinct()
    return t.select("prep_id", F.explode(F.regexp_extract_all("t", F.lit(citations.DOUBLE_QUOTES), F.lit(1))).alias("quote")).groupBy("prep_id", "quote").agg(F.count("*").alias("n"))


@query()
def citation_quote_offsets(spark, d):
    p = read_table(spark, d, "preprocessed").select("prep_id", "original_full_text").distinct()
    return citations.spans(p, "prep_id", "original_full_text")


@query()
def sentence_cited_flags(spark, d):
    t = docs(spark, d)
    s = segment.sentences_with_offsets(t, "doc_id", "text")
    return citations.annotate(s, citations.spans(t, "doc_id", "text"), "doc_id").select("doc_id", "sent_idx", "is_quoted", "is_cited")


@query(sql.UNCITED)
def uncited_claims(spark, d):
    p = docs(spark, d).where("text is not null").select("doc_id", F.explode(F.split("text", "\n\n")).alias("p")).select("doc_id", text.strip(F.col("p")).alias("p")).where(F.length("p") > 150)
    known = F.array_max(F.array(*[F.lower("p").contains(x) for x in ("in this section", "we propose", "we present", "our model")]))
    cited = F.col("p").rlike(citations.IEEE) | F.col("p").rlike(citations.AUTHOR_YEAR)
    return p.groupBy("doc_id").agg(F.count_if(~cited & ~known).alias("uncited"), F.count("*").alias("paragraphs"))


@query(sql.FIELDS)
def reference_fields(spark, d):
    f = references.fields(F.col("raw_text"))
    return read_table(spark, d, "bib_refs").select("ref_id", "raw_text").where("raw_text is not null").distinct().select("ref_id", *(f[c].alias(c) for c in ("ref_number", "doi", "year", "volume", "issue", "pages")))


@query("WITH k AS (SELECT DISTINCT document_id AS doc_id, ref_id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS k FROM bib_refs WHERE title IS NOT NULL), f AS (SELECT *, min(ref_id) OVER (PARTITION BY doc_id, k) AS first_ref_id FROM k WHERE length(k) > 10) SELECT DISTINCT doc_id, ref_id, first_ref_id FROM f WHERE ref_id > first_ref_id")
def reference_dups(spark, d):
    return references.duplicates(bib(spark, d))


@query("SELECT coalesce(status, 'NONE') AS status, count(DISTINCT ref_id) AS n, count(DISTINCT document_id) AS n_docs FROM bib_refs GROUP BY 1")
def ref_status(spark, d):
    return bib(spark, d).groupBy(F.coalesce("status", F.lit("NONE")).alias("status")).agg(F.count_distinct("ref_id").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(sql.REGISTRY)
def registry_lookup(spark, d):
    return web.registry_join(read_table(spark, d, "bib_refs"), read_table(spark, d, "scholar_hits"))


@query()
def search_verification(spark, d):
    return web.search_status(read_table(spark, d, "bib_refs"), read_table(spark, d, "scholar_hits"))


@query()
def bibliography_split(spark, d):
    """Bibliographies assembled from the references of each document and split again."""
    r = bib(spark, d).where("raw_text is not null").select("doc_id", "ref_number", "raw_text").distinct()
    whole = r.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref_number", "raw_text"))), lambda x: x.raw_text), "\n").alias("t"))
    return references.split_bibliographies(whole.select("doc_id", F.concat(F.lit("References\n"), "t").alias("t")), "doc_id", "t")


# Web hits


@query("SELECT regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS title_key, min(hit_id) AS hit_id, count(DISTINCT hit_id) AS n FROM scholar_hits WHERE title IS NOT NULL AND regexp_replace(lower(title), '[^a-z0-9]', '', 'g') <> '' GROUP BY 1")
def web_title_dedup(spark, d):
    return web.dedup_titles(read_table(spark, d, "scholar_hits"))


@query(sql.DOMAINS)
def domain_reliability(spark, d):
    return web.classify(read_table(spark, d, "scholar_hits"))


@query()
def web_grouping(spark, d):
    """Hits grouped by like titles; the earliest of a group leads."""
    return web.title_groups(read_table(spark, d, "scholar_hits"))


@query(sql.PHRASES)
def smart_queries(spark, d):
    return web.search_phrases(docs(spark, d), "doc_id", "text").withColumn("query_no", F.col("query_no").cast("long"))


@query("SELECT event_type, count(*) AS n, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k, max(CAST(json_extract_string(props, '$.k') AS INT)) AS max_k FROM events GROUP BY 1")
def json_payload(spark, d):
    k = F.from_json("props", "k int")["k"]
    return read_table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(k), 6).alias("mean_k"), F.max(k).alias("max_k"))


# Profiles


@query(sql.LANGUAGE)
def language_profile(spark, d):
    c = profile.language_columns(F.col("text"))
    return docs(spark, d).where("text is not null").select("doc_id", *(x.alias(n) for n, x in c.items()))


@query(sql.SECTIONS_SQL)
def structure_sections(spark, d):
    return profile.sections(docs(spark, d), "doc_id", "text")


@query(sql.STYLE)
def stylometry(spark, d):
    return profile.stylometry(segment.fast_sentences(docs(spark, d), "doc_id", "text"), "doc_id")


@query()
def machine_likelihood(spark, d):
    return profile.machine_likelihood(profile.stylometry(segment.fast_sentences(docs(spark, d), "doc_id", "text"), "doc_id"))


@query()
def common_phrases(spark, d):
    s = segment.fast_sentences(docs(spark, d), "doc_id", "text").select("sentence").distinct()
    return s.where(profile.common_phrase(F.col("sentence")))


@query(f"WITH {sql.DOC_CLEAN}, w AS (SELECT DISTINCT doc_id, unnest(string_split(clean, ' ')) AS w FROM dc) SELECT doc_id, count(*) FILTER (w IN ('the', 'of', 'and', 'in', 'is')) AS marker_hits, count(*) AS n_words FROM w GROUP BY 1")
def marker_intersect(spark, d):
    w = doc_sentences(spark, d).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list(F.split("clean", " ")))).alias("w"))
    marks = F.array(*map(F.lit, ("the", "of", "and", "in", "is")))
    return w.select("doc_id", F.size(F.array_intersect("w", marks)).cast("long").alias("marker_hits"), F.size("w").cast("long").alias("n_words"))


# Scores and register


def equal_matches(spark: SparkSession, d: str) -> DataFrame:
    return match.exact_equal(doc_sentences(spark, d), source_sentences(spark, d)).withColumn("algorithm", F.lit("Exact Match"))


def staged(spark: SparkSession, d: str) -> DataFrame:
    """Exact matches, containment included, and fuzzy ones."""
    return cut(match.staged_matches(cut(doc_sentences(spark, d)), cut(source_sentences(spark, d)), semantic=False))


def scored(spark: SparkSession, d: str, matches: Callable[[SparkSession, str], DataFrame] = equal_matches) -> DataFrame:
    words = doc_sentences(spark, d).select("doc_id", "sent_idx", text.word_count(F.col("sentence")).alias("words"))
    sizes = docs(spark, d).select("doc_id", text.word_count(F.coalesce("text", F.lit(""))).alias("doc_words"))
    return score.breakdown(matches(spark, d).join(words, ["doc_id", "sent_idx"]), sizes)


@query(sql.SCORES)
def score_breakdown(spark, d):
    return scored(spark, d)


@query(f"WITH sc AS ({sql.SCORES}), b AS (SELECT unnest(['Very Low', 'Low', 'Moderate', 'High', 'Very High']) AS risk_level) SELECT b.risk_level, count(sc.doc_id) AS n, round(count(sc.doc_id) * 1.0 / sum(count(sc.doc_id)) OVER (), 6) AS share FROM b LEFT JOIN sc USING (risk_level) GROUP BY 1")
def risk_distribution(spark, d):
    return risk_shares(spark, scored(spark, d))


def risk_shares(spark: SparkSession, scores: DataFrame) -> DataFrame:
    bands = spark.createDataFrame([(x,) for x, _ in (*score.RISK_BANDS, ("Very High", 0))], "risk_level string")
    n = bands.join(scores.groupBy("risk_level").agg(F.count("*").alias("n")), "risk_level", "left").na.fill(0, ["n"])
    return n.select("risk_level", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 6).alias("share"))


@query(f"SELECT count(*) AS total_docs, round(avg(overall_pct), 6) AS avg_similarity, max(overall_pct) AS highest_similarity, count(*) FILTER (risk_level IN ('High', 'Very High')) AS high_risk FROM ({sql.SCORES})")
def dashboard_kpis(spark, d):
    return kpis(scored(spark, d))


def kpis(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("total_docs"), F.round(F.avg("overall_pct"), 6).alias("avg_similarity"), F.max("overall_pct").alias("highest_similarity"), F.count_if(F.col("risk_level").isin("High", "Very High")).alias("high_risk"))


@query(sql.SECTION_SCORES)
def section_scores(spark, d):
    return by_section(spark, d, equal_matches(spark, d))


def by_section(spark: SparkSession, d: str, matches: DataFrame) -> DataFrame:
    t = docs(spark, d)
    at = F.expr("locate(sentence, text)") - 1
    m = matches.join(segment.fast_sentences(t, "doc_id", "text"), ["doc_id", "sent_idx"]).join(t.select("doc_id", "text"), "doc_id").select("doc_id", at.alias("at"), text.word_count(F.col("sentence")).alias("words"))
    s = profile.sections(t, "doc_id", "text")
    return m.join(s, "doc_id").where("at >= start_char and at < end_char").groupBy("doc_id", "section").agg(F.sum("words").cast("long").alias("matched_words"), F.count("*").alias("matches"))


@query("SELECT coalesce(nullif(trim(course_name), ''), 'MCA') AS course, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY 1")
def course_distribution(spark, d):
    n = docs(spark, d).groupBy(F.coalesce(F.nullif(F.trim("course_name"), F.lit("")), F.lit("MCA")).alias("course")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 6))


@query("SELECT doc_id, student_name, prn_number FROM documents WHERE contains(lower(student_name), 'mate') OR contains(lower(prn_number), 'mate') OR contains(lower(paper_title), 'mate') OR contains(lower(filename), 'mate')")
def register_search(spark, d):
    hit = lambda c: F.coalesce(F.lower(c).contains("mate"), F.lit(False))
    return docs(spark, d).where(hit("student_name") | hit("prn_number") | hit("paper_title") | hit("filename")).select("doc_id", "student_name", "prn_number")


@query("SELECT doc_id, course_name FROM documents WHERE contains(course_name, 'MCA')")
def program_filter(spark, d):
    return docs(spark, d).where(F.col("course_name").contains("MCA")).select("doc_id", "course_name")


@query("SELECT doc_id, upload_date FROM documents ORDER BY upload_date DESC NULLS LAST, doc_id DESC LIMIT 8")
def recent_topk(spark, d):
    return docs(spark, d).select("doc_id", "upload_date").orderBy(F.desc_nulls_last("upload_date"), F.desc("doc_id")).limit(8)


@query("SELECT row_number() OVER (ORDER BY upload_date, doc_id) AS place, doc_id FROM (SELECT doc_id, upload_date FROM documents WHERE upload_date IS NOT NULL ORDER BY upload_date DESC, doc_id DESC LIMIT 8)")
def timeline_reverse(spark, d):
    last = docs(spark, d).where("upload_date is not null").orderBy(F.desc("upload_date"), F.desc("doc_id")).limit(8)
    return last.select(F.row_number().over(W.partitionBy(F.lit(1)).orderBy("upload_date", "doc_id")).cast("long").alias("place"), "doc_id")


@query("SELECT 'source' AS kind, source_id AS id, title AS name, length(text_content) AS n_chars FROM (SELECT DISTINCT source_id, title, text_content FROM sources) WHERE text_content IS NOT NULL UNION ALL SELECT 'archive', doc_id, coalesce(student_name, 'Unknown') || ' (' || coalesce(course_name, '') || ')', length(text) FROM documents WHERE text IS NOT NULL")
def corpus_union(spark, d):
    s = sources(spark, d).where("text_content is not null").select("source_id", "title", "text_content").distinct().select(F.lit("source").alias("kind"), F.col("source_id").alias("id"), F.col("title").alias("name"), F.length("text_content").cast("long").alias("n_chars"))
    a = docs(spark, d).where("text is not null").select(F.lit("archive").alias("kind"), F.col("doc_id").alias("id"), F.concat(F.coalesce("student_name", F.lit("Unknown")), F.lit(" ("), F.coalesce("course_name", F.lit("")), F.lit(")")).alias("name"), F.length("text").cast("long").alias("n_chars"))
    return s.unionByName(a)


@query(f"WITH {sql.CITED}, r AS (SELECT DISTINCT document_id AS doc_id, ref_number FROM bib_refs) SELECT doc_id, count(*) AS cited_not_available FROM (SELECT doc_id, ref_number FROM cited EXCEPT SELECT doc_id, ref_number FROM r) GROUP BY 1")
def cited_minus_available(spark, d):
    cited = citations.cited_numbers(docs(spark, d), "doc_id", "text")
    return cited.exceptAll(cited.join(bib(spark, d).select("doc_id", "ref_number").distinct(), ["doc_id", "ref_number"], "left_semi")).groupBy("doc_id").agg(F.count("*").alias("cited_not_available"))


@query(f"WITH {sql.DOC_CLEAN}, {sql.SRC_CLEAN}, f AS (SELECT clean, min(source_id * 1000000 + sent_idx) AS k FROM sc GROUP BY clean) SELECT k // 1000000 AS source_id, min(doc_id) AS first_doc_id, count(*) AS matches, count(DISTINCT doc_id) AS n_docs FROM dc JOIN f USING (clean) GROUP BY 1")
def matched_sources_first(spark, d):
    return by_source(equal_matches(spark, d))


def by_source(m: DataFrame) -> DataFrame:
    return m.groupBy("source_id").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("matches"), F.count_distinct("doc_id").alias("n_docs"))


@query("SELECT ref_id, CASE WHEN length(title) > 45 THEN left(title, 42) || '...' ELSE title END AS short_title, CASE WHEN length(doi) > 12 THEN left(doi, 9) || '...' ELSE doi END AS short_doi, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM (SELECT DISTINCT ref_id, title, doi FROM bib_refs)")
def snippet_escape(spark, d):
    r = read_table(spark, d, "bib_refs").select("ref_id", "title", "doi").distinct()
    return r.select("ref_id", text.truncate(F.col("title"), 45, 42).alias("short_title"), text.truncate(F.col("doi"), 12, 9).alias("short_doi"), text.html_escape(F.col("title")).alias("escaped"))


@query("SELECT doc_id, regexp_extract(filename, '\\.([^.]+)$', 1) AS suffix, coalesce(nullif(split_part(trim(course_name), ' (', 1), ''), 'none') AS course, strftime(upload_date, '%d-%m-%Y') AS day, printf('%04d', doc_id) AS number FROM documents")
def register_projection(spark, d):
    return docs(spark, d).select("doc_id", F.regexp_extract("filename", r"\.([^.]+)$", 1).alias("suffix"), F.coalesce(F.nullif(F.split_part(F.trim("course_name"), F.lit(" ("), F.lit(1)), F.lit("")), F.lit("none")).alias("course"), F.date_format("upload_date", "dd-MM-yyyy").alias("day"), F.format_string("%04d", "doc_id").alias("number"))


@query("SELECT DISTINCT source_id, coalesce(nullif(split_part(url, '/', 3), ''), 'Local Library') AS host FROM sources")
def source_hosts(spark, d):
    return sources(spark, d).select("source_id", text.url_domain(F.col("url")).alias("host")).distinct()


@query("SELECT source_id, row_number() OVER (ORDER BY created_at DESC, source_id) AS place FROM (SELECT source_id, max(created_at) AS created_at FROM sources GROUP BY 1)")
def sources_by_date(spark, d):
    """All sources, latest first; the total order is a range sort over partitions, numbered by partition offsets."""
    s = read_table(spark, d, "sources").groupBy("source_id").agg(F.max("created_at").alias("created_at"))
    ordered = cut(s.orderBy(F.desc("created_at"), "source_id").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.alias("x").join(sizes.alias("y"), F.col("y.part") < F.col("x.part"), "left").groupBy(F.col("x.part").alias("part")).agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("before"))  # one row per partition
    return ordered.join(before, "part").select("source_id", (F.col("before") + F.row_number().over(W.partitionBy("part").orderBy("at"))).cast("long").alias("place"))


@query(f"WITH {sql.DOC_CLEAN}, {sql.SRC_CLEAN}, f AS (SELECT clean, min(source_id * 1000000 + sent_idx) AS k FROM sc GROUP BY clean) SELECT doc_id, sent_idx, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) AS match_id FROM dc JOIN f USING (clean)")
def match_export(spark, d):
    return exported(equal_matches(spark, d))


def exported(m: DataFrame) -> DataFrame:
    return sinks.match_export(m).select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), F.col("match_id").cast("long").alias("match_id"))


@query("WITH lines AS (SELECT DISTINCT ext_id, unnest(string_split(full_text, chr(10))) AS line FROM (SELECT DISTINCT ext_id, full_text FROM extracted_docs)) SELECT ext_id, count(*) AS table_lines FROM lines WHERE regexp_matches(line, '(?i)^(figure|fig\\.?|table|chart)\\s*\\d+') GROUP BY 1")
def caption_lines(spark, d):
    x = read_table(spark, d, "extracted_docs").select("ext_id", "full_text").distinct()
    lines = x.select("ext_id", F.explode(F.split("full_text", "\n")).alias("line")).distinct()
    return lines.where(F.col("line").rlike(r"(?i)^(figure|fig\.?|table|chart)\s*\d+")).groupBy("ext_id").agg(F.count("*").alias("table_lines"))


@query("WITH st AS (SELECT event_type AS k, CAST(max(value) AS VARCHAR) AS v FROM events WHERE event_type <> 'error' GROUP BY 1), df AS (SELECT unnest(['click', 'error', 'theme']) AS k, 'default' AS v) SELECT df.k AS setting, CASE WHEN st.k IS NULL THEN df.v ELSE 'stored' END AS origin FROM df LEFT JOIN st ON st.k = df.k")
def settings_overlay(spark, d):
    stored = read_table(spark, d, "events").where("event_type <> 'error'").groupBy(F.col("event_type").alias("setting")).agg(F.lit("stored").alias("origin"))
    defaults = spark.createDataFrame([(k, "default") for k in ("click", "error", "theme")], "setting string, origin string")
    return sinks.upsert(defaults, stored.join(defaults, "setting", "left_semi"), "setting")


# The same over exact and fuzzy matches; the SQL of the queries above holds them to equal sentences.


@query()
def staged_score_breakdown(spark, d):
    return scored(spark, d, staged)


@query()
def staged_risk_distribution(spark, d):
    return risk_shares(spark, scored(spark, d, staged))


@query()
def staged_dashboard_kpis(spark, d):
    return kpis(scored(spark, d, staged))


@query()
def staged_section_scores(spark, d):
    return by_section(spark, d, staged(spark, d))


@query()
def staged_matched_sources_first(spark, d):
    return by_source(staged(spark, d))


@query()
def staged_match_export(spark, d):
    return exported(staged(spark, d))
