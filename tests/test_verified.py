"""Verification of submissions, citation audit and register on small inputs."""

import pytest
from pyspark.sql import functions as F

from papersieve import session
from papersieve.functions import registry, similarity
from papersieve.operators import audit, citations, match, register, verify
from papersieve.sources import sinks

SOURCES = "source_id long, title string, url string, text_content string, source_type string, reliability string"
REFS = "doc_id long, ref_id long, ref_number int, authors string, year int, title string, status string"


def verified(spark, texts, sources):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "doc_id long, text string")
    src = spark.createDataFrame([(i, f"Source {i}", "https://a.test/x", t, "Journal", "High") for i, t in enumerate(sources, 7)], SOURCES)
    return docs, verify.verified_matches(docs, src)


def test_matches_are_classified_by_their_context(spark):
    base = "The proposed filter reduces the drift of cheap sensors in humid rooms"
    gap = " Some filler words stand here so that nothing lies near to any citation at all, and more of them follow until the distance is large enough for every rule."
    texts = [
        f"{base}.{gap}", f"{base} [1].{gap}", f'"{base}" [2].{gap}', f"Intro text of the paper comes first.\nReferences\n{base}.", None, "",
        "The drift of cheap sensors in humid rooms is what the filter reduces, as proposed.", "In this study the results indicate that.",
    ]
    docs, m = verified(spark, texts, [f"{base}.", "In this study the results indicate that.", None])
    got = {r.doc_id: r for r in m.collect()}
    assert got[1].match_category == "Copied + No Citation" and got[1].confidence == "High" and got[1].source_domain == "a.test" and not got[1].is_ignored
    assert got[2].match_category == "Copied + Cited Without Quotation" and got[3].match_category == "Quoted + Cited"
    assert 4 not in got and 5 not in got and 6 not in got
    assert got[7].algorithm == "Fuzzy Match" and got[8].is_common and got[8].is_ignored and got[8].match_category == "Common Knowledge"
    refs = spark.createDataFrame([(1, 1, 1, "Lee, K.", 2001, "T", "VERIFIED"), (1, 2, 2, "Kim, A.", 2001, "T", None), (1, 2, 2, "Kim, A.", 2001, "T", None)], REFS)
    issues = spark.createDataFrame([(1, "Unused Reference")], "doc_id long, issue_type string")
    s = {r.doc_id: r for r in verify.scores(m, docs, refs, issues).collect()}
    assert len(s) == 8 and s[5].doc_words == 0 and s[5].overall_pct == 0 and s[5].risk_level == "Very Low"
    assert (s[1].exact_words, s[1].exact_count, s[1].high_risk_words, s[1].reference_verification, s[1].citation_coverage) == (12, 1, 12, 50.0, 95.0)
    assert (s[3].quoted_count, s[3].exact_count, s[3].overall_pct) == (1, 0, 0.0) and s[8].ignored_count == 1 and s[8].matched_words == 0
    on = {r.doc_id: r for r in verify.scores(m, docs, refs, issues, exclude_quotes=False).collect()}
    assert on[3].exact_count == 1 and on[3].overall_pct > 0


def test_sections_by_the_offset_of_the_match(spark):
    line = "The same long sentence stands here in two sections of it."
    docs, m = verified(spark, [f"Abstract\n{line}\nResults\n{line}\n"], [line])
    got = {r.section: (r.matched_words, r.pct) for r in verify.section_shares(m, docs).collect()}
    assert got["Abstract"][0] == got["Results"][0] == 11 and 0 < got["Results"][1] <= 100


def test_semantic_stage_takes_the_first_of_the_first_sources(spark):
    a = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, 0, a, a)], "doc_id long, sent_idx int, sentence string, clean string")
    near = a.replace("kappa", "lambda")
    src = spark.createDataFrame([(5, 0, "nothing of that", "nothing of that"), (6, 0, near, near), (7, 0, a, a)], "source_id long, sent_idx int, sentence string, clean string")
    r = match.semantic_first(docs, src).collect()
    assert [(x.source_id, x.score) for x in r] == [(6, round(spark.range(1).select(similarity.pair_tfidf(F.lit(a), F.lit(near))).first()[0], 1))]
    assert match.semantic_first(docs, src.limit(0)).count() == 0


def test_audit_of_citations(spark):
    text = "As Lee (2020) says and (Roy, 1999) too, see [1] and [3-4]. Menkar is named.\nReferences\n[9] inside"
    docs = spark.createDataFrame([(1, text), (2, "No list [5]."), (3, None)], "doc_id long, text string")
    refs = spark.createDataFrame([(1, 10, 1, "Abe, B.", 2001, "A"), (1, 11, 2, "Lee, K.; Kim", 2021, "B"), (1, 12, 3, "Zed", None, "C"), (1, 13, 6, "Menkar, A.", 2000, "D"), (1, 14, 7, "Oro, A.", 2000, None), (1, 14, 7, "Oro, A.", 2000, None), (1, 15, None, "Una", 2000, "E"), (4, 16, 1, None, None, None)], "doc_id long, ref_id long, ref_number int, authors string, year int, title string")
    got = {(r.doc_id, r.issue_type, r.ref_number) for r in audit.issues(docs, refs).collect()}
    assert got == {(1, "Missing Reference", 4), (1, "Citation Mismatch", None), (1, "Unused Reference", 7), (4, "Unused Reference", 1)}
    body = {r.doc_id: (r.ref_start > 0, "[9]" in r.body) for r in audit.bodies(docs).collect()}
    assert body == {1: (True, False), 2: (False, False)}
    assert [(r.numbered, r.estimate) for r in audit.reference_estimate(audit.bodies(docs)).collect()] == [(1, 1)]


def test_long_ranges_are_filled(spark):
    d = spark.createDataFrame([(1, "See [1-2500] and [7-3] and [123456789-123456790]."), (2, "")], "doc_id long, text string")
    assert citations.cited_numbers(d, "doc_id", "text").count() == 2500


def test_register(spark, tmp_path):
    m = spark.createDataFrame([(1, 0, 0, 20, "Exact Match", True, False), (1, 1, 15, 40, "Semantic Similarity", False, False), (1, 2, 41, 60, "Fuzzy Match", False, True)], "doc_id long, sent_idx int, start_char int, end_char int, algorithm string, is_quoted boolean, is_ignored boolean")
    shown = {f: register.highlighted(m, f).count() for f in register.FILTERS}
    assert shown == {"All": 2, "Exact": 1, "Fuzzy": 0, "Semantic": 1, "Quoted": 1}
    with pytest.raises(ValueError):
        register.highlighted(m, "Other")
    assert [r.c for r in m.select(register.highlight_class(F.col("algorithm"), F.col("is_quoted")).alias("c")).collect()] == ["quoted", "semantic", "fuzzy"]
    points = spark.createDataFrame([(1, 18), (1, 50), (1, 99), (2, 1)], "doc_id long, pos int")
    assert {(r.pos, r.sent_idx) for r in register.at_point(m, points).collect()} == {(18, 0), (50, 2)}
    a, b = register.clamped(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit("abc"), F.lit(2))
    assert tuple(spark.range(1).select(a, b).first()) == (0, 2)
    src = spark.createDataFrame([(1, "A"), (2, "B")], "source_id long, title string")
    left, fixed = register.without_source(src, spark.createDataFrame([(1, 1), (2, 2), (3, None)], "doc_id long, source_id long"), src.where("source_id = 1"))
    assert left.count() == 1 and {tuple(r) for r in fixed.select("doc_id", "source_id").collect()} == {(1, None), (2, 2), (3, None)}
    raw = spark.createDataFrame([(" T ", "a", "2001", None, "x y"), (None, "a", "x", None, None), ("U", None, "20b", None, None)], "title string, author string, year string, url string, text_content string")
    assert {(r.title, r.publication_year, r.word_count) for r in register.new_sources(raw).collect()} == {("T", 2001, 2), ("U", None, 0)}
    for _ in range(2):
        register.persist(str(tmp_path), src, m, src, src)
    assert spark.read.parquet(str(tmp_path / "matches")).count() == 6 and spark.read.parquet(str(tmp_path / "documents")).count() == 4
    filled = sinks.with_columns_filled(src, {"title": "?", "status": "new"})
    assert {r.status for r in filled.collect()} == {"new"}


def test_batch_tfidf_loses_no_pair(spark):
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["the growth of small towns", "river floods in spring", "growth of rivers", "", "one"])], "id long, t string")
    c = spark.createDataFrame([(i, t) for i, t in enumerate(["small towns and their growth", "the growth of small towns", "floods of the river in spring", "one", "x"])], "id long, t string")
    everything = {(r.q_id, r.c_id): r.cosine for r in similarity.batch_tfidf(q, c).collect()}
    some = {(r.q_id, r.c_id) for r in similarity.batch_tfidf(q, c, least=40.0).collect()}
    assert some == {k for k, v in everything.items() if v >= 40.0} and abs(everything[0, 1] - 100) < 1e-6 and abs(everything[4, 3] - 100) < 1e-6


def test_functions_are_callable_from_sql(spark):
    registry.register(spark)
    r = spark.sql("SELECT token_set_ratio('a b c', 'c b a') AS t, partial_ratio('abc', 'xxabcxx') AS p, nfkc('ﬁ') AS n").first()
    assert (r.t, r.p, r.n) == (100.0, 100.0, "fi")
    assert spark.sql("SELECT s.sentence FROM VALUES ('One sentence is here. Another one is there.'), (CAST(NULL AS STRING)) AS x(t), LATERAL split_sentences(x.t) s").count() == 2
    assert spark.sql("SELECT s.kind FROM VALUES ('See [1] now.') AS x(t), LATERAL find_spans(x.t) s").first().kind == "IEEE"
    assert spark.sql("SELECT s.ref_number FROM VALUES ('B\nReferences\n[4] A. Lee (2001). A title.') AS x(t), LATERAL split_references(x.t) s").first().ref_number == 4


def test_cut_refuses_a_cluster_without_a_shared_folder(spark, monkeypatch):
    class Jsc:
        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

        def isLocal(self):
            return False

    class Context:
        _jsc = Jsc()

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_bound_of_the_cosine_is_one(spark):
    texts = ["a bc de fg hi jk lm", "bc bc bc de fg", "the growth of the small towns of the delta", "the growth of small towns", "bc de", "zz yy", "bc"]
    rows = [(x, y) for x in texts for y in texts]
    got = spark.createDataFrame(rows, "x string, y string").select(similarity.pair_tfidf(F.col("x"), F.col("y")).alias("v"), similarity.pair_tfidf_bound(similarity.grams(F.col("x")), similarity.grams(F.col("y"))).alias("b")).collect()
    assert all(r.v <= r.b + 1e-6 for r in got) and any(r.b < 75 for r in got)
