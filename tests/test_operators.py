import io
import zipfile

from pyspark.sql import functions as F

from papersieve.operators import citations, dense, match, profile, references, score, segment, web
from papersieve.sources import files, sinks
from papersieve.streaming import intake


def sents(spark, rows, key):
    df = spark.createDataFrame(rows, f"{key} long, t string")
    return segment.compared_sentences(df, key, "t")


def test_containment_equals_brute_force(spark):
    d = [(1, "The quick brown fox jumps over the lazy dog."), (2, "We say the quick brown fox jumps over the lazy dog today."), (3, "Nothing in common with any of them here.")]
    s = [(10, "quick brown fox jumps over the lazy dog."), (11, "brown fox jumps over the lazy d.")]
    docs, src = sents(spark, d, "doc_id"), sents(spark, s, "source_id")
    got = {(r.doc_id, r.source_id) for r in match.exact_matches(docs, src).collect()}
    dl, sl = docs.collect(), src.collect()
    want = {}
    for a in dl:
        for b in sl:
            if a.clean in b.clean or b.clean in a.clean:
                want[a.doc_id] = min(want.get(a.doc_id, b.source_id), b.source_id)
    assert got == set(want.items())


def test_stages_take_what_is_left(spark):
    docs = sents(spark, [(1, "The method improves the accuracy of the large model clearly."), (2, "The method clearly improves the accuracy of a large model.")], "doc_id")
    src = sents(spark, [(7, "The method improves the accuracy of the large model clearly.")], "source_id")
    got = {(r.doc_id, r.algorithm) for r in match.staged_matches(docs, src).collect()}
    assert (1, "Exact Match") in got and (2, "Fuzzy Match") in got


def test_citation_ranges_and_missing(spark):
    d = spark.createDataFrame([(1, "As in [1-3] and [5–6], see [15]. (Smith, 2020)"), (2, None)], "doc_id long, text string")
    cited = citations.cited_numbers(d, "doc_id", "text")
    assert sorted(r.ref_number for r in cited.collect()) == [1, 2, 3, 5, 6, 15]
    refs = spark.createDataFrame([(1, i, "Lee, K.", 2001) for i in range(1, 8)], "doc_id long, ref_number int, authors string, year int")
    assert [r.ref_number for r in citations.missing_references(cited, refs).collect()] == [15]
    mis = citations.author_year_mismatch(citations.citations(d, "doc_id", "text"), refs).collect()
    assert [(r.author, r.year) for r in mis] == [("smith", 2020)]


def test_annotation_of_sentences(spark):
    t = 'He wrote "this is a long quotation here" [2]. A plain sentence follows at some distance from everything else here.'
    d = spark.createDataFrame([(1, t)], "doc_id long, text string")
    s = segment.sentences_with_offsets(d, "doc_id", "text")
    r = {x.sent_idx: (x.is_quoted, x.is_cited) for x in citations.annotate(s, citations.spans(d, "doc_id", "text"), "doc_id").collect()}
    assert r[0] == (True, True)


def test_references_split_and_fields(spark):
    t = "Body.\nReferences\n[1] A. Lee (2001). A title of work. Journal, 3(4), pp. 5-9.\n[2] B. Kim (2002). Another title of work.\n"
    d = spark.createDataFrame([(1, t)], "doc_id long, text string")
    got = references.split_bibliographies(d, "doc_id", "text").collect()
    assert [r.ref_number for r in got][-2:] == [1, 2]
    f = references.fields(F.col("raw_text"))
    row = references.split_bibliographies(d, "doc_id", "text").where("ref_number = 1").select(*(c.alias(n) for n, c in f.items())).first()
    assert (row.year, row.volume, row.issue, row.pages, row.title) == (2001, "3", "4", "5-9", "A title of work")


def test_risk_levels_and_breakdown(spark):
    m = spark.createDataFrame([(1, "Exact Match", 10), (1, "Fuzzy Match", 10)], "doc_id long, algorithm string, words int")
    d = spark.createDataFrame([(1, 100), (2, 0), (3, 50)], "doc_id long, doc_words int")
    got = {r.doc_id: (r.effective_words, r.overall_pct, r.risk_level) for r in score.breakdown(m, d).collect()}
    assert got == {1: (18, 18.0, "Low"), 2: (0, 0.0, "Very Low"), 3: (0, 0.0, "Very Low")}


def test_sections_and_phrases(spark):
    d = spark.createDataFrame([(1, "Abstract\ntext\n1. Introduction\nmore\nResults\nend")], "doc_id long, text string")
    got = {r.section: (r.start_char, r.end_char) for r in profile.sections(d, "doc_id", "text").collect()}
    assert got == {"Abstract": (0, 14), "Introduction": (14, 35), "Results": (35, 46)}
    assert common(spark, "The results of this study indicate that") == [True]
    assert common(spark, "In this study the yield of millet under drip irrigation doubled within three dry seasons near the delta") == [False]
    assert common(spark, "As depicted in", "In summary, our contributions.", "as shown in Figure 3", None, " ", "no phrase at all") == [True, True, True, False, False, False]


def common(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.c for r in df.select("i", profile.common_phrase(F.col("t")).alias("c")).orderBy("i").collect()]


def test_leader_groups_equal_sequential(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (1, 5), (5, 6)]
    lead = {}
    for i in range(1, 7):
        first = next((a for a in range(1, i) if (a, i) in pairs and lead[a] == a), None)
        lead[i] = first or i
    got = web.leader_groups(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(i,) for i in range(1, 7)], "id long"))
    assert {r.id: r.leader for r in got.collect()} == lead


def test_dense_neighbours(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, None)], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.vec_id) for r in dense.top_neighbours(v, 1).collect()]
    assert got == [(0, 1)]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café one two".encode("latin-1"))
    b = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello there</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Accuracy</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>99%</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "b.docx").write_bytes(b.getvalue())
    (tmp_path / "c.xyz").write_text("no")
    (tmp_path / "d.docx").write_text("broken")
    got = {r.filename: (r.full_text, r.error) for r in files.extract(files.scan(spark, str(tmp_path))).collect()}
    assert got["a.txt"][0] == "café one two" and "Accuracy | 99%" in got["b.docx"][0] and got["d.docx"][1] == "BadZipFile" and "c.xyz" not in got


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([(1, 5, "a <b>", 7, 99.0), (1, 2, "x", 7, 80.0)], "doc_id long, sent_idx int, sentence string, source_id long, score double")
    assert [r.match_id for r in sinks.match_export(m).orderBy("sent_idx").collect()] == [1, 2]
    sinks.write_csv(m, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 2
    page = sinks.html_reports(m, spark.createDataFrame([(1, "T")], "doc_id long, title string")).first().html
    assert "a &lt;b&gt;" in page
    t = spark.createDataFrame([("k", "1")], "key string, v string")
    new = spark.createDataFrame([("k", "2"), ("n", "3")], "key string, v string")
    assert {tuple(r) for r in sinks.upsert(t, new, "key").collect()} == {("k", "2"), ("n", "3")}
    assert {tuple(r) for r in sinks.insert_absent(t, new, "key").collect()} == {("k", "1"), ("n", "3")}


def test_stream_deduplicates(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for n in ("a", "b"):
        (src / f"{n}.txt").write_text("same text")
    (src / "c.txt").write_text("other")
    q = intake.deduplicated(intake.file_stream(spark, str(src))).select("file_hash", "full_text").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(out))
    q.awaitTermination(60)
    assert spark.read.parquet(str(out)).count() == 2
