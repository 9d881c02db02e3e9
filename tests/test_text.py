from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papersieve.functions import similarity, text
from papersieve.operators import segment


def test_clean_keeps_words_and_devanagari(spark):
    df = spark.createDataFrame([("  “Hello”, World—42! काम ",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(text.clean_for_analysis(F.col("t"))).collect()]
    assert got == ["hello world 42 काम", "", ""]


def test_fast_sentences_drop_unfinished_lines(spark):
    df = spark.createDataFrame([(1, "Title: Foo\n\nAbstract\nFirst line wraps\nto next. Second one! Tail\nLast one"), (2, None), (3, "")], "id long, t string")
    got = [r.sentence for r in segment.fast_sentences(df, "id", "t").orderBy("sent_idx").collect()]
    assert got == ["to next.", "Second one!", "Last one"]


def test_offsets_and_abbreviations():
    t = "See Dr. Smith and others for the details. Next sentence is here."
    got = segment.split_with_offsets(t)
    assert [s for *_, s in got] == ["See Dr. Smith and others for the details.", "Next sentence is here."]
    assert all(t[a:b].strip() == s for _, a, b, s in got)


def naive_lcs(x, y):
    row = [0] * (len(y) + 1)
    for c in x:
        new = [0]
        for j, d in enumerate(y):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.text("abc ", max_size=25), st.text("abc ", max_size=25))
def test_lcs_and_token_set(x, y):
    assert similarity.lcs_length(x, y) == naive_lcs(x, y)
    assert abs(similarity.token_set_ratio(x, y) - similarity.token_set_ratio(y, x)) < 1e-9


def test_bound_is_upper(spark):
    rows = [("the results of the survey", "results of a survey"), ("alpha beta", "gamma delta"), ("a b c", "a b c d e"), ("", "x"), ("deep learning model", "model learning deep")]
    df = spark.createDataFrame(rows, "x string, y string")
    for r in df.select("x", "y", similarity.token_set_bound(F.col("x"), F.col("y")).alias("b"), similarity.token_set_udf("x", "y").alias("s")).collect():
        assert r.b >= r.s - 1e-9


def test_pair_tfidf_equals_frame(spark):
    df = spark.createDataFrame([(1, "deep learning for text data", "learning text models for data")], "k long, x string, y string")
    a = df.select(similarity.pair_tfidf(F.col("x"), F.col("y"))).first()[0]
    b = similarity.pair_tfidf_frame(df, ["k"], "x", "y").first()["cosine"]
    assert abs(a - b) < 1e-9 and 0 < a < 100


def test_dense_cosine_bounds(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(text.cosine(F.col("a"), F.col("b"))).collect()] == [100.0, 0.0, 0.0]
