import random

from pyspark.sql import functions as F

from papersieve.functions import similarity
from papersieve.operators import match

DOC, SRC = "doc_id long, sent_idx int, sentence string, clean string", "source_id long, sent_idx int, sentence string, clean string"


def test_a_source_sentence_after_many_others_is_found(spark):
    a = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    near = a.replace("kappa", "lambda")
    others = [(5, i, f"other words stand here number {i}", f"other words stand here number {i}") for i in range(40)]
    r = match.semantic_first(spark.createDataFrame([(1, 0, a, a)], DOC), spark.createDataFrame([*others, (6, 3, near, near), (7, 0, a, a)], SRC)).collect()
    assert [(x.source_id, x.src_idx) for x in r] == [(6, 3)]


def test_equal_to_all_pairs(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(14)]

    def near(s):
        w = s.split()
        for _ in range(draw.randint(0, 3)):
            k = draw.randrange(len(w))
            w[k : k + 1] = draw.choice([[], [draw.choice(words)], [w[k], w[k]]])
        return " ".join(w)

    base = [" ".join(draw.choice(words) for _ in range(draw.randint(8, 14))) for _ in range(12)]
    loose = ["a b c d e f g h", "+ a b c d e f g", "a b c d e f g i k"]  # no words of two letters
    mine = [*(near(draw.choice(base)) for _ in range(60)), *loose]
    other = [*(near(draw.choice(base)) for _ in range(60)), "a b c d e f g i", "+ a b c d e f h g"]
    docs = spark.createDataFrame([(i, 0, s, s) for i, s in enumerate(mine)], DOC)
    src = spark.createDataFrame([(i // 3, i % 3, s, s) for i, s in enumerate(other)], SRC)
    got = {r.doc_id: (r.source_id, r.src_idx, r.score) for r in match.semantic_first(docs, src).collect()}
    pairs = docs.where(F.size(F.split("clean", " ")) >= 8).crossJoin(src.select("source_id", F.col("sent_idx").alias("src_idx"), F.col("sentence").alias("o")))
    score = pairs.withColumn("v", similarity.pair_tfidf(F.col("sentence"), F.col("o"))).where("v >= 75").where(similarity.partial_udf("sentence", "o") > match.GATE)
    want = {r.doc_id: (r.m.source_id, r.m.src_idx, round(r.m.v, 1)) for r in score.groupBy("doc_id").agg(F.min(F.struct("source_id", "src_idx", "v")).alias("m")).collect()}
    assert got == want and len(want) > 20 and any(i >= 60 for i in want)


def test_the_gate_is_that_of_the_best_window(spark):
    rows = [("abcd", "xxabxxcd"), ("", ""), ("", "a"), ("abc", "abd"), ("hello there", "he"), ("abcdefgh", "zzzzabczzzz")]
    for gate in (0.0, 50.0, 66.7, 99.0, 100.0):
        r = spark.createDataFrame(rows, "x string, y string").select(similarity.partial_above(gate)("x", "y").alias("a"), (similarity.partial_udf("x", "y") > gate).alias("b")).collect()
        assert all(v.a == v.b for v in r)
