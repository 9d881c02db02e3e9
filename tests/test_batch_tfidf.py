from papersieve.functions.similarity import batch_tfidf


def test_nothing_is_broadcast_and_ids_of_two_texts_are_one(spark):
    q = spark.createDataFrame([(1, "yield of millet"), (1, "drip irrigation"), (2, "zz")], "id long, t string")
    c = spark.createDataFrame([(7, "yield of millet"), (7, "drip irrigation"), (8, "drip of wheat"), (9, "")], "id long, t string")
    d = batch_tfidf(q, c, least=20.0)
    got = {(r.q_id, r.c_id): round(r.cosine, 4) for r in d.collect()}
    assert got[1, 7] == 100.0 and set(got) <= {(1, 7), (1, 8)}
    assert "BroadcastHashJoin" not in d._jdf.queryExecution().executedPlan().toString()
