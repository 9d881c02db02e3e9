import duckdb

import __spark_entry__

DATA = "/root/testdata/sf0.001"


def test_every_reference_is_compared(spark):
    got = {(r.ref_id, r.hit_id): r.cosine for r in __spark_entry__.queries()["batch_tfidf"](spark, DATA).collect()}
    con = duckdb.connect()
    for t in ("bib_refs", "scholar_hits"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = {r[:2]: r[2] for r in con.execute(__spark_entry__.oracle_sql()["batch_tfidf"]).fetchall()}
    assert any(ref % 100 for ref, _ in got) and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-3 for k in want)
