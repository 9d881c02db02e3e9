import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"


def rows(pdf):
    def value(v):
        if v is None or v != v:
            return "null"
        return f"{v:.5g}" if isinstance(v, float) else str(v)

    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(value(v) for v in r) for r in pdf.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    import glob
    import os

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", ["clean_text", "sentence_split", "exact_match_containment", "missing_refs", "unused_refs", "reference_fields", "score_breakdown", "structure_sections", "stylometry", "smart_queries", "tfidf_pair_cosine", "dense_cosine_topk"])
def test_equals_sql(spark, con, name):
    got = __spark_entry__.queries()[name](spark, DATA).toPandas()
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    assert len(got) == len(want) and sorted(got.columns) == sorted(want.columns)
    # Numbers may come as decimals or floats from the other engine.
    num = lambda p: p.apply(lambda c: c.map(lambda v: float(v) if type(v).__name__ in ("Decimal", "int64", "int32", "float64", "int", "float") else v))
    assert rows(num(got)) == rows(num(want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
