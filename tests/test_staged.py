from papersieve.functions.similarity import token_set_ratio
from papersieve.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_staged_scores_equal_brute_force(spark):
    docs, src = catalog.doc_sentences(spark, DATA).where("doc_id < 20"), catalog.source_sentences(spark, DATA)
    clean = [r.clean for r in src.select("clean").distinct().collect()]
    want = {}
    for r in docs.collect():
        exact = any(r.clean in c or c in r.clean for c in clean)
        kind = "exact" if exact else "fuzzy" if any(token_set_ratio(r.clean, c) >= 80 for c in clean) else None
        if kind:
            want.setdefault(r.doc_id, []).append(kind)
    got = catalog.queries()["staged_score_breakdown"](spark, DATA).where("doc_id < 20").collect()
    assert {r.doc_id: (r.exact_count, r.fuzzy_count) for r in got} == {r.doc_id: (want.get(r.doc_id, []).count("exact"), want.get(r.doc_id, []).count("fuzzy")) for r in got}
    assert sum(r.fuzzy_count for r in got) > 0
