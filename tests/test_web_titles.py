from papersieve.functions.similarity import token_set_ratio
from papersieve.operators import web

TITLES = [
    "Yield of millet under drip irrigation in dry seasons", "Library price index and energy use", "Yeild of milet under drip irigation in dry seasons",
    "Yield of millet under drip irrigation", "[PDF] library price index and energy use", "A wholly other matter", "yield of millet under drip irrigation in dry seasons", " ", " ",
    "Libary prise indecs and enerdgy uze", "Priice indx for energi of librarys in use", None,
]


def test_title_groups_equal_sequential(spark):
    lead = {}
    for i, t in enumerate(TITLES):
        if t is not None:
            lead[i] = next((a for a in range(i) if lead.get(a) == a and token_set_ratio(TITLES[a].lower(), t.lower()) > 85), i)
    hits = spark.createDataFrame(list(enumerate(TITLES)), "hit_id long, title string")
    assert {r.id: r.leader for r in web.title_groups(hits).collect()} == lead
    assert lead[2] == lead[3] == lead[6] == 0 and lead[4] == 1


def test_search_status_equals_brute_force(spark):
    hits = [(i, t, 2001) for i, t in enumerate(TITLES)]
    refs = [(1, "Libary prise indeks and enerdgy uze", 2001), (2, "Yield of millet under drip irrigation", 2009), (3, "Wholesale matters of others", 2001), (4, "milet yeild under drip irigation dry saesons in the", 2001), (5, None, 2001), (6, "Libery prais indecks ant enargy uses", 2001)]
    want = {}
    for r, t, y in refs:
        top = max((-1, 0), *((s, -h) for h, x, _ in hits if x and t and (s := token_set_ratio(t.lower(), x.lower())) >= 70), (-1, 0))
        want[r] = "NOT VERIFIED" if top[0] < 0 else "SUSPICIOUS" if top[0] < 85 else "PARTIALLY VERIFIED" if abs(y - 2001) > 1 else "VERIFIED", -top[1] if top[0] >= 85 else None
    got = web.search_status(spark.createDataFrame(refs, "ref_id long, title string, year int"), spark.createDataFrame(hits, "hit_id long, title string, year int"))
    assert {r.ref_id: (r.status, r.hit_id) for r in got.collect()} == want
    # All words of these differ from those of the hit they are like.
    assert want[6][0] == "SUSPICIOUS"
