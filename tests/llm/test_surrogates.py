"""Surrogates of personal information, and the gates before the patterns."""

import random
import re

from papersieve.llm import personal


def test_gates_cover_their_patterns():
    r = random.Random(3)
    bits = ["jan.lee", " at ", "\nat ", " AT\n", "[at]", "( at )", "mail", " dot ", "\ndot ", " DOT ", "org", "x@y.de", "Lindenweg", "Hauptstraße", " ", "\n", " ", "12", "5", ", ", ",\n", "53111", "Bonn", "20, rue", "avenue", "Sol", "Calle", "Flat 3",
            "+91", ".", "-", "50", "43", "27072", "(0528)", "571965", "01", "23", "45", "67", "89", "X3252786", "ABCDE1234F", "2020MBA83346", "123-45-6789", "५७४०", "९०२७६५", "The student ", "Asha Rao", ", ", "Guide: ", "thank ", " for ", "é"]
    for _ in range(4000):
        t = "".join(r.choice(bits) for _ in range(r.randint(2, 14)))
        if personal.EMAIL.search(t):
            assert "@" in t or personal._HIDDEN_AT.search(t), t
        if personal.ID.search(t) or personal.PHONE.search(t):
            assert personal._DIGITS.search(t), t
        for words, pattern in (*personal.ADDRESSES, *personal.INTRO):
            assert not pattern.search(t) or any(w in t for w in words), t
    for t in ("jan.lee at\nmail dot org", "Lindenweg\n12, 53111 Bonn"):
        assert personal.spans(t)


def test_names_move_together_and_stay_distinct(spark):
    names = ["Edith Menk", "Edith B. Menk", "MENK Edith", "Priya Rao", "Anna-Lena Rao", "Rahul Rao", "Ruth Menk", "R. Menk", "Q. Menk", "आशा मोरनाथ", "राहुल मोरनाथ", "Edith Mohk"]
    rows = [("NAME", n) for n in names] + [("EMAIL", "a.b@c.test"), ("EMAIL", "A.B@c.test"), ("PHONE", "+91 50437 27072"), ("ID", "X3252786"), ("ADDRESS", "Lindenweg 12, 53111 Bonn")]
    got = {(r.pii_kind, r.pii_text): r.surrogate for r in personal.surrogates(spark.createDataFrame(rows, "pii_kind string, pii_text string")).collect()}
    assert len(got) == len(rows)
    s = {n: got["NAME", n].split(" ") for n in names}
    assert s["Edith Menk"] == [s["Edith B. Menk"][0], s["Edith B. Menk"][2]] and [w.casefold() for w in s["MENK Edith"]] == [w.casefold() for w in s["Edith Menk"][::-1]]
    assert s["MENK Edith"][0].isupper() and s["R. Menk"][0] != s["Q. Menk"][0] and len({" ".join(x).casefold() for x in s.values()}) == len(names)
    assert all(w[-1] == "a" for w in (s["Priya Rao"][0], s["Edith Menk"][0])) and s["Rahul Rao"][0][-1] != "a" and "-" in s["Anna-Lena Rao"][0]
    assert all("ऀ" < c <= "ॿ" for c in "".join(s["आशा मोरनाथ"]))
    assert got["EMAIL", "a.b@c.test"].casefold() == got["EMAIL", "A.B@c.test"].casefold() != "a.b@c.test"
    assert re.fullmatch(r"\+91 \d{5} \d{5}", got["PHONE", "+91 50437 27072"]) and re.fullmatch(r"[A-Z]\d{7}", got["ID", "X3252786"]) and re.fullmatch(r"\w+weg \d\d, \d{5} \w+", got["ADDRESS", "Lindenweg 12, 53111 Bonn"])


def test_very_many_names_stay_distinct_without_a_mark(spark):
    n = 100_000
    latin = spark.range(n).selectExpr("'NAME' AS pii_kind", "concat('Asha ', initcap(translate(cast(id AS string), '0123456789', 'abcdefghij')), 'ko') AS pii_text")
    dev = spark.range(n).selectExpr("'NAME' AS pii_kind", "concat('आशा ', translate(cast(id AS string), '0123456789', 'कगजटतदनपबम')) AS pii_text")
    s = personal.surrogates(latin.unionByName(dev))
    assert s.select("surrogate").distinct().count() == s.count() == 2 * n
    assert s.where("surrogate rlike '[\\\\[0-9]'").count() == 0


def test_texts_with_surrogates(spark):
    t = "The student Edith Menk, registration X3252786, declares this. I thank Edith Menk for help."
    out = {r.doc_id: r.text for r in personal.with_surrogates(spark.createDataFrame([(1, t), (2, None), (3, ""), (4, "plain")], "doc_id long, text string")).collect()}
    assert out[2] is None and out[3] == "" and out[4] == "plain" and "Menk" not in out[1] and "X3252786" not in out[1]
    name = re.match(r"The student (\S+ \S+),", out[1]).group(1)
    assert out[1].count(name) == 2
