import random

import numpy as np

from papersieve.functions import setjoin
from papersieve.functions.similarity import lcs_length, token_set_ratio
from papersieve.operators import match


def typed(rng, s, edits):
    for _ in range(edits):
        k = rng.randrange(len(s))
        s = s[:k] + rng.choice(["", s[k] + rng.choice("abcdefgh"), rng.choice("mnop ")]) + s[k + 1 :]
    return " ".join(s.split())


def made(seed, n):
    """Sentences, and others with typos in every word, words left out, put in and in another order."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(120)]
    ys = [" ".join(rng.choices(words, k=rng.randint(4, 14))) for _ in range(n)] + ["उपज में वृद्धि हुई और", "x", "a\u00a0b c"]
    xs = []
    for y in ys:
        w = y.split()
        rng.shuffle(w)
        xs += [typed(rng, y, rng.randint(1, 12)), " ".join(w[: len(w) * 2 // 3] + rng.choices(words, k=3)), " ".join(w[:2] + rng.choices(words, k=12))]
    return sorted({x for x in xs if x}), sorted(set(ys))


def test_similar_pairs_equal_brute_force(spark):
    xs, ys = made(3, 70)
    side = lambda v, c: spark.createDataFrame([(x,) for x in v], f"{c} string")
    for t in (70.0, 80.0, 85.0):
        want = {(x, y): r for x in xs for y in ys if (r := token_set_ratio(x, y)) >= t}
        got = {(r.x, r.y): r.score for r in setjoin.similar_pairs(side(xs, "x"), side(ys, "y"), t).collect()}
        assert got == want and len(want) > 50
    top = {x: max(r for (a, _), r in want.items() if a == x) for x, _ in want}
    got = {(r.x, r.y) for r in setjoin.similar_pairs(side(xs, "x"), side(ys, "y"), t, best=True).collect()}
    assert {k for k, r in want.items() if r == top[k[0]]} <= got <= set(want)


def test_bounds_of_subsequences():
    xs, ys = made(5, 40)
    left, right = xs[: len(ys)], ys[: len(xs)]
    assert (setjoin.lcs_bounds(left, right) >= np.array([lcs_length(a, b) for a, b in zip(left, right)])).all()


def test_fuzzy_best_finds_a_partner_whose_rare_words_differ(spark):
    # The two rarest words of the document's sentence are those it has in common with another source sentence.
    docs = spark.createDataFrame([(1, 0, "zq xv the method improves the accuracy of large models")], "doc_id long, sent_idx int, clean string")
    src = spark.createDataFrame(
        [(7, 0, "the method improves the accuracy of large models"), (8, 0, "the method of large models and the accuracy improves little"), (9, 0, "zq xv and other things of no matter at all")],
        "source_id long, sent_idx int, clean string",
    )
    assert [(r.source_id, r.score) for r in match.fuzzy_best(docs, src).collect()] == [(7, 100.0)]
