"""The best partners over several blocks: equal to brute force, and only few pairs have their letters compared."""

import random

from papersieve.functions import setjoin
from papersieve.functions.similarity import token_set_ratio


def made():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    ys = [" ".join(rng.sample(words, rng.randint(4, 14))) for _ in range(600)]
    xs = []
    for y in rng.sample(ys, 150):
        w = y.split()
        xs += [" ".join(w[:-1] + [rng.choice(words)]), y.replace("a", "e", 2), " ".join(rng.sample(words, 8))]
    # Strings and words beyond what a byte counts, between others that begin with the same words.
    long = " ".join(words[:70])
    ys += [long, "z" * 300 + " ab cd", "ab", "उपज में वृद्धि हुई और"]
    xs += [long + " more of it", " ".join(words[3:70]), "z" * 300 + " ab ce", "z" * 299 + "y ab cd", "ab cd", "उपज में वृद्धि हुइ और"]
    return sorted(set(xs)), sorted(set(ys), key=len)


def test_best_equals_brute_force(monkeypatch):
    xs, ys = made()
    for name, value in (("MANY", 100), ("OFTEN", 8)):
        monkeypatch.setattr(setjoin, name, value)
    compared, bounds = [], setjoin._rest_bounds
    monkeypatch.setattr(setjoin, "_rest_bounds", lambda p, q, i, j, *a: compared.append(len(i)) or bounds(p, q, i, j, *a))
    for t in (60.0, 80.0):
        want = set()
        for x in xs:
            scored = [(x, y, token_set_ratio(x, y)) for y in ys]
            most = max(r for _, _, r in scored)
            want |= {r for r in scored if r[2] == most >= t}
        best = setjoin.Best(xs, t)
        blocks = [setjoin.Block(ys[k : k + 150], [0.0] * len(ys[k : k + 150])) for k in range(0, len(ys), 150)]
        for q in blocks:
            best.words(q)
        compared.clear()
        for q in blocks:
            best.letters(q)
        assert set(best.rows()) == want and len(want) > 300
    few = sum(compared)
    # Under the threshold alone, without the best that the words have shown, many more are compared.
    compared.clear()
    p = setjoin.Block(xs, [80.0] * len(xs))
    for q in blocks:
        setjoin.compare(p, q)
    assert 5 * few < sum(compared)


def test_best_pairs_only(spark):
    xs, ys = made()
    side = lambda v, c: spark.createDataFrame([(x,) for x in v], f"{c} string")
    got = setjoin.similar_pairs(side(xs[:90], "x"), side(ys, "y"), 60.0, best=True).collect()
    most = {x: max(token_set_ratio(x, y) for y in ys) for x in xs[:90]}
    assert {(r.x, r.y, r.score) for r in got} == {(x, y, m) for x, m in most.items() if m >= 60 for y in ys if token_set_ratio(x, y) == m} and got
