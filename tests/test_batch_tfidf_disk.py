import random
import time

import numpy as np
import pytest

from papersieve.functions import gramjoin, similarity


def written(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    time.sleep(0.5)
    return sc.statusStore().executorList(True).head().totalShuffleWrite()


def test_pairs_below_the_threshold_are_not_written(spark, monkeypatch):
    monkeypatch.setattr(gramjoin, "BLOCK", 170)
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(draw.choice(words) for _ in range(10))
    mine, theirs = [text() for _ in range(400)], [text() for _ in range(390)]
    theirs += [f"{m} {draw.choice(words)}" for m in mine[:10]]
    q, c = (spark.createDataFrame(list(enumerate(t)), "id long, t string") for t in (mine, theirs))
    before = written(spark)
    got = {(r.q_id, r.c_id): r.cosine for r in similarity.batch_tfidf(q, c, least=50.0).collect()}
    assert written(spark) - before < 1_000_000
    bags = [gramjoin.text_grams(t) for t in mine + theirs]
    number = {g: i for i, g in enumerate(sorted({g for b in bags for g in b}))}
    m = np.zeros((len(bags), len(number)))
    for i, b in enumerate(bags):
        for g in b:
            m[i, number[g]] += 1
    m *= np.log((1 + len(bags)) / (1 + (m > 0).sum(0))) + 1
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cosine = 100 * m[:400] @ m[400:].T
    want = {(int(i), int(j)): cosine[i, j] for i, j in zip(*np.nonzero(cosine >= 50))}
    assert got.keys() == want.keys() and len(want) >= 10 and got == pytest.approx(want)
