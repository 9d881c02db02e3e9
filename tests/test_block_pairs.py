"""Comparison of two blocks of strings: nothing is lost, and with best only the best by words goes on."""

import numpy as np

from papersieve.functions import setjoin
from papersieve.functions.similarity import token_set_ratio


def test_blocks_equal_brute_force():
    words = [f"w{k}" for k in range(95)]
    xs = ["उपज में वृद्धि हुई", "yield of millet under drip", "drip of millets under yields", "\ud800 b", " ".join(words[:90]), "aa " * 30 + "b c"]
    ys = ["उपज में वृद्धि हुइ", "millet under drip yield", "milets undr drips yeild", "\ud800 c", " ".join(words[5:]), "c d e aa b"]
    for t in (60.0, 80.0, 95.0):
        p, q = setjoin.Block(xs, [t] * len(xs)), setjoin.Block(ys, [0.0] * len(ys))
        want = {(x, y) for x in xs for y in ys if token_set_ratio(x, y) >= t}
        assert {r[:2] for r in setjoin.by_words(p, q, False)} | set(setjoin.compare(p, q)) == want and want


def test_only_the_best_by_words_goes_on():
    x = "yield of millet under drip irrigation"
    ys = [f"{x} {'z' * 8}", f"yield of millet under drip {'y' * 8}", f"{'q' * 9} {x}", f"yield of millet under {'y' * 9}"]
    p, q = setjoin.Block([x], [70.0]), setjoin.Block(ys, np.zeros(4).tolist())
    assert len(setjoin.by_words(p, q, False)) == 4
    assert {y for _, y, _ in setjoin.by_words(p, q, True)} == {ys[0], ys[2]}
