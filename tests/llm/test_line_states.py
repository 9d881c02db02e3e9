"""Line states of scanned pages: codes, paths, and breaks that the layout shows."""

import numpy as np

from papersieve.llm import scans


def test_codes_and_blank_lines():
    codes = scans.line_codes("First line of it\n\nsecond line goes on here", None)
    assert codes[1] == scans.BLANK and (codes[[0, 2]] >= 0).all() and codes.max() < scans.CODES
    assert list(scans.line_codes("", None)) == [scans.BLANK]
    d = scans._digits()
    assert d["begin"][codes[2]] == 0 and d["edge"][codes[0]] == 1


def test_path_is_the_best_one():
    r = np.random.default_rng(2)
    model = scans.LineModel(r.integers(0, 5, (3, scans.CODES)).astype(float), r.integers(1, 9, (4, 4)).astype(float))
    for _ in range(20):
        codes = np.where(r.random(5) < 0.2, -1, r.integers(0, scans.CODES, 5))
        best = None
        for k in range(4**5):
            path = [k // 4**i % 4 for i in range(5)]
            if any((c < 0) != (s == 3) for c, s in zip(codes, path)):
                continue
            score = sum(model.move[a, b] for a, b in zip([3, *path], path)) + sum(model.score[s, c] for s, c in zip(path, codes) if c >= 0)
            best = max(best, (score, path)) if best else (score, path)
        got = model.path(codes)
        score = sum(model.move[a, b] for a, b in zip([3, *got], got)) + sum(model.score[s, c] for s, c in zip(got, codes) if c >= 0)
        assert abs(score - best[0]) < 1e-9


def test_a_break_without_a_blank_line(spark):
    one = ["The first part of the text is set in full lines here and goes", "on for some more words until at last it comes to an end", "quite early."]
    two = ["Another part begins with this line, which is again a full one", "and it also ends with a short line."]
    rows = [(i, "\n".join(one + two + one + two), None) for i in range(40)] + [(99, "", None), (98, None, None)]
    df = spark.createDataFrame(rows, "ext_id long, text string, starts array<int>").where("text is not null")
    p = [r.text for r in scans.paragraphs(df).where("ext_id = 3").orderBy("paragraph_no").collect()]
    assert len(p) == 4 and p[0].endswith("quite early.") and p[1].startswith("Another part")
