"""The search of sentence spans: equal to an exhaustive one, and linear in the length of a paragraph."""

import random
import time

from papersieve.llm import sentences as s


def exhaustive(block: str) -> float:
    """Score of the best covering when every candidate cut and every span is tried."""
    b = s._Block(block)
    cuts = [(p, v) for p, v in sorted(s._candidates(b).items()) if 0 < p < len(block) and block[p:].strip()] + [(len(block), 0.0)]
    starts = [(0, 0.0)] + cuts[:-1]
    at, depth, lone, quotes = s._brackets(block)
    best = [0.0] + [float("-inf")] * len(cuts)
    for j, (end, gain) in enumerate(cuts, 1):
        for i in range(j):
            text = block[starts[i][0] : end].strip()
            if best[i] == float("-inf") or not text:
                continue
            head = starts[i][0] + len(block[starts[i][0] :]) - len(block[starts[i][0] :].lstrip())
            k, m = sum(x < head for x in at), sum(x < end for x in at)
            bad = depth[k] + depth[m] - 2 * min(depth[k : m + 1]) + lone[m] - lone[k] + (quotes[m] - quotes[k]) % 2
            opening = 0.0 if not i else -2.0 if b.lower_start(head) else -4.0 if block[head] in ",;:)]）」”»" else 0.0
            best[j] = max(best[j], best[i] + gain + opening + s._length_score(len(text)) - 5.0 * min(3, bad))
    return best[-1]


def score_of(block: str, spans: list[tuple[int, int]]) -> float:
    b = s._Block(block)
    found = s._candidates(b)
    at, depth, lone, quotes = s._brackets(block)
    total = 0.0
    for x, (a, e) in enumerate(spans):
        k, m = sum(p < a for p in at), sum(p < e for p in at)
        bad = depth[k] + depth[m] - 2 * min(depth[k : m + 1]) + lone[m] - lone[k] + (quotes[m] - quotes[k]) % 2
        opening = 0.0 if not x else -2.0 if b.lower_start(a) else -4.0 if block[a] in ",;:)]）」”»" else 0.0
        total += (found[e] if x + 1 < len(spans) else 0.0) + opening + s._length_score(e - a) - 5.0 * min(3, bad)
    return total


def test_search_equals_exhaustive_search():
    r = random.Random(5)
    words = ["Yes", "no", "U.S.", "Dr.", "etc.", "(so", "that)", '"Go', 'on"', "„Nun", "ja“", "A.", "3.5", "end.", "end!", "End?", "कम.", "1", "॥", "「はい。」", "と。", "x" * 150, "...", "[so]", "« oui »", "ไทย", "ครับ"]
    for _ in range(300):
        block = " ".join(r.choice(words) for _ in range(r.randint(1, 40)))
        spans = s._block_spans(block)
        assert spans == sorted(spans) and "".join(block[a:e] for a, e in spans).replace(" ", "") == block.replace(" ", "")
        assert abs(score_of(block, spans) - exhaustive(block)) < 1e-9, block


def test_long_paragraphs_take_linear_time():
    for text in ("a.b.c.d." * 12_500, "A. B. " * 17_000, "1." * 50_000, "(" * 50_000 + ". A" * 16_000, '"Yes. No. ' * 10_000):
        began = time.process_time()
        assert s.sentence_spans(text)
        assert time.process_time() - began < 3


def test_blank_and_null_texts_have_no_sentence():
    assert s.sentence_spans(None) == s.sentence_spans("") == s.sentence_spans(" \n\n ") == []
