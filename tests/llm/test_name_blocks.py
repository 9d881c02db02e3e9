"""Blocks of names: a very large one costs one round, and what it holds is found."""

import random

from papersieve.llm import names


def test_one_large_block(spark):
    r = random.Random(6)
    given = ["".join(r.choice("abdefgiklmnoprstuv") for _ in range(9)) for _ in range(2000)]
    rows = [(f"C{g} Kagrele",) for g in given] + [("Kagrele, C. D.",), (f"C{given[5]} D. Kagrele",), (f"C{given[5]} Kagrelle",)]
    got = {r.name: r.entity for r in names.resolve(spark.createDataFrame(rows, "name string")).collect()}
    assert len(got) == len(set(rows)) and got[f"C{given[5]} Kagrelle"] == got[f"C{given[5]} D. Kagrele"] == got[f"C{given[5]} Kagrele"]
    assert len(set(got.values())) == 2001


def test_crowded_narrow_blocks_take_turns(spark, monkeypatch):
    rows = [(f"Chetan {c}. Kagrele",) for c in "ABDEFGHIJKLM"] + [("Chetan A. Kagrelle",)]
    whole = {r.name: r.entity for r in names.resolve(spark.createDataFrame(rows, "name string")).collect()}
    monkeypatch.setattr(names, "HUBS", 2)
    split = {r.name: r.entity for r in names.resolve(spark.createDataFrame(rows, "name string")).collect()}
    groups = lambda m: {frozenset(n for n in m if m[n] == e) for e in m.values()}
    assert groups(whole) == groups(split) and frozenset(["Chetan A. Kagrele", "Chetan A. Kagrelle"]) in groups(whole)
