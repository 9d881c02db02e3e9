"""Mixing sources to target shares by Poisson replication.

A document of source s is drawn as often as the inverse of a Poisson distribution says at the document's hash, never
more than max_repeats times. The mean is solved so that the expected capped count equals the wanted repetition rate.
Counts of some seeds are summed in one pass, and each source takes the seed whose drawn size is nearest to its target;
the copies are then shuffled over all partitions by the hash of document, copy and seed.

The total is UTILISATION of the largest mix that no cap forbids. Defined results: documents of sources without a target
are not drawn; a source with a target but without documents has an actual share of 0; null texts have size 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.llm.sizes import sized_documents
from papersieve.session import cut, read_table

UTILISATION = 0.85
SEEDS = 32


def capped_mean(lam: float, cap: int) -> float:
    """E[min(Poisson(lam), cap)] = sum over k < cap of P(count > k)."""
    p, below, total = math.exp(-lam), 0.0, 0.0
    for k in range(cap):
        below += p
        total += 1 - below
        p *= lam / (k + 1)
    return total


def solve_mean(rate: float, cap: int) -> float:
    """The Poisson mean of which the capped mean is the rate."""
    low, high = 0.0, 60.0 + 4 * cap
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, cap) < rate else (low, mid)
    return (low + high) / 2


def thresholds(lam: float, cap: int) -> list[float]:
    """Cumulative probabilities P(count <= k) for k < cap; a uniform number above k of them is drawn k times or more."""
    out, p, below = [], math.exp(-lam), 0.0
    for k in range(cap):
        below += p
        out.append(below)
        p *= lam / (k + 1)
    return out


def _uniform(seed: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id", seed), F.lit(1 << 52)) / F.lit(float(1 << 52))


def plan(docs: DataFrame, targets: DataFrame, total: float | None = None) -> list[dict]:
    """One entry per target source: wanted tokens, thresholds and seed. A table of targets lists sources by name, a plan
    that people write, so it is held on the driver; all of it counts."""
    rows = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).orderBy("source").collect()
    names = [r["source"] for r in rows]
    have = {r["source"]: r["t"] for r in docs.where(F.col("source").isin(names)).groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    live = [r for r in rows if have.get(r["source"], 0) > 0]
    if not live:
        return []
    whole = sum(r["share"] for r in live)
    size = total or UTILISATION * min(r["cap"] * have[r["source"]] / (r["share"] / whole) for r in live)
    out = []
    for r in live:
        want = size * r["share"] / whole
        rate = min(want / have[r["source"]], r["cap"] * 0.999)
        out.append({"source": r["source"], "want": want, "cap": r["cap"], "steps": thresholds(solve_mean(rate, r["cap"]), r["cap"]), "share": r["share"]})
    # The seed of each source, by the drawn sizes of all seeds in one aggregation.
    steps = _steps(out)
    sums = docs.where(F.col("source").isin([p["source"] for p in out])).withColumn("steps", steps).groupBy("source").agg(*(F.sum(F.col("tokens") * _count(F.lit(s))).alias(f"s{s}") for s in range(SEEDS)))
    drawn = {r["source"]: [r[f"s{s}"] or 0 for s in range(SEEDS)] for r in sums.collect()}
    for p in out:
        p["seed"] = min(range(SEEDS), key=lambda s: (abs(drawn[p["source"]][s] - p["want"]), s))
    return out


def _steps(entries: list[dict]) -> Column:
    return F.create_map(*[x for p in entries for x in (F.lit(p["source"]), F.array(*map(F.lit, p["steps"])))])[F.col("source")]


def _count(seed: Column) -> Column:
    u = _uniform(seed)
    return F.size(F.filter("steps", lambda t: t < u))


def draw(docs: DataFrame, entries: list[dict]) -> DataFrame:
    """(source, doc_id, copy_no, tokens, place): the drawn copies in a global random order."""
    empty = docs.select("source", "doc_id", F.lit(0).alias("copy_no"), "tokens", F.lit(0).cast("long").alias("place")).limit(0)
    if not entries:
        return empty
    seeds = F.create_map(*[x for p in entries for x in (F.lit(p["source"]), F.lit(p["seed"]))])[F.col("source")]
    d = docs.where(F.col("source").isin([p["source"] for p in entries])).withColumn("steps", _steps(entries)).withColumn("seed", seeds)
    counted = d.withColumn("n", _count(F.col("seed"))).where("n > 0")
    copies = counted.select("source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"), "tokens", "seed")
    return copies.select("source", "doc_id", "copy_no", "tokens", F.xxhash64("seed", "doc_id", "copy_no").alias("place")).orderBy("place", "doc_id", "copy_no")


def _inputs(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame]:
    return cut(sized_documents(spark, data_dir)), read_table(spark, data_dir, "mix_targets")


def p9_mix(spark: SparkSession, data_dir: str) -> DataFrame:
    docs, targets = _inputs(spark, data_dir)
    return draw(docs, plan(docs, targets))


def p9_shares(spark: SparkSession, data_dir: str) -> DataFrame:
    """(source, target_share, actual_share, tokens, most_repeats): what the mix holds of each target source."""
    docs, targets = _inputs(spark, data_dir)
    mix = draw(docs, plan(docs, targets))
    per = mix.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("copy_no").alias("most_repeats"))
    t = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    per = cut(per)
    total = per.agg(F.sum("tokens")).first()[0] or 1
    j = t.join(per, "source", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return j.select("source", "target_share", F.round(tokens / F.lit(total), 6).alias("actual_share"), tokens.alias("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
