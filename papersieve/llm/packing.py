"""Filling fixed-capacity containers: bin completion by branch and bound, in groups of bounded size.

A group holds some GROUP_BINS containers' worth of items. In it the largest open item is completed by undominated
fillings in the order of their waste; branches that can't beat the incumbent (best fit decreasing) by the waste bound are
pruned, and a group that reaches the lower bound of containers is done. The least-filled container of each group is
opened again, and its items join those of the other groups in the next round, so only one badly filled container stays
in the end, however many groups there were. Rounds shrink the items by the factor GROUP_BINS.

An item larger than the capacity is cut into full containers and a rest; no other item is ever split.
Defined results: null and empty texts have size 0 and are placed like others; equal sizes are ordered by id.
"""

from __future__ import annotations

import math
from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.llm.sizes import sized_documents
from papersieve.session import cut, read_table

GROUP_BINS = 48
NODES = 400  # branch-and-bound nodes of one group; the incumbent stands when they are used up
WIDTH = 12  # fillings tried at one node
PARTS = 4096  # parts of the documents to which the kinds of containers are dealt


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing over indices of sizes, in O(n log n)."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins: list[list[int]] = []
    rests: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in order:
        k = bisect_right(rests, (sizes[i], -1))
        if k < len(rests):
            free, b = rests.pop(k)
            bins[b].append(i)
            insort(rests, (free - sizes[i], b))
        else:
            bins.append([i])
            insort(rests, (capacity - sizes[i], len(bins) - 1))
    return bins


def fillings(sizes: list[int], capacity: int, width: int = WIDTH) -> list[tuple[int, ...]]:
    """Undominated completions of the first (largest) of the descending sizes, by increasing waste.

    A filling is dominated if an item outside it fits in place of a smaller one inside. The search takes items in
    descending order, at each step leaving out at most a few, and stops at exact fits first.
    """
    found: dict[tuple[int, ...], int] = {}
    n = len(sizes)
    tail = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        tail[i] = tail[i + 1] + sizes[i]
    budget = [width * 40]

    def first_fit(at: int, free: int) -> int:
        lo, hi = at, n
        while lo < hi:
            mid = (lo + hi) // 2
            if sizes[mid] <= free:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def walk(at: int, free: int, chosen: tuple[int, ...], skips: int) -> None:
        budget[0] -= 1
        if len(found) >= width and min(found.values()) == 0 or budget[0] < 0:
            return
        i = first_fit(at, free)
        if i >= n or tail[i] == 0 and free >= 0 and i < n and sizes[i] == 0:
            rest = chosen + tuple(range(i, n)) if i < n else chosen
            _keep(rest, free)
            return
        # Take the largest that fits, or leave it out in favour of smaller ones (equal sizes are skipped together).
        walk(i + 1, free - sizes[i], chosen + (i,), skips)
        if skips > 0:
            j = i + 1
            while j < n and sizes[j] == sizes[i]:
                j += 1
            if j < n:
                walk(j, free, chosen, skips - 1)

    def _keep(chosen: tuple[int, ...], free: int) -> None:
        inside = set(chosen)
        # Dominance: an outside item x replaces a smaller inside item y if y < x <= y + free.
        for y in chosen[1:]:
            j = first_fit(1, sizes[y] + free)
            while j < n and sizes[j] > sizes[y]:
                if j not in inside:
                    return
                j += 1
        found[chosen] = free

    walk(1, capacity - sizes[0], (0,), 3)
    if not found:
        found[(0,)] = capacity - sizes[0]
    return [c for c, _ in sorted(found.items(), key=lambda kv: (kv[1], kv[0]))[:width]]


def bin_completion(sizes: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Containers (lists of indices) for items of at most the capacity."""
    if not sizes:
        return []
    incumbent = best_fit(sizes, capacity)
    total = sum(sizes)
    lower = max(1, math.ceil(total / capacity))
    if len(incumbent) <= lower:
        return incumbent
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    best = [incumbent]
    left = [nodes]

    def search(rest: list[int], bins: list[list[int]], waste: int) -> bool:
        """True once the lower bound is reached."""
        if not rest:
            if len(bins) < len(best[0]):
                best[0] = [list(b) for b in bins]
            return len(best[0]) <= lower
        # Waste bound: a better solution has one container less, so its whole waste is bounded.
        if waste > (len(best[0]) - 1) * capacity - total or left[0] <= 0:
            return False
        left[0] -= 1
        here = [sizes[i] for i in rest]
        for filling in fillings(here, capacity):
            inside = set(filling)
            free = capacity - sum(here[k] for k in filling)
            if search([i for k, i in enumerate(rest) if k not in inside], bins + [[rest[k] for k in filling]], waste + free):
                return True
            if left[0] <= 0:
                return False
        return False

    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * len(sizes) + 1000))
    search(order, [], 0)
    return best[0]


def pieces(docs: DataFrame, capacities: DataFrame) -> DataFrame:
    """(container, capacity, doc_id, piece, tokens): each document once per container kind; larger ones cut up."""
    c = capacities.where("container is not null and capacity_tokens > 0").select("container", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    # Every document is wanted for each kind of container. The kinds are dealt to parts of the documents by a join on a
    # number of few values, so neither side is broadcast and no number of kinds is left out.
    parts = docs.select("doc_id", "tokens", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part"))
    kinds = c.select("container", "capacity", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    d = parts.join(kinds, "part").select("container", "capacity", "doc_id", "tokens")
    n = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity"))).cast("int")
    cutup = d.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    return cutup.select("container", "capacity", "doc_id", "piece", F.least("capacity", F.col("tokens") - F.col("piece") * F.col("capacity")).alias("tokens"))


def _round(items: DataFrame, groups: dict[str, int], r: int) -> DataFrame:
    """Packs the items of each group: (container, capacity, doc_id, piece, tokens, bin, open)."""
    count = F.create_map(*[x for k, g in groups.items() for x in (F.lit(k), F.lit(g))])
    keyed = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", F.lit(r)), count[F.col("container")]).cast("int"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        container, grp = key
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        capacity = int(pdf["capacity"].iloc[0])
        sizes = pdf["tokens"].tolist()
        bins = bin_completion(sizes, capacity)
        fill = [sum(sizes[i] for i in b) for b in bins]
        worst = min(range(len(bins)), key=lambda b: (fill[b], b))
        names, opened = [None] * len(sizes), [False] * len(sizes)
        for b, members in enumerate(bins):
            for i in members:
                names[i] = f"{container}-{r}-{grp}-{b}"
                opened[i] = b == worst
        return pdf[["container", "capacity", "doc_id", "piece", "tokens"]].assign(bin=names, open=opened)

    return keyed.groupBy("container", "grp").applyInPandas(pack, "container string, capacity long, doc_id long, piece int, tokens long, bin string, open boolean")


def assign(docs: DataFrame, capacities: DataFrame) -> DataFrame:
    """(container, bin, doc_id, piece, tokens) of all documents for all container kinds."""
    items = cut(pieces(docs, capacities))
    # A piece as large as the container is one by itself.
    full = items.where("tokens = capacity").withColumn("bin", F.concat_ws("-", "container", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece").cast("string")))
    done = [full.select("container", "bin", "doc_id", "piece", "tokens")]
    rest, r = items.where("tokens < capacity"), 0
    while True:
        sums = rest.groupBy("container").agg(F.sum(F.col("tokens") / F.col("capacity")).alias("bins")).collect()
        groups = {x["container"]: max(1, math.ceil((x["bins"] or 0) / GROUP_BINS)) for x in sums}
        if not groups:
            break
        packed = cut(_round(rest, groups, r))
        last = all(g == 1 for g in groups.values())
        single = [k for k, g in groups.items() if g == 1]
        # Kinds of which all items were in one group are done.
        closed = packed.where(~F.col("open") | F.col("container").isin(single))
        done.append(closed.select("container", "bin", "doc_id", "piece", "tokens"))
        if last:
            break
        rest, r = packed.where(F.col("open") & ~F.col("container").isin(single)).select("container", "capacity", "doc_id", "piece", "tokens"), r + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def p8_assignment(spark: SparkSession, data_dir: str) -> DataFrame:
    return assign(sized_documents(spark, data_dir), read_table(spark, data_dir, "pack_capacities"))


def p8_fill(spark: SparkSession, data_dir: str) -> DataFrame:
    """(container, bins, tokens, lower_bound, fill): how well each kind of container is used."""
    caps = read_table(spark, data_dir, "pack_capacities").select("container", "capacity_tokens")
    a = p8_assignment(spark, data_dir).groupBy("container", "bin").agg(F.sum("tokens").alias("t")).groupBy("container").agg(F.count("*").alias("bins"), F.sum("t").alias("tokens"))
    x = a.join(caps, "container")
    return x.select("container", "bins", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("lower_bound"), F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6).alias("fill"))
