"""Long exact spans shared between records: seed on winnowed anchors, extend both ways, keep maximal repeats.

Every span of MIN_SPAN characters or more holds at least one anchor (k + w - 1 = MIN_SPAN), so no pair is lost.
Records with the same text are one class; classes are matched and the pairs are expanded over the members at the end.

An anchor that many classes share is split instead of paired: a long span over it must go on far enough to its left or
to its right, so it is keyed again by the longer k-gram on either side, and those still hot by every window of the full
length that covers them. Pairs of a hot full window are results by themselves; windows with the same set of classes
are emitted once.

Defined results: null texts and texts shorter than the threshold have no pairs and a share of 0; repeated rows count
once; a record is never paired with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.llm.winnow import anchors
from papersieve.session import cut, read_table, spread

MIN_SPAN = 200
SEED = 80
HOT = 48  # classes on one anchor above which it is split, not paired


def records(spark: SparkSession, data_dir: str) -> DataFrame:
    """(rec, text) of both text tables; repeated rows stay and fall together with their class."""
    s = read_table(spark, data_dir, "sources").select(F.concat(F.lit("S"), F.col("source_id").cast("string")).alias("rec"), F.col("text_content").alias("text"))
    x = read_table(spark, data_dir, "extracted_docs").select(F.concat(F.lit("X"), F.col("ext_id").cast("string")).alias("rec"), F.col("full_text").alias("text"))
    return s.unionByName(x).where(F.col("rec").isNotNull())


def classes(recs: DataFrame, min_span: int) -> tuple[DataFrame, DataFrame]:
    """(cls, text) with one row per distinct text, told apart by its SHA-256 and numbered, and (cls, rec) membership."""
    keyed = recs.where(F.length("text") >= min_span).withColumn("id", F.unhex(F.sha2("text", 256)))
    texts = cut(keyed.groupBy("id").agg(F.min("text").alias("text")).withColumn("cls", F.monotonically_increasing_id()))
    return texts.select("cls", "text"), keyed.select("id", "rec").distinct().join(texts.select("id", "cls"), "id").select("cls", "rec")


def _seeds(texts: DataFrame, k: int, w: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cls, pos, hs = [], [], []
            for c, t in zip(pdf["cls"], pdf["text"]):
                p, h = anchors(t, k, w)
                cls.append(np.full(len(p), c, np.int64))
                pos.append(p)
                hs.append(h.view(np.int64))
            if cls:
                yield pd.DataFrame({"cls": np.concatenate(cls), "pos": np.concatenate(pos).astype(np.int32), "h": np.concatenate(hs)})

    return spread(texts, "cls").mapInPandas(run, "cls long, pos int, h long")


def _counted(keys: DataFrame, *by: str) -> DataFrame:
    return keys.groupBy(*by).agg(F.count_distinct("cls").alias("n")).where("n > 1")


def _wider(hot: DataFrame, texts: DataFrame, k: int, min_span: int) -> DataFrame:
    """Left and right k-grams of the middle length around hot anchors: (cls, pos, at, h); at = start of the longer gram."""
    half = (min_span - k + 1) // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for c, t, ps in zip(pdf["cls"], pdf["text"], pdf["ps"]):
                for p in ps:
                    p = int(p)
                    for a in (p - half, p):
                        if a >= 0 and a + k + half <= len(t):
                            out.append((c, p, a, xxhash.xxh3_64_intdigest(t[a : a + k + half].encode("utf-8", "surrogatepass")) - 2**63))
            yield pd.DataFrame(out, columns=["cls", "pos", "at", "h"])

    return hot.groupBy("cls").agg(F.collect_set("pos").alias("ps")).join(texts, "cls").mapInPandas(run, "cls long, pos int, at int, h long")


def _windows(hot: DataFrame, texts: DataFrame, gram: int, min_span: int) -> DataFrame:
    """Every full-length window over hot middle grams: (cls, at, key)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c, t, ats in zip(pdf["cls"], pdf["text"], pdf["ats"]):
                starts = sorted({a for at in ats for a in range(max(0, int(at) + gram - min_span), min(int(at), len(t) - min_span) + 1)})
                if starts:
                    yield pd.DataFrame({"cls": c, "at": np.array(starts, np.int32), "key": [xxhash.xxh3_128_hexdigest(t[a : a + min_span].encode("utf-8", "surrogatepass")) for a in starts]})

    return hot.groupBy("cls").agg(F.collect_set("at").alias("ats")).join(texts, "cls").mapInPandas(run, "cls long, at int, key string")


def _paired(keys: DataFrame, counts: DataFrame, by: str) -> DataFrame:
    """Pairs of places on keys that at most HOT classes share."""
    left = keys.join(counts.where(F.col("n") <= HOT).select(by), by)
    right = left.select(by, F.col("cls").alias("cls_b"), F.col("pos").alias("pos_b"))
    return left.join(right, by).where(F.col("cls") < F.col("cls_b")).select(F.col("cls").alias("cls_a"), "cls_b", F.col("pos").alias("pos_a"), "pos_b")


def _common(x: str, y: str) -> int:
    """Length of the common prefix, by doubling slices."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n:
        if x[at : at + step] == y[at : at + step]:
            at += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 4)
    return min(at, n)


def maximal_repeats(a: str, b: str, seeds: list[tuple[int, int]], k: int, min_span: int) -> list[tuple[int, int, int]]:
    """(start_a, start_b, length) of the maximal common spans over the seeds."""
    out, covered = [], {}
    for pa, pb in sorted(seeds):
        diagonal = pa - pb
        if covered.get(diagonal, -1) >= pa or a[pa : pa + k] != b[pb : pb + k]:
            continue
        left = _common(a[:pa][::-1], b[:pb][::-1])
        right = _common(a[pa:], b[pb:])
        covered[diagonal] = pa + right
        if left + right >= min_span:
            out.append((pa - left, pb - left, left + right))
    return out


def _verified(pairs: DataFrame, texts: DataFrame, k: int, min_span: int) -> DataFrame:
    """(cls_a, cls_b, start_a, start_b, length) for the maximal repeats of candidate pairs."""
    grouped = pairs.groupBy("cls_a", "cls_b").agg(F.collect_set(F.struct("pos_a", "pos_b")).alias("seeds"))
    both = grouped.join(texts.select(F.col("cls").alias("cls_a"), F.col("text").alias("ta")), "cls_a").join(texts.select(F.col("cls").alias("cls_b"), F.col("text").alias("tb")), "cls_b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ca, cb, seeds, ta, tb in zip(pdf["cls_a"], pdf["cls_b"], pdf["seeds"], pdf["ta"], pdf["tb"]):
                rows += [(ca, cb, *m) for m in maximal_repeats(ta, tb, [(s["pos_a"], s["pos_b"]) for s in seeds], k, min_span)]
            yield pd.DataFrame(rows, columns=["cls_a", "cls_b", "start_a", "start_b", "length"])

    return both.mapInPandas(run, "cls_a long, cls_b long, start_a int, start_b int, length int")


def shared_spans(texts: DataFrame, min_span: int = MIN_SPAN, k: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Maximal repeats between classes, (cls_a, cls_b, start_a, start_b, length), and the windows of hot passages,
    (cls, at, key), whose classes share them pairwise."""
    seeds = cut(_seeds(texts, k, min_span - k + 1))
    counts = cut(_counted(seeds, "h"))
    hot = seeds.join(counts.where(F.col("n") > HOT).select("h"), "h").select("cls", "pos")
    wide = cut(_wider(hot, texts, k, min_span))
    wide_counts = cut(_counted(wide, "h"))
    gram = k + (min_span - k + 1) // 2
    hot_wide = wide.join(wide_counts.where(F.col("n") > HOT).select("h"), "h").select("cls", "at")
    windows = cut(_windows(hot_wide, texts, gram, min_span))
    wide_pairs = _paired(wide.select("h", "cls", F.col("at").alias("pos")), wide_counts, "h")
    pairs = _paired(seeds, counts, "h").unionByName(wide_pairs).distinct()
    return cut(_verified(pairs, texts, k, min_span)), windows


def _hot_pairs(windows: DataFrame) -> DataFrame:
    """Pairs of the classes on hot windows; windows with one and the same set of classes are emitted once."""
    member = windows.select("key", "cls").distinct()
    sets = member.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("cls"), 16)).alias("s"), F.bit_xor(F.xxhash64("cls", F.lit(7))).alias("x")).where("n > 1")
    one = sets.groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key")
    m = member.join(one, "key")
    return m.select("key", F.col("cls").alias("cls_a")).join(m.select("key", F.col("cls").alias("cls_b")), "key").where("cls_a < cls_b").select("cls_a", "cls_b").distinct()


def _ordered(x: Column, y: Column) -> tuple[Column, Column]:
    return F.least(x, y).alias("rec_a"), F.greatest(x, y).alias("rec_b")


def found(recs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """(rec_a, rec_b), smaller first: the records that share a verbatim span of min_span characters or more."""
    texts, members = classes(recs, min_span)
    spans, windows = shared_spans(texts, min_span)
    pairs = spans.select("cls_a", "cls_b").unionByName(_hot_pairs(windows)).distinct()
    a, b = (members.select(F.col("cls").alias(f"cls_{s}"), F.col("rec").alias(f"r_{s}")) for s in "ab")
    across = pairs.join(a, "cls_a").join(b, "cls_b").select(*_ordered(F.col("r_a"), F.col("r_b")))
    two = members.alias("m").join(members.alias("o"), "cls").where("m.rec < o.rec").select(F.col("m.rec").alias("rec_a"), F.col("o.rec").alias("rec_b"))
    return across.unionByName(two).where("rec_a <> rec_b").distinct()


def shares(recs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """(rec, n_chars, shared_chars, shared_part): per record, how much of its text recurs in another record."""
    texts, members = classes(recs, min_span)
    spans, windows = shared_spans(texts, min_span)
    n_in = members.groupBy("cls").agg(F.count("*").alias("n_members"))
    hot_keys = windows.groupBy("key").agg(F.count_distinct("cls").alias("n")).where("n > 1").select("key")
    parts = (
        spans.select(F.col("cls_a").alias("cls"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("length")).alias("e"))
        .unionByName(spans.select(F.col("cls_b").alias("cls"), F.col("start_b").alias("s"), (F.col("start_b") + F.col("length")).alias("e")))
        .unionByName(windows.join(hot_keys, "key").select("cls", F.col("at").alias("s"), (F.col("at") + min_span).alias("e")))
        .distinct()
    )
    # Union of intervals per class: fold the sorted starts, adding what lies beyond the furthest end so far.
    merged = parts.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("p")).select(
        "cls",
        F.aggregate("p", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda acc, x: F.struct((acc.n + F.greatest(F.lit(0), x.e - F.greatest(x.s, acc.to))).alias("n"), F.greatest(acc.to, x.e).alias("to")))["n"].alias("shared"),
    )
    per = members.join(n_in, "cls").join(merged, "cls", "left").select("rec", F.col("n_members"), F.coalesce("shared", F.lit(0)).alias("shared"))
    per = per.groupBy("rec").agg(F.max("n_members").alias("n_members"), F.max("shared").alias("shared"))
    sizes = recs.groupBy("rec").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"))
    shared = F.when(F.col("n_members") > 1, F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0)))
    return sizes.join(per, "rec", "left").select("rec", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).otherwise(F.lit(0.0)).alias("shared_part"))


def p2_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return found(records(spark, data_dir))


def p2_shared_part(spark: SparkSession, data_dir: str) -> DataFrame:
    return shares(records(spark, data_dir))


def found_classes(recs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """(cls, rec, n_members, n_links): every record with the class of its text, named by its smallest record, and the number
    of other classes that share a long span with it; copies are not expanded into pairs. Records too short have none."""
    texts, members = classes(recs, min_span)
    spans, windows = shared_spans(texts, min_span)
    pairs = spans.select("cls_a", "cls_b").unionByName(_hot_pairs(windows)).distinct()
    links = pairs.select(F.col("cls_a").alias("cls")).unionByName(pairs.select(F.col("cls_b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("n_links"))
    size = members.groupBy("cls").agg(F.min("rec").alias("name"), F.count("*").alias("n_members"))
    return members.join(size, "cls").join(links, "cls", "left").select(F.col("name").alias("cls"), "rec", "n_members", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p2_classes(spark: SparkSession, data_dir: str) -> DataFrame:
    return found_classes(records(spark, data_dir))
