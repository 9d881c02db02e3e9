"""Scholarly hits: de-duplication, classification, verification of references, grouping of copies, search phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersieve.functions.setjoin import set_words, similar_pairs
from papersieve.functions.text import strip, title_key
from papersieve.session import cut

# Host parts by which a source is classified, in the order of the checks.
HIGH = (".edu", ".gov", ".ac.", "ieee", "springer", "nature", "elsevier", "doi.org")
PREPRINT = ("arxiv", "biorxiv", "ssrn")
# Phrases of sentences that make no search query.
BOILERPLATE = ("this paper", "in this section", "we propose", "table 1", "figure 1", "as shown in")


def classify(hits: DataFrame) -> DataFrame:
    """Host, reliability and source type by the host; rows without a URL keep what they state."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1))
    any_of = lambda parts: F.lit(False) if not parts else F.array_max(F.array(*[host.contains(p) for p in parts]))
    known = F.col("url").isNotNull() & (F.col("url") != "")
    rel = F.when(~known, F.col("reliability")).when(any_of(HIGH), "High").otherwise("Medium")
    kind = F.when(~known, F.col("source_type")).when(any_of(HIGH), "Journal / Academic").when(any_of(PREPRINT), "Preprint Repository").when(host.contains("wikipedia"), "Wikipedia").otherwise(F.col("source_type"))
    return hits.select("hit_id", F.when(known, host).alias("host"), rel.alias("reliability"), kind.alias("source_type")).distinct()


def dedup_titles(hits: DataFrame) -> DataFrame:
    """(title_key, hit_id, n): the first hit of every normalised title; min is combined before the shuffle."""
    k = hits.where("title is not null").withColumn("title_key", title_key(F.col("title"))).where("title_key <> ''")
    return k.groupBy("title_key").agg(F.min("hit_id").alias("hit_id"), F.count_distinct("hit_id").alias("n"))


def search_phrases(df: DataFrame, id_col: str, text_col: str, most: int = 4) -> DataFrame:
    """(id, query_no, phrase): first ten words of distinctive sentences of paragraphs of 80 characters or more."""
    para = df.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text_col, "\n\n")).alias("p", "para"))
    flat = F.trim(F.regexp_replace("para", r"\s+", " "))
    s = para.withColumn("para", flat).where(F.length("para") >= 80).select(id_col, "p", F.posexplode(F.split("para", r"[.?!]\s+")).alias("k", "s"))
    words = F.split(strip(F.col("s")), r"\s+")
    dull = F.array_max(F.array(*[F.lower("s").contains(b) for b in BOILERPLATE]))
    good = s.where((F.size(words) >= 8) & ~dull).withColumn("phrase", F.array_join(F.slice(words, 1, 10), " "))
    per = good.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("p", "k", "phrase"))).alias("a"))
    return per.select(id_col, F.posexplode(F.slice("a", 1, most)).alias("query_no", "x")).select(id_col, "query_no", "x.phrase")


def registry_join(refs: DataFrame, registry: DataFrame) -> DataFrame:
    """(ref_id, status): DOI lookup with title and year differences; references without a DOI are left to search."""
    key = lambda c: F.lower(F.trim(c))
    reg = registry.where("doi is not null and doi <> ''").groupBy(key(F.col("doi")).alias("k")).agg(F.min_by("title", "hit_id").alias("reg_title"), F.min_by("year", "hit_id").alias("reg_year"))
    j = refs.where("doi is not null and doi <> ''").withColumn("k", key(F.col("doi"))).join(reg, "k", "left")
    far = (F.col("year").isNotNull()) & (F.col("reg_year").isNotNull()) & (F.abs(F.col("year") - F.col("reg_year")) > 1)
    other = F.col("title").isNotNull() & F.col("reg_title").isNotNull() & (title_key(F.col("title")) != title_key(F.col("reg_title")))
    status = F.when(F.col("reg_title").isNull(), "BROKEN LINK").when(far | other, "PARTIALLY VERIFIED").otherwise("VERIFIED")
    return j.select("ref_id", status.alias("status")).distinct()


def search_status(refs: DataFrame, hits: DataFrame, sure: float = 85.0, doubtful: float = 70.0) -> DataFrame:
    """(ref_id, status, hit_id): the best hit by token set ratio of the titles, of all hits. VERIFIED, PARTIALLY VERIFIED
    (year off), SUSPICIOUS, else NOT VERIFIED."""
    h = hits.where("title is not null").groupBy(F.lower("title").alias("ht")).agg(F.min("hit_id").alias("hit_id"), F.min_by("year", "hit_id").alias("hy"))
    near = similar_pairs(refs.select(F.lower("title").alias("x")), h.select(F.col("ht").alias("y")), doubtful, best=True).withColumnsRenamed({"x": "rt", "y": "ht"})
    top = near.join(h, "ht").groupBy("rt").agg(F.max_by(F.struct("score", "hit_id", "hy"), F.struct("score", F.negative("hit_id"))).alias("m"))
    j = refs.withColumn("rt", F.lower("title")).join(top, "rt", "left")
    off = F.col("year").isNotNull() & F.col("m.hy").isNotNull() & (F.abs(F.col("year") - F.col("m.hy")) > 1)
    status = F.when(F.col("m").isNull(), "NOT VERIFIED").when(F.col("m.score") < sure, "SUSPICIOUS").when(off, "PARTIALLY VERIFIED").otherwise("VERIFIED")
    return j.select("ref_id", status.alias("status"), F.when(F.col("m.score") >= sure, F.col("m.hit_id")).alias("hit_id")).distinct()


def leader_groups(similar: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, leader): greedy grouping in id order, as a sequential pass would do, by rounds over the pairs (a < b).

    A node whose earlier neighbours are all followers leads; a node with a leading earlier neighbour follows the first
    such one. Each round decides at least the smallest open node of every component.
    """
    state = cut(nodes.select("id", F.lit(None).cast("long").alias("leader")))
    while True:
        s = state.select(F.col("id").alias("a"), F.col("leader").alias("la"))
        seen = similar.join(s, "a").groupBy("b").agg(F.min(F.when(F.col("la") == F.col("a"), F.col("a"))).alias("first_lead"), F.min(F.when(F.col("la").isNull(), F.col("a"))).alias("first_open"))
        j = state.join(seen.withColumnRenamed("b", "id"), "id", "left")
        # The first leader counts only if no earlier neighbour is still open.
        follow = F.col("first_lead").isNotNull() & (F.col("first_open").isNull() | (F.col("first_lead") < F.col("first_open")))
        lead = F.col("first_lead").isNull() & F.col("first_open").isNull()
        nxt = F.coalesce("leader", F.when(follow, F.col("first_lead")).when(lead, F.col("id")))
        state = cut(j.select("id", nxt.alias("leader")))
        if state.where("leader is null").isEmpty():
            return state


def title_groups(hits: DataFrame, same: float = 85.0) -> DataFrame:
    """(id, leader): a hit follows the first earlier primary whose title has a token set ratio above same, else it leads.

    Hits of one lower-case title are one node, the first of them: the later ones meet the primaries that it met, or itself.
    A title without words is like no other.
    """
    k = cut(hits.where("title is not null").groupBy("hit_id").agg(F.lower(F.min("title")).alias("t")))
    empty = F.size(set_words(F.col("t"))) == 0
    nodes = cut(k.where(~empty).groupBy("t").agg(F.min("hit_id").alias("id")))
    near = similar_pairs(nodes.select(F.col("t").alias("x")), nodes.select(F.col("t").alias("y")), same).where(F.col("score") > same)
    at = lambda c, to: nodes.select(F.col("t").alias(c), F.col("id").alias(to))
    pairs = cut(near.join(at("x", "a"), "x").join(at("y", "b"), "y").where("a < b").select("a", "b").distinct())
    led = leader_groups(pairs, nodes.select("id")).join(nodes, "id").select("t", "leader")
    alone = k.where(empty).select(F.col("hit_id").alias("id"), F.col("hit_id").alias("leader"))
    return k.join(led, "t").select(F.col("hit_id").alias("id"), "leader").unionByName(alone)
