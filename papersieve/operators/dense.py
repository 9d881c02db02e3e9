"""Exact nearest neighbours of dense vectors for a set of queries, in blocks of bounded size."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersieve.session import cut

BLOCK, QUERY_BLOCK = 4096, 1024


def top_neighbours(vectors: DataFrame, k: int = 5, every: int = 100) -> DataFrame:
    """(query_id, vec_id, cosine_pct): the k nearest of every query row (id divisible by `every`) among all rows.

    Rows and queries are cut into blocks by hash, and each pair of blocks is one matrix product that keeps k per query,
    so no task holds more than two blocks; ties go to the smaller id. Null vectors are left out, zero vectors score 0.
    """
    v = vectors.where("vec_id is not null and embedding is not null").select("vec_id", "embedding").dropDuplicates(["vec_id"])
    n = v.count()
    nb, nq = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(n / every / QUERY_BLOCK))
    rows = v.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(nb))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    queries = v.where(F.col("vec_id") % every == 0).withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(nq)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long"))))

    def unit(s: pd.Series) -> np.ndarray:
        m = np.stack([np.asarray(x, np.float64) for x in s])
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        right = right.sort_values("vec_id", ignore_index=True)
        s = np.clip(unit(left["embedding"]) @ unit(right["embedding"]).T * 100, 0, 100)
        ids, out = right["vec_id"].to_numpy(), []
        for q, row in zip(left["vec_id"], s):
            row[ids == q] = -1
            order = np.lexsort((ids, -row))[:k]
            out += [(q, int(ids[j]), float(row[j])) for j in order if row[j] >= 0]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    part = queries.groupBy("b", "q").cogroup(rows.groupBy("b", "q")).applyInPandas(best, "query_id long, vec_id long, score double")
    per = cut(part).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.negative("score").alias("s"), "vec_id"))), 1, k).alias("a"))
    return per.select("query_id", F.explode("a").alias("x")).select("query_id", "x.vec_id", F.round(F.negative(F.col("x.s")), 4).alias("cosine_pct"))
