"""Text sizes in tokens of a public tokenizer; its file is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.session import read_table, spread

TOKENIZER = os.environ.get("PAPERSIEVE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("sizes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    return len(_encoding(path).encode_ordinary(text))


def token_count(col: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a text column; null and empty texts have none."""

    @F.pandas_udf("long")
    def size(s: pd.Series) -> pd.Series:
        enc = _encoding(path)
        return s.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    return size(F.coalesce(col, F.lit("")))


def sized_documents(spark: SparkSession, data_dir: str, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of all documents."""
    d = read_table(spark, data_dir, "documents").where("doc_id is not null").select("doc_id", "source", "text")
    return spread(d, "doc_id").select("doc_id", "source", token_count(F.col("text"), path).alias("tokens")).dropDuplicates(["doc_id"])
