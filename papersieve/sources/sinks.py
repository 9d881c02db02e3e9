"""Sinks: CSV, JSON and HTML exports, appends with key checks, cascading deletes, settings upserts."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def match_export(matches: DataFrame) -> DataFrame:
    """Matches with their number within the document, in source order."""
    return matches.withColumn("match_id", F.row_number().over(W.partitionBy("doc_id").orderBy("sent_idx")))


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with the rows whose key it lacks; new columns are filled with nulls."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def with_columns_filled(table: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """The table with missing columns added at their default and nulls of the present ones replaced by it."""
    for name, value in defaults.items():
        table = table.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in table.columns else F.lit(value))
    return table


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with rows replaced or added by key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete_cascade(tables: dict[str, DataFrame], ids: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """All tables without the rows of the deleted documents."""
    return {name: df.join(ids.select(key), key, "left_anti") for name, df in tables.items()}


def html_reports(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, html): one page per document with all its matches, rendered on the executors."""
    per = matches.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_idx", "sentence", "source_id", "score"))).alias("m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, title, m in zip(pdf["doc_id"], pdf["title"], pdf["m"]):
                body = "".join(f"<tr><td>{x['sent_idx']}</td><td>{html.escape(x['sentence'] or '')}</td><td>{x['source_id']}</td><td>{x['score']:.1f}</td></tr>" for x in (m if m is not None else []))
                rows.append((d, f"<html><body><h1>{html.escape(title or '')}</h1><table>{body}</table></body></html>"))
            yield pd.DataFrame(rows, columns=["doc_id", "html"])

    return docs.select("doc_id", "title").join(per, "doc_id", "left").mapInPandas(run, "doc_id long, html string")
