"""Parquet table readers (SRC1, SRC2, SRC6).

Readers return lazy DataFrames; callers select columns and filter, and
Catalyst pushes both into the Parquet scan (``ReadSchema`` / ``PushedFilters``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_task(spark: SparkSession, sf_dir: str, table: str, task_col: str, task: str) -> DataFrame:
    """SRC1/FIL1: one labelled subset of an instruction table (filter pushed to the scan)."""
    return read_table(spark, sf_dir, table).where(F.col(task_col) == F.lit(task))


def load_corpus(spark: SparkSession, sf_dir: str, table: str = "documents",
                key_col: str = "doc_id", text_column: str = "text") -> DataFrame:
    """SRC2: a text corpus as ``(key, text)``; other columns are pruned at the scan."""
    return read_table(spark, sf_dir, table).select(F.col(key_col), F.col(text_column).alias("text"))


def from_rows(spark: SparkSession, rows, schema) -> DataFrame:
    """SRC6: a small in-memory table (dimensions, test rows only)."""
    return spark.createDataFrame(rows, schema)
