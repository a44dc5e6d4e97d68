"""Metric CSV logs as all-text tables (SRC4, SRC5, SET2).

Every field is read as text (no schema inference); blanks stay blank so the
lenient float of ``functions.text`` decides what is numeric.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX = "row_idx"


def _fs_glob(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted file paths matching a glob on the cluster's file system (names only, no data)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(conf)
    statuses = fs.globStatus(path) or []
    return sorted(str(s.getPath().toString()) for s in statuses if s.isFile())


def _indexed(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns as text, the full ``file`` path, and ``row_idx``: the row's place in its file, from 0.

    Rows of a split come in file order, and splits are ordered by their start. A log has a line a
    step, so the window of one file is small.
    """
    place = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols], F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"))
    at = F.row_number().over(Window.partitionBy("file").orderBy("__start", "__id")) - 1
    return place.withColumn(INDEX, at.cast("long")).drop("__start", "__id")


def read_metric_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """SRC4: one CSV (or a directory of part files sharing a header), all columns text.

    Adds ``file`` (the source file's path) and ``row_idx`` (the row's place in it).
    """
    reader = spark.read.option("header", True).option("inferSchema", False).option("emptyValue", "")
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = reader.csv(path)
    return _indexed(df, df.columns)


def headers_of(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """The columns of every file, from one distributed read: path -> names (quoted names keep their commas)."""
    lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("file"),
                                          F.struct(F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("i")).alias("at"))
    first = lines.groupBy("file").agg(F.min_by("value", "at").alias("line")).collect()      # one row per file
    return {r["file"]: [c.strip() for c in next(csv.reader([r["line"]]))] for r in first}


def read_metric_logs(spark: SparkSession, pattern: str, paths: list[str] | None = None) -> DataFrame:
    """SRC5/SET2: all logs matching a glob, sorted by name; an explicit list overrides the glob.

    Files are grouped by header; each group is one read, and groups are
    combined with ``unionByName(allowMissingColumns=True)``. Empty files add nothing.
    """
    files = list(paths) if paths is not None else _fs_glob(spark, pattern)
    if not files:
        raise FileNotFoundError(f"no metric files match {pattern!r}")
    groups: dict[tuple[str, ...], list[str]] = {}
    for f, cols in sorted(headers_of(spark, files).items()):
        groups.setdefault(tuple(cols), []).append(f)
    out = None
    for cols, group in groups.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])
        part = _indexed(spark.read.option("header", True).option("emptyValue", "").schema(schema).csv(group), list(cols))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no metric file that matches {pattern!r} has a header")
    return out
