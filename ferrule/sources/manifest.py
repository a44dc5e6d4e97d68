"""Materialised datasets guarded by a manifest (SRC7, SNK6, SNK7, JSON_1).

A build writes its rows to a new folder first and then a new manifest, numbered one above
the last. A manifest counts once its ``_SUCCESS`` file is there, so a reader sees the old
dataset or the new one, never a mixture, wherever a build stops. Re-use is refused when the
stored manifest differs from the requested one. Everything goes through Spark's writers, so
paths may be any shared file system.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_DIR = "_manifest"
PLAIN_DATA = "data"     # where a dataset without any manifest lies


def file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, path)
    return fs.exists(p)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete manifests below ``path``, in order."""
    p, fs = file_system(spark, f"{path}/{MANIFEST_DIR}")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(int(n[2:]) for n in names if n.startswith("n=") and n[2:].isdigit() and exists(spark, f"{path}/{MANIFEST_DIR}/{n}/_SUCCESS"))


def _stored(spark: SparkSession, path: str) -> dict | None:
    """The last complete manifest with its data folder; errors other than its absence rise."""
    known = _versions(spark, path)
    if not known:
        return None
    return json.loads(spark.read.text(f"{path}/{MANIFEST_DIR}/n={known[-1]}").first()[0])


def write_manifest(spark: SparkSession, path: str, manifest: dict, data: str = PLAIN_DATA) -> None:
    """Publish ``manifest`` for the rows in ``path/data``; earlier manifests stay as they are."""
    known = _versions(spark, path)
    row = (json.dumps({"manifest": manifest, "data": data}, sort_keys=True),)
    spark.createDataFrame([row], "manifest string").coalesce(1).write.mode("errorifexists").text(
        f"{path}/{MANIFEST_DIR}/n={(known[-1] if known else 0) + 1}")


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The stored manifest, or ``None`` when there is none (a one-row read)."""
    stored = _stored(spark, path)
    return stored["manifest"] if stored else None


def save_with_manifest(df: DataFrame, path: str, manifest: dict, partition_by: tuple[str, ...] = ()) -> str:
    """SNK6: write the dataset to a new folder, then its manifest; returns the folder."""
    folder = f"data-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{path}/{folder}")
    write_manifest(df.sparkSession, path, manifest, folder)
    return f"{path}/{folder}"


def load_or_build(spark: SparkSession, path: str, manifest: dict, build, rebuild: bool = False,
                  length_capped: bool = False, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """SRC7: re-use a saved dataset if its manifest equals ``manifest``.

    Equal -> read it; different -> error. A dataset saved without a manifest (``path/data``) is
    re-used as it is, except that it is refused when a length cap is in use, whose filter cannot
    be verified. Nothing saved, or ``rebuild`` -> build and save; saved rows are never overwritten.
    """
    stored = None if rebuild else _stored(spark, path)
    if stored is not None:
        if stored["manifest"] != manifest:
            raise ValueError(f"saved dataset at {path} was built with {stored['manifest']}, requested {manifest}")
        return spark.read.parquet(f"{path}/{stored['data']}")
    if not rebuild and exists(spark, f"{path}/{PLAIN_DATA}"):
        if length_capped:
            raise ValueError(f"dataset at {path} has no manifest; cannot verify its length cap")
        return spark.read.parquet(f"{path}/{PLAIN_DATA}")
    return spark.read.parquet(save_with_manifest(build(), path, manifest, partition_by))


def publish_version(df: DataFrame, base: str, version: str, manifest: dict) -> str:
    """SNK7: write a new versioned directory, then point the base manifest at it.

    Inputs are never overwritten in place; readers follow the manifest.
    """
    target = f"{base}/v={version}"
    df.write.mode("errorifexists").parquet(target)
    write_manifest(df.sparkSession, base, {**manifest, "version": version, "path": target})
    return target


def read_published(spark: SparkSession, base: str) -> DataFrame:
    m = read_manifest(spark, base)
    if m is None:
        raise FileNotFoundError(f"nothing published at {base}")
    return spark.read.parquet(m["path"])


def manifest_json(df: DataFrame, cols: list[str]) -> DataFrame:
    """JSON_1: a manifest row as sorted-key JSON text."""
    return df.select(F.to_json(F.struct(*sorted(cols))).alias("manifest"))
