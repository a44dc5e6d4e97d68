"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.udf_support import ship_by_value
from ferrule.session import checkpoint_dir

#: Fixed value: the white space that separates words in every contract of this subpackage.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_fold(id_col: str, folds: int):
    """crc32 of the id written as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: the lineage ends there.

    Every executor can read the files, so a lost executor costs only its running tasks.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/ferrule-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batches: Iterator, column: int, most: int = 4_000_000, keep: str | None = None) -> Iterator:
    """The Arrow batches cut into runs of rows whose ``column`` holds ``most`` bytes at most, or into single rows.

    A Python worker serves one operator after another, so what others than ``keep`` left in its
    cache, and memory that Arrow holds back, is given up first.
    """
    store = sys.modules.get("_ferrule_llm_worker")
    for name in [n for n in (store.__dict__ if store else ()) if not n.startswith("__") and n != keep]:
        del store.__dict__[name]
    for batch in batches:
        pa.default_memory_pool().release_unused()
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def split_words(texts: pa.Array, table: bytes) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of texts in one array, in order, and the number of words of each row.

    ``table`` translates every byte; a byte that becomes a blank separates words. Null texts have none.
    """
    n = len(texts)
    data = texts.buffers()[2]
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    edge = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int32)
    if data is None or edge[-1] == edge[0]:
        return pa.array([], pa.binary()), np.zeros(n, dtype=np.int64)
    edge = edge.astype(np.int64)
    raw = np.frombuffer(data[int(edge[0]):int(edge[-1])].to_pybytes().translate(table), dtype=np.uint8)
    edge -= edge[0]
    ink = raw != 32
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    begin = edge[:-1][edge[:-1] < edge[1:]]     # a text's first byte begins a word, whatever the text before it ends with
    first[begin] |= ink[begin]
    start = np.flatnonzero(first)
    at = (np.cumsum(ink, dtype=np.int32) if len(raw) < 2**31 else np.cumsum(ink))[start] - 1
    letters = raw[ink]
    kind, offsets = (pa.large_binary(), np.int64) if len(raw) >= 2**31 else (pa.binary(), np.int32)
    words = pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(np.append(at, len(letters)).astype(offsets)), pa.py_buffer(letters)])
    return words, np.diff(np.searchsorted(start, edge))


def worker_cache(key, build):
    """``build()`` once for each Python worker and ``key``; later tasks of the worker reuse it.

    A worker keeps one value for each operator (the first part of the key).
    """
    store = sys.modules.setdefault("_ferrule_llm_worker", types.ModuleType("_ferrule_llm_worker")).__dict__
    held = store.get(key[0])
    if held is None or held[0] != key:
        held = store[key[0]] = (key, build())
    return held[1]


def hash_sample(df: DataFrame, by: str, key: str, per_class: int) -> tuple[DataFrame, list]:
    """Rows of ``df`` for learning: about ``per_class`` of each value of ``by``, or all if there are fewer.

    A row is drawn when a hash of its key falls below the class's share, so the draw needs one count
    by class and no sort, and is the same in every run. Every class is drawn from, however many there
    are; they are returned too, in order. Rows with a null class or key are left out.
    """
    known = df.where(F.col(by).isNotNull() & F.col(key).isNotNull())
    counts = known.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()
    u = F.xxhash64(F.lit("sample"), F.col(key)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    if not counts:
        return known.limit(0), []
    shares = F.create_map(*[F.lit(x) for row in counts for x in (row[by], per_class / row["n"])])    # one literal: its depth doesn't grow with the classes
    return known.where(u < shares[F.col(by)]), sorted(row[by] for row in counts)


ship_by_value(__name__)
