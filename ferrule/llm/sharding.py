"""Sharding by rendezvous (highest-random-weight) hashing. [native: DataFrame functions only]

Every (key, shard) pair gets a pseudo-random number u in (0, 1) from the md5 of
``"<key>:<shard>"``; the row goes to the shard with the largest ``-weight / ln(u)``.
The chance to win is proportional to the weight, and adding shards moves only the rows
that a new shard wins. The rule depends on the key and the shards alone, so a retried
task, another partitioning or a later run assigns the same shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the md5 that make u (52 bits: exact in a double).
U_DIGITS = 13


def _u(key: Column, shard: int) -> Column:
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, U_DIGITS), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(float(16 ** U_DIGITS))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard (0 .. len(weights) - 1) of ``key`` under positive ``weights``.

    A null key hashes as the empty text. Equal scores (a 52-bit hash collision) go to the
    larger shard number.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    text = F.coalesce(key.cast("string"), F.lit(""))
    scores = [F.struct((F.lit(-float(w)) / F.log(_u(text, i))).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights)]
    return F.array_max(F.array(*scores))["i"] if len(scores) > 1 else F.lit(0)


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 40,
                  grown_weights: Sequence[float] | None = None, slot_buckets: int = 4096) -> DataFrame:
    """Shard, slot and size of every row: ``key, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the UTF-8 length of the text plus 16 (null text: 16) and ``text_crc32`` the crc32
    of the text (null: of nothing). ``grown_shard`` is the shard under ``grown_weights``
    (default: one more shard of mean weight). ``slot`` numbers the rows of a shard from 0 without
    gaps in the order of (md5 of the key, key, text_crc32, size): counts of (shard, md5 bucket)
    give each bucket its offset, so no task sorts a whole shard. ``slot_buckets`` (a power of 16)
    bounds the rows of one sort to about rows / (shards * slot_buckets); raise it with the data.
    Texts never enter a shuffle. Null keys share the empty key; rows repeated in every column get
    different slots of one shard; an empty table gives an empty result.
    """
    digits = len(f"{slot_buckets - 1:x}")
    if 16 ** digits != slot_buckets:
        raise ValueError("slot_buckets must be a power of 16")
    weights = list(weights)
    grown = list(grown_weights) if grown_weights is not None else [*weights, sum(weights) / len(weights)]
    k, t = F.col(key), F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        k.alias(key), (F.octet_length(t) + F.lit(16)).cast("long").alias("size"), F.crc32(t).alias("text_crc32"),
        rendezvous(k, weights).alias("shard"), rendezvous(k, grown).alias("grown_shard"),
        F.md5(F.coalesce(k.cast("string"), F.lit(""))).alias("_order")).withColumn("_bucket", F.substring("_order", 1, digits))
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_order", F.col(key).asc_nulls_first(), "text_crc32", "size")
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(offsets, ["shard", "_bucket"]).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("_offset") + F.col("_rank")).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))
