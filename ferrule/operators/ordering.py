"""Deterministic order, positions, splits and samples (SRC3, ORD1-ORD9).

Spark has no row order, so every operator takes an explicit order key. A
global (or per-group) position never uses one unpartitioned window - that
would funnel every row through one task. ``position`` ranks in two passes:

1. ``count``/``sum`` per ``(group, bucket)``, where ``bucket`` is a coarse,
   order-preserving prefix of the order key: a hash prefix for md5 orders, or
   for any other key (text, sparse or negative numbers, dates) its range between
   up to 4,096 sampled cuts;
2. a running sum over that small bucket table gives each bucket's offset;
3. ``row_number`` inside ``(group, bucket)`` windows + the offset.

The bucket table has at most (#groups x #buckets) rows, with sampled cuts only
#groups + #buckets; the join against it is left
to AQE, which broadcasts it when its measured size is small and otherwise
keeps a shuffle join. Random generators are replaced by md5 order of
``seed:key`` (identical in Spark and SQL engines).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BUCKET_CHARS = 3      # default: 16^3 = 4,096 buckets for md5-ordered ranks; raise it with the data
EXPAND = 4096              # repeats that one row is expanded into at a time
CUTS = 4096                # default: ranges of any other order key; raise it with the data
CUT_RUN = 64               # cuts that are searched at a time


def seeded_hash(seed: int | str, *cols) -> Column:
    """``md5('seed:c1:c2...')`` - the deterministic replacement of a seeded shuffle."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def hash_bucket(hash_col: Column, chars: int = HASH_BUCKET_CHARS) -> Column:
    return F.substring(hash_col, 1, chars)


def range_bucket(df: DataFrame, order: list[Column], name: str, cuts: int = CUTS) -> DataFrame:
    """Add the number of the key range that a row falls in as column ``name``: non-decreasing in ``order``, for keys of any orderable type.

    The ranges lie between ``cuts`` keys at most, drawn by the smallest hashes of the keys, so that every range holds
    about as many rows, however sparse the keys are. The cuts are one bounded value (a scalar subquery, no
    join), the same in every evaluation, and are searched in runs of ``CUT_RUN``. Nulls come first, in the first range.
    Rows that share a key share a range.
    """
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    drawn = df.select(key.alias("c")).orderBy(F.xxhash64("c"), "c").limit(cuts)
    every = drawn.agg(F.array_sort(F.collect_set("c")).alias("cs"))
    runs = F.transform(F.expr(f"sequence(0, greatest(size(cs) - 1, 0) div {CUT_RUN})"), lambda i: F.slice("cs", (i * CUT_RUN + 1).cast("int"), CUT_RUN))
    found = every.select(runs.alias("r")).select(F.struct("r", F.transform("r", lambda run: F.get(run, F.lit(0))).alias("heads")).alias("x")).scalar()
    rows = df.withColumn("__cuts", found)
    run = F.size(F.filter(F.col("__cuts")["heads"], lambda c: c <= key))
    inside = F.size(F.filter(F.get(F.col("__cuts")["r"], run - 1), lambda c: c <= key))
    return rows.withColumn(name, F.when(run > 0, (run - 1) * CUT_RUN + inside).otherwise(F.lit(0))).drop("__cuts")


def position(df: DataFrame, order: Column, bucket: Column | None = None, partition_by: tuple[str, ...] = (),
             weight: Column | None = None, pos_col: str = "pos",
             offset_col: str | None = None, total_col: str | None = None,
             max_total_col: str | None = None, cuts: int = CUTS) -> DataFrame:
    """Add the 1-based rank of each row within ``partition_by`` by ``order``.

    ``bucket`` must be non-decreasing in ``order``; without one, the rows are cut into about ``cuts`` ranges of group and
    order key (``range_bucket``), so that large groups have many. With ``weight``, also adds
    ``offset_col`` = sum of the weights of all earlier rows (running sum);
    ``total_col`` = number of rows in the partition; ``max_total_col`` = the
    largest partition size (computed on the small bucket table). Rows with a
    null group or a null order key are ranked like any other (nulls are equal).
    """
    part = list(partition_by)
    w = weight if weight is not None else F.lit(0)
    cut = range_bucket(df, [*[F.col(p) for p in part], order], "__bkt", cuts) if bucket is None else df.withColumn("__bkt", bucket)
    base = cut.withColumn("__ord", order).withColumn("__w", w.cast("long"))
    counts = base.groupBy(*part, "__bkt").agg(F.count(F.lit(1)).alias("__n"), F.sum("__w").alias("__ws"))
    before = Window.partitionBy(*part).orderBy("__bkt").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)
    offsets = counts.select(*[F.col(p).alias(f"__g{i}") for i, p in enumerate(part)], F.col("__bkt").alias("__b"),
                            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__row_base"),
                            F.coalesce(F.sum("__ws").over(before), F.lit(0)).alias("__w_base"),
                            F.sum("__n").over(whole).alias("__total"))
    if max_total_col:
        # window over the (groups x buckets) table only, never over the data
        offsets = offsets.withColumn("__max_total", F.max("__total").over(Window.partitionBy()))
    same = F.col("__bkt").eqNullSafe(F.col("__b"))
    for i, p in enumerate(part):
        same = same & F.col(p).eqNullSafe(F.col(f"__g{i}"))
    j = base.join(offsets, same)
    inb = Window.partitionBy(*part, "__bkt").orderBy("__ord")
    out = j.withColumn(pos_col, F.col("__row_base") + F.row_number().over(inb))
    if offset_col:
        run = inb.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(offset_col, F.col("__w_base") + F.sum("__w").over(run) - F.col("__w"))
    if total_col:
        out = out.withColumn(total_col, F.col("__total"))
    if max_total_col:
        out = out.withColumn(max_total_col, F.col("__max_total"))
    return out.drop(*[f"__g{i}" for i in range(len(part))], "__b", "__ord", "__bkt", "__w", "__n", "__ws", "__row_base", "__w_base", "__total", "__max_total")


def seeded_order(seed, key_cols: list[str]) -> Column:
    """The text that seeded-shuffle order sorts by: md5 of seed and keys, then the keys (null: empty)."""
    return F.concat(seeded_hash(seed, *key_cols), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key_cols])


def hashed_position(df: DataFrame, seed, key_cols: list[str], partition_by: tuple[str, ...] = (),
                    bucket_chars: int = HASH_BUCKET_CHARS, **kw) -> DataFrame:
    """Rank rows in seeded-shuffle order (md5 of seed and keys).

    ``bucket_chars`` hex digits make a bucket: 16 ** bucket_chars sorts a group, each in one task.
    """
    return position(df, seeded_order(seed, key_cols), hash_bucket(seeded_hash(seed, *key_cols), bucket_chars),
                    partition_by, **kw)


def head_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """ORD1: the first ``min(n, len)`` rows in key order (TakeOrderedAndProject)."""
    return df.orderBy(key).limit(n)


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 100, bucket_chars: int = HASH_BUCKET_CHARS) -> DataFrame:
    """SRC3: a seeded sample of ``n`` rows per group, or all of a smaller one, for any ``n``.

    Distributed selection: rows are counted by group and hash prefix; the prefix that holds a group's
    n-th row lets through every row of the prefixes before it, and only its own rows are ranked. So no
    task sorts more than one prefix of a group, and rows that aren't drawn never leave their scan.
    Null groups form a group; raise ``bucket_chars`` with the data.
    """
    at = seeded_hash(seed, key)
    rows = df.withColumn("__at", at).withColumn("__b", hash_bucket(at, bucket_chars))
    counts = rows.groupBy(F.col(group).alias("__group"), "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__group").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    edge = counts.where((F.col("__before") < n) & (F.col("__before") + F.col("__n") >= n)).select(
        "__group", F.col("__b").alias("__edge"), (F.lit(n) - F.col("__before")).alias("__room"))      # a row a group; none for smaller groups
    drawn = rows.join(edge, F.col(group).eqNullSafe(F.col("__group")), "left").where(F.col("__edge").isNull() | (F.col("__b") <= F.col("__edge")))
    place = F.row_number().over(Window.partitionBy(group, "__b").orderBy("__at", F.col(key)))
    kept = drawn.withColumn("__place", place).where(F.col("__edge").isNull() | (F.col("__b") < F.col("__edge")) | (F.col("__place") <= F.col("__room")))
    return kept.select(*df.columns) if n > 0 else df.limit(0)


def sample_k(df: DataFrame, key: str, k: int, seed: int = 10) -> DataFrame:
    """ORD8: k rows in seeded order (top-k, no full sort)."""
    return df.orderBy(seeded_hash(seed, key), F.col(key)).limit(k)


def hash_split(df: DataFrame, key: str, fraction: float, seed: int = 42,
               names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """ORD2: row-level split by a uniform hash in [0, 1); no shuffle at all."""
    u = F.conv(F.substring(seeded_hash(seed, key), 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))
    return df.withColumn("split", F.when(u < fraction, F.lit(names[1])).otherwise(F.lit(names[0])))


def document_split(df: DataFrame, group: str, key: str, val_fraction: float = 0.1, seed: int = 100,
                   names: tuple[str, str] = ("train", "val"), bucket_chars: int = HASH_BUCKET_CHARS) -> DataFrame:
    """ORD3: leak-free split of documents, independently per group.

    Seeded order per group; ``n_val = max(1, round_half_even(n * f))`` first documents go to
    validation. Only (group, key) is ranked; the rank gives one cut-off hash per group, and the
    documents are then decided row by row against it, so texts aren't ranked or shuffled by rank.
    Null groups form a group of their own; rows repeated in the key fall on one side. Raise ``bucket_chars`` with the data.
    """
    keys = df.select(F.col(group).alias("__group"), F.col(key).alias("__key"))
    ranked = position(keys, seeded_order(seed, ["__group", "__key"]), hash_bucket(seeded_hash(seed, "__group", "__key"), bucket_chars),
                      ("__group",), total_col="__cnt")
    n_val = F.greatest(F.lit(1), F.bround(F.col("__cnt") * F.lit(float(val_fraction)), 0).cast("long"))
    cut = ranked.where(F.col("pos") == n_val).select("__group", seeded_order(seed, ["__group", "__key"]).alias("__cut"))
    # one row per group; without the hint, all texts could be shuffled by group, a whole group to one task
    out = df.join(F.broadcast(cut), F.col(group).eqNullSafe(F.col("__group")), "left")
    return out.withColumn("split", F.when(seeded_order(seed, [group, key]) <= F.col("__cut"), F.lit(names[1])).otherwise(F.lit(names[0]))) \
        .drop("__group", "__cut")


def exact_split(df: DataFrame, unit: str | list[str], test_count: int, seed: int = 42, names: tuple[str, str] = ("train", "test"),
                bucket_chars: int = HASH_BUCKET_CHARS) -> DataFrame:
    """ORD2 with exact counts: the first ``test_count`` units in seeded order are the test side.

    ``unit`` is the key of what is split: a row's key, or a block's (document, block index).
    """
    cols = [unit] if isinstance(unit, str) else list(unit)
    ranked = hashed_position(df, seed, cols, bucket_chars=bucket_chars)
    return ranked.withColumn("split", F.when(F.col("pos") <= test_count, F.lit(names[1])).otherwise(F.lit(names[0]))).drop("pos")


def batches(df: DataFrame, pos_col: str, total_col: str, batch_size: int, drop_last: bool) -> DataFrame:
    """ORD5: ``batch_id = (pos - 1) div B``; with ``drop_last`` the short last batch goes."""
    out = df.withColumn("batch_id", F.floor((F.col(pos_col) - 1) / F.lit(batch_size)).cast("long"))
    if drop_last:
        full = F.floor(F.col(total_col) / F.lit(batch_size)) * F.lit(batch_size)
        out = out.where(F.col(pos_col) <= full)
    return out


def step_schedule(batch_ids: DataFrame, n_batches_col: str, total_steps: int) -> DataFrame:
    """ORD6: training step -> batch when batches are cycled (step s uses batch (s-1) % n).

    Each batch row emits its own steps ``b+1, b+1+n, ...`` - no join, no cross product.
    """
    n = F.col(n_batches_col)
    steps = F.when(F.col("batch_id") < F.least(n, F.lit(total_steps)).cast("long"),
                   F.sequence(F.col("batch_id") + 1, F.lit(total_steps).cast("long"), n.cast("long"))) \
        .otherwise(F.array().cast("array<long>"))
    return batch_ids.select("batch_id", F.explode(steps).alias("step"))


def interleave(df: DataFrame, group: str, key: str, seed: int = 100, bucket_chars: int = HASH_BUCKET_CHARS) -> DataFrame:
    """ORD7: round-robin over groups until every group is exhausted (short groups repeat).

    A row at 0-based position p of a group with c rows appears in rounds
    p, p + c, p + 2c, ... < max group size. Output ``(round, group, key)``.
    """
    ranked = hashed_position(df, seed, [key], partition_by=(group,), bucket_chars=bucket_chars, total_col="__cnt", max_total_col="__m")
    # Two steps: spans of up to EXPAND repeats, then the repeats of a span, so no array grows with the larger group.
    span = F.col("__cnt") * EXPAND
    starts = F.sequence(F.col("pos") - 1, F.col("__m") - 1, span)
    spans = ranked.select(F.explode(starts).alias("__s"), group, key, "__m", "__cnt")
    last = F.least(F.col("__m") - 1, F.col("__s") + F.col("__cnt") * (EXPAND - 1))
    return spans.select(F.explode(F.sequence(F.col("__s"), last, F.col("__cnt"))).alias("round"), group, key)
