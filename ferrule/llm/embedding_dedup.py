"""Near-duplicate vectors by sorted projection passes.

Each pass orders all vectors lexicographically by concatenated random hashes (the signs of
random projections, packed into a long), compares every vector with the ``window`` vectors
before it, and verifies by the cosine in double precision. The links of all passes are
united into components. Links inside a component are then counted exactly, block by block.

Scale: equal vectors are one class; a pass is a range partitioning on (hashes, id), whose
keys are unique, so a dense cluster is cut evenly over partitions; a task holds one chunk and
one window; what passes give out is a spanning forest of each chunk, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions.udf_support import ship_by_value
from ferrule.llm.common import materialise
from ferrule.llm.components import components

BITS = 62
CHUNK = 256
BLOCK = 512
ROWS_A_PARTITION = 20_000
#: Fewest passes of a table of any size; also how many a batch is hashed for at a time.
PASSES = 24


def passes_for(count: int, least: float, window: int, recall: float) -> int:
    """Passes after which a pair of cosine ``least`` among ``count`` vectors is found with a chance of ``recall``, ``PASSES`` at least.

    A pass brings the pair within a window with a chance of about (1 - arccos(least) / pi) ** log2(count / window).
    """
    same = 1 - math.acos(min(1.0, max(-1.0, least))) / math.pi
    chance = same ** math.log2(max(1.0, count / window)) if same else 0.0
    if not 0 < recall < 1 or chance == 0:
        raise ValueError("recall must be between 0 and 1, and least above -1")
    return PASSES if chance == 1 else max(PASSES, math.ceil(math.log1p(-recall) / math.log1p(-chance)))


def unit(vectors: pa.Array) -> np.ndarray:
    """Rows of one length as double-precision unit vectors (scaled first, so that squares don't overflow)."""
    x = np.array(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_length(vectors: pa.Array) -> Iterator[np.ndarray]:
    """Row numbers of the vectors of each length."""
    sizes = np.array([len(v) for v in vectors])
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def local_links(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star of each component of the links (i, j) among 0 .. n - 1: (member, root)."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def _keys(reps: DataFrame, passes: int, seed: int) -> DataFrame:
    """``(pass, dim, key, id, v)``: the packed hashes of every vector in every pass."""
    kind = reps.schema["v"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                for rows in by_length(part.column(1)):
                    own = part.take(pa.array(rows))
                    x = unit(own.column(1))
                    dim = x.shape[1]
                    if dim not in planes:
                        planes[dim] = np.random.default_rng((seed, dim)).standard_normal((dim, passes * BITS))
                    for first in range(0, passes, PASSES):
                        signs = (x @ planes[dim][:, first * BITS:(first + PASSES) * BITS] > 0).reshape(len(x), -1, BITS)
                        keys = signs.astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                        for p in range(keys.shape[1]):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(x), first + p, dtype=np.int32)), pa.array(np.full(len(x), dim, dtype=np.int32)),
                                 pa.array(keys[:, p]), own.column(0), own.column(1)], ["pass", "dim", "key", "id", "v"])

    return reps.select("id", "v").mapInArrow(work, f"pass int, dim int, key long, id long, v {kind}")


def _compare(batches: Iterator[pa.RecordBatch], groups: int, window: int, least: float) -> Iterator[tuple]:
    """Links of sorted rows ``(group columns .., id, v)`` within ``window`` places of one group.

    Gives (members, roots, run): a forest of each chunk, and the chunk's rows for the caller.
    """
    held_group, ids, x = None, np.zeros(0, np.int64), None
    for batch in batches:
        columns = [np.array(batch.column(c)) for c in range(groups)]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if batch.num_rows > 1 else []
        for lo, hi in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            group = tuple(c[lo].item() for c in columns)
            if group != held_group:
                held_group, ids, x = group, np.zeros(0, np.int64), None
            for at in range(lo, hi, CHUNK):
                part = batch.slice(at, min(CHUNK, hi - at))
                new = unit(part.column(groups + 1))
                before = len(ids)
                ids = np.concatenate([ids, np.array(part.column(groups))])
                x = new if x is None else np.concatenate([x, new])
                i, j = np.nonzero(new @ x.T >= least)
                i = i + before
                near = (j < i) & (i - j <= window)
                member, root = local_links(i[near], j[near], len(ids))
                yield group, ids[member], ids[root], part
                ids, x = ids[-window:], x[-window:]


def _pass_links(keys: DataFrame, window: int, least: float) -> DataFrame:
    """``(a, b)`` links of all passes, those across the seams of neighbouring partitions included.

    A partition with fewer rows than a window ends the window there.
    """
    kind = keys.schema["v"].dataType.simpleString()
    order = ["pass", "dim", "key", "id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links, and the first and last rows of the partition, which the seams need."""
        part_id = TaskContext.get().partitionId()
        names = ["a", "b", "seam", "pass", "dim", "key", "id", "v"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        head: list[pa.RecordBatch] = []
        tail: list[pa.RecordBatch] = []
        seen = 0

        def rows(a, b, seam, part):
            n = len(a) if part is None else part.num_rows
            cols = [pa.array(a, types[0]) if part is None else pa.nulls(n, types[0]), pa.array(b, types[1]) if part is None else pa.nulls(n, types[1]),
                    pa.array(np.full(n, seam), types[2])]
            cols += [pa.nulls(n, t) for t in (*types[3:], vector)] if part is None else list(part.columns)
            return pa.RecordBatch.from_arrays(cols, names)

        def sorted_in(batches):
            for batch in batches:
                yield batch.select(["pass", "dim", "id", "v", "key"])

        for _, a, b, part in _compare(sorted_in(batches), 2, window, least):
            part = part.select(["pass", "dim", "key", "id", "v"])
            vector = part.column(4).type
            if len(a):
                yield rows(a, b, -1, None)
            if seen < window:
                head.append(part.slice(0, window - seen))
            seen += part.num_rows
            tail.append(part)
            while sum(t.num_rows for t in tail) - tail[0].num_rows >= window:
                tail.pop(0)
        for part in head:
            yield rows([], [], part_id - 1, part)
        spare = sum(t.num_rows for t in tail) - window
        for k, part in enumerate(tail):
            yield rows([], [], part_id, part.slice(max(0, spare)) if k == 0 else part)

    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, a, b, _ in _compare(batches, 3, window, least):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    total = keys.count()
    parts = max(1, total // ROWS_A_PARTITION)
    ranged = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    done = materialise(ranged.mapInArrow(work, f"a long, b long, seam long, pass int, dim int, key long, id long, v {kind}"), "passes")
    edge = done.where("id IS NOT NULL").select("seam", "pass", "dim", "key", "id", "v")
    across = edge.repartition("seam", "pass", "dim").sortWithinPartitions("seam", *order).select("seam", "pass", "dim", "id", "v")
    return done.where("a IS NOT NULL").select("a", "b").unionByName(across.mapInArrow(seams, "a long, b long"))


def _exact_counts(members: DataFrame, least: float, block: int) -> DataFrame:
    """``(id, linked)``: over all pairs of one component, how many other vectors a vector links with.

    A component of n classes is dealt into about n / ``block`` blocks by a hash of the id, and every
    pair of blocks is one unit of work, so a unit has about two blocks however large the component is.
    Only counts leave a unit.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = members.join(sizes, "component").withColumn("own", F.expr("cast(pmod(xxhash64(id), blocks) AS int)"))
    units = dealt.select("component", "id", "v", "m", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")).select(
        "component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "v", "m")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def count(group, parts):
            t = pa.Table.from_batches(parts)
            own, ids, m = (t.column(c).to_numpy() for c in ("own", "id", "m"))
            x = unit(t.column("v").combine_chunks())
            a, b = np.flatnonzero(own == group[1]), np.flatnonzero(own == group[2])
            near = x[a] @ x[b].T >= least
            if group[1] == group[2]:
                np.fill_diagonal(near, False)
                return ids[a], near @ m[b]
            return np.concatenate([ids[a], ids[b]]), np.concatenate([near @ m[b], near.T @ m[a]])

        held, parts = None, []
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in range(3)]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if batch.num_rows > 1 else []
            for lo, hi in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                group = tuple(c[lo].item() for c in columns)
                if group != held and parts:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in count(held, parts)], ["id", "linked"])
                    parts = []
                held = group
                parts.append(batch.slice(lo, hi - lo))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in count(held, parts)], ["id", "linked"])

    split = units.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y")
    return split.mapInArrow(work, "id long, linked long").groupBy("id").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9,
                    passes: int | None = None, window: int = 128, seed: int = 42, block: int = BLOCK, recall: float = 0.99) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row, by cosine >= ``least``.

    ``n_links`` counts the other rows that a row links with directly, copies included.
    ``component_id`` is the smallest key reachable, and ``kept`` marks the row that has it.
    Null, empty and zero vectors, and vectors with null or non-finite components, link with nothing;
    vectors of different length don't link. Rows with a null key take no part and keep a null component
    (``kept`` is then true). Repeated rows count as copies. An empty table gives an empty result.
    The number of passes follows from the counted distinct vectors, so that a pair of cosine ``least`` is
    found with a chance of ``recall`` in a table of any size (see ``passes_for``); ``passes`` sets it instead.
    """
    number = vectors.schema[vector].dataType.elementType.simpleString()
    kind = "array<float>" if number == "float" else "array<double>"
    valid = F.coalesce(F.size(vector) > 0, F.lit(False)) & F.col(key).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("id"), F.when(F.coalesce(valid, F.lit(False)), F.col(vector).cast(kind)).alias("v"))
    classes = materialise(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"))
                          .withColumn("id", F.monotonically_increasing_id()), "classes")     # written once: the numbers stay
    reps = classes.select("id", "v", "m")
    passes = passes_for(classes.count(), least, window, recall) if passes is None else passes
    linked = components(_pass_links(materialise(_keys(reps, passes, seed), "keys"), window, least))
    members = materialise(reps.join(linked, reps["id"] == linked["node"]).select("component", "id", "v", "m"), "members")
    counts = _exact_counts(members, least, block)
    least_key = members.select("id", "component").join(classes.select("id", "rep"), "id").groupBy("component").agg(F.min("rep").alias("first"))
    known = members.select("id", "component").join(least_key, "component").join(counts, "id", "left").select("id", "first", "linked")
    named = materialise(classes.join(known, "id", "left").select(
        "v", (F.coalesce("linked", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("first", "rep").alias("component_id")), "named")
    out = rows.join(named, "v", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


ship_by_value(__name__)
