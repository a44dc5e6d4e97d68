"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most one bit in one of
two 32-bit halves. So every distinct fingerprint is indexed under each half with one bit
left out (64 keys); an equality on the key finds every such pair, and the bit distance
verifies it. Copies with one fingerprint are one class throughout.

The index is shuffled once by key and read as a sorted stream, whatever its size: a key of one
member costs nothing, and a key of more is reduced to the links of a spanning forest, never to
all pairs. A key of more than ``MOST`` members isn't gathered: its members are indexed again by
the same rule on the bits that they needn't share (halves of 16, then of 8 bits). After the
third split the members of a key can differ in 8 bits and three left-out bits only, so there
are at most 2 ** 11 of them. Nothing is capped or skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.udf_support import ship_by_value
from ferrule.llm.common import materialise, text_slices
from ferrule.llm.components import components

SEED = 42
MAX_BITS = 3        # the index below is built for this distance
MOST = 2048
CHUNK = 1 << 20     # bytes of a text that are split into words at a time


def word_chunks(raw: bytes, size: int = CHUNK) -> Iterator[list[bytes]]:
    """The words of a text, a bounded number of bytes at a time."""
    lo = 0
    while lo < len(raw):
        hi = min(lo + size, len(raw))
        while hi < len(raw) and raw[hi] not in b" \t\n\x0b\x0c\r":
            hi += 1
        yield raw[lo:hi].split()
        lo = hi


def fingerprint(text: str | None, shingle: int) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles (repeats count); 0 without a word."""
    ones, n, carry = np.zeros(64, dtype=np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in word_chunks((text or "").encode().lower()):    # bytes.lower() and bytes.split() know ASCII only
        carry += words
        if len(carry) >= shingle:
            grams = map(b" ".join, zip(*(carry[i:] for i in range(shingle)), strict=False))
            hashes = np.fromiter((digest(g, SEED) for g in grams), dtype="<u8", count=len(carry) - shingle + 1)
            for lo in range(0, len(hashes), 65_536):
                part = hashes[lo:lo + 65_536]
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(hashes)
            carry = carry[len(carry) - shingle + 1:]
    if not n:
        return digest(b" ".join(carry), SEED) if carry else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``key, fp, h``: the fingerprint of every whole text as a signed long (same 64 bits), and a hash of the text itself."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1):
            fps = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"k": part.column(0), "fp": pa.array(fps), "h": part.column(2)})

    return docs.select(key, text, F.xxhash64(text).alias("h")).mapInArrow(work, f"k {kind}, fp long, h long").withColumnRenamed("k", key)


def _split(rows: DataFrame, width: int) -> DataFrame:
    """``(key, lo, bit, fp)``: one row for each half of the ``width`` open bits from ``lo`` and each bit left out of it.

    The new key holds the old one and the half without the bit; the other half stays open.
    """
    half = width // 2
    keys = []
    for low in (True, False):
        here, there = (F.col("lo"), F.col("lo") + half) if low else (F.col("lo") + half, F.col("lo"))
        value = F.expr(f"shiftrightunsigned(fp, lo{'' if low else f' + {half}'})").bitwiseAND(F.lit((1 << half) - 1))
        keys += [F.struct(F.xxhash64("key", here, F.lit(i), value.bitwiseAND(F.lit(((1 << half) - 1) & ~(1 << i)))).alias("key"),
                          there.cast("int").alias("lo"), (here + i).cast("int").alias("bit"), "fp") for i in range(half)]
    return rows.select(F.explode(F.array(*keys)).alias("r")).select("r.*")


def _forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of fingerprints (walks from each unseen member)."""
    found, rest = [], members
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            at = stack.pop()
            near = np.bitwise_count(rest ^ at) <= MAX_BITS
            for x in rest[near]:
                found.append((int(at), int(x)))
                stack.append(x)
            rest = rest[~near]
    return found


def _scan(half: int, most: int):
    """A reader of sorted ``(key, lo, bit, fp)`` rows: links ``(a, b)`` of keys up to ``most`` members, and the rows of larger keys.

    Members that agree on the left-out bit agree on the whole half, and then share the key of the
    half's first bit as well; so other keys of that kind are left to it.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(links: list[tuple[int, int]], over: list[np.ndarray]) -> pa.RecordBatch:
            ab = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            rest = np.concatenate(over) if over else np.zeros((0, 4), np.int64)
            column = lambda x, n, first: pa.array(np.concatenate([np.zeros(n, np.int64), x] if not first else [x, np.zeros(n, np.int64)]),
                                                  mask=np.arange(len(x) + n) < n if not first else np.arange(len(x) + n) >= len(x))
            return pa.RecordBatch.from_pydict({"a": column(ab[:, 0], len(rest), True), "b": column(ab[:, 1], len(rest), True),
                                               "key": column(rest[:, 0], len(ab), False), "lo": column(rest[:, 1], len(ab), False).cast(pa.int32()),
                                               "fp": column(rest[:, 3], len(ab), False)})

        def links_of(run: np.ndarray) -> list[tuple[int, int]]:
            bit = int(run[0, 2])
            members = np.unique(run[:, 3].view(np.uint64))
            side = members >> np.uint64(bit) & np.uint64(1)
            if len(members) < 2 or (bit % half and (side == side[0]).all()):
                return []
            return _forest(members)

        held, large = np.zeros((0, 4), np.int64), None      # rows of the last key; its name if it is too large
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)])
            found, over = [], []
            if large is not None:
                same = int(np.searchsorted(rows[:, 0] != large, True))
                over.append(rows[:same])
                rows = rows[same:]
                if not len(rows):
                    yield out(found, over)
                    continue
                large = None
            rows = np.concatenate([held, rows])
            start = np.concatenate([[0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1])
            stop = np.concatenate([start[1:], [len(rows)]])
            size = stop - start
            for k in np.flatnonzero(size[:-1] > 1).tolist():
                run = rows[start[k]:stop[k]]
                if len(run) > most:
                    over.append(run)
                else:
                    found += links_of(run)
            held = rows[start[-1]:]
            if len(held) > most:
                over.append(held)
                large, held = int(held[0, 0]), held[:0]
            if found or over:
                yield out(found, over)
        if len(held) > 1:
            yield out(links_of(held), [])

    return work


def links(fps: DataFrame) -> DataFrame:
    """``(a, b)``: links of distinct fingerprints ``fp`` that connect all that are within ``MAX_BITS`` bits by steps."""
    rows, width, found = fps.select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("lo"), "fp"), 64, None
    while width > 8:
        index, width = _split(rows, width), width // 2
        most = MOST if width > 8 else 1 << 62
        scanned = index.repartition("key").sortWithinPartitions("key").mapInArrow(_scan(width, most), "a long, b long, key long, lo int, fp long")
        scanned = materialise(scanned, f"links{width}")
        some = scanned.where("a IS NOT NULL").select("a", "b")
        found = some if found is None else found.unionByName(some)
        rows = scanned.where("key IS NOT NULL").select("key", "lo", "fp")
        if rows.isEmpty():
            break
    return found


def _grouped(docs: DataFrame, key: str, text: str, shingle: int, max_bits: int) -> DataFrame:
    """``key, fp, h, c, component_id``: ``c`` is the smallest fingerprint of the group."""
    if max_bits != MAX_BITS:
        raise ValueError(f"the deletion-variant index is built for {MAX_BITS} bits")
    prints = materialise(fingerprints(docs, key, text, shingle), "prints")
    classes = materialise(prints.groupBy("fp").agg(F.min(key).alias("first")), "classes")
    linked = components(links(classes.select("fp")))
    named = materialise(classes.join(linked, classes["fp"] == linked["node"], "left")
                        .select("fp", "first", F.coalesce("component", "fp").alias("c")), "classes-named")
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    by_print = named.join(least, "c").select("fp", "c", "component_id")
    return prints.join(by_print, "fp").select(key, "fp", "h", "c", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """``key, fp, h, component_id``: fingerprint, text hash and the smallest key reachable over links, itself included.

    ``key`` is a long. Null and empty texts have fingerprint 0 and link like any other. Rows with a
    null key get the component of their fingerprint's other rows (null without any). Repeated rows
    stay repeated; an empty table gives an empty result; other columns aren't read.
    """
    return _grouped(docs, key, text, shingle, max_bits).drop("c")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group of near-duplicates, with all columns: a row of the group's smallest key.

    Groups are those of fingerprints, so rows that share a key but not their text stay in the groups
    of their texts. If several rows of a group have its smallest key, the one with the smallest text
    hash stays, and of rows equal in key and text any one. Rows with a null key pass.
    """
    found = _grouped(docs, key, text, shingle, max_bits).where(F.col(key).isNotNull())
    first = found.groupBy("c").agg(F.min(F.struct(F.col(key).alias("k"), "h")).alias("s"))
    first = first.select(F.col("s.k").alias("__ferrule_key"), F.col("s.h").alias("__ferrule_hash"))
    # A key and a text are rows of one group, so these two name one survivor each.
    named = docs.withColumn("__ferrule_hash", F.xxhash64(text))
    kept = named.join(first, (named[key] == first["__ferrule_key"]) & (named["__ferrule_hash"] == first["__ferrule_hash"])).select(named["*"])
    one = kept.withColumn("__ferrule_rank", F.row_number().over(Window.partitionBy(key, "__ferrule_hash").orderBy(F.lit(0)))).where("__ferrule_rank = 1")
    return one.select(*docs.columns).unionByName(docs.where(F.col(key).isNull()))


ship_by_value(__name__)
