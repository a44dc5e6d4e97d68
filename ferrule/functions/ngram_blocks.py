"""Exact totals and distinct word n-grams of a corpus (STR_7) with a small shuffle.

A task numbers the n-grams of about ``run_words`` words by sorting, drops those that the run repeats, and sends
the others as sorted, compressed blocks, one for each order and bucket. A gram's bucket is a hash of its joined
text, so equal grams meet in one group, whatever their first words are, and no group waits for a frequent word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions.text import NGRAM_JOINER
from ferrule.functions.udf_support import ship_by_value

ship_by_value(__name__)

END = "\n"                  # ends a gram in a block; words hold no white space
PRIME = 2147483629          # a text's hash is its bytes as one number modulo this
GROUP_BYTES = 64_000_000    # texts of a bucket that are told apart at once


def _hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the factor by which it moves the hash of what precedes it."""
    return (np.array([int.from_bytes(w, "big") % PRIME for w in words], np.int64),
            np.array([pow(256, len(w), PRIME) for w in words], np.int64))


def word_runs(batches: Iterator[pa.RecordBatch], max_n: int, run_words: int, run_bytes: int = 64_000_000) -> Iterator[tuple]:
    """Words of many texts, and for each word how many there are from it to its text's end (0: only the grams before it need it)."""
    words, left, held, size = [], [], 0, 0
    for batch in batches:
        column = batch.column(0)
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten()
        ends = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
        for lo in range(0, len(flat), run_words):
            hi = min(lo + run_words, len(flat))
            reach = min(hi + max_n - 1, len(flat))
            words.append(flat.slice(lo, reach - lo).cast(pa.large_string()))
            left.append(np.concatenate([ends[lo:hi], np.zeros(reach - hi, np.int64)]))
            held, size = held + hi - lo, size + words[-1].nbytes
            if held >= run_words or size >= run_bytes:
                yield pa.concat_arrays(words), np.concatenate(left)
                words, left, held, size = [], [], 0, 0
    if held:
        yield pa.concat_arrays(words), np.concatenate(left)


def run_blocks(words: pa.Array, left: np.ndarray, max_n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """``n, bucket, places, size, block`` of a run: how many grams stood there, and the different ones in order."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    distinct = coded.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    word = rank[coded.indices.to_numpy()]
    plain = [w.encode() for w in distinct.to_pylist()]
    value, _ = _hashes(plain)
    joined, factor = _hashes([NGRAM_JOINER.encode() + w for w in plain])
    joiner, nothing, end = (pa.scalar(x, pa.large_string()) for x in (NGRAM_JOINER, "", END))
    codec = pa.Codec("zstd", compression_level=3)
    at, gram = np.arange(len(word)), np.zeros(len(word), np.int64)
    for n in range(1, max_n + 1):
        stays = left[at] >= n
        at, gram = at[stays], gram[stays]
        if not len(at):
            return
        _, first, gram, places = np.unique(gram * len(distinct) + word[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
        at_first = at[first]
        key = value[word[at_first]]
        for k in range(1, n):
            w = word[at_first + k]
            key = (key * factor[w] + joined[w]) % PRIME
        bucket = key % buckets
        by_bucket = np.argsort(bucket, kind="stable")
        texts = pc.binary_join_element_wise(*(distinct.take(pa.array(word[at_first[by_bucket] + k])) for k in range(n)), joiner)
        texts = pc.binary_join_element_wise(texts, nothing, end)
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        found, start = np.unique(bucket[by_bucket], return_index=True)
        edge = offsets[np.append(start, len(texts))]
        blocks = [codec.compress(data[int(lo):int(hi)], asbytes=True) for lo, hi in zip(edge[:-1], edge[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(found), n, np.int32)), pa.array(found.astype(np.int32)), pa.array(np.add.reduceat(places[by_bucket], start)),
             pa.array(np.diff(edge)), pa.array(blocks, pa.binary())], ["n", "bucket", "places", "size", "block"])


def count_bucket(blocks: list[bytes], sizes: list[int], most: int = GROUP_BYTES) -> int:
    """Different grams of the blocks; a large bucket is counted in parts by another hash, so that one part is held at a time."""
    codec = pa.Codec("zstd", compression_level=3)
    parts = 1 + sum(sizes) // most
    total = 0
    for part in range(parts):
        seen: set[bytes] = set()
        for block, size in zip(blocks, sizes, strict=True):
            grams = codec.decompress(block, size, asbytes=True).split(END.encode())[:-1]
            seen.update(grams if parts == 1 else (g for g in grams if zlib.crc32(g) % parts == part))
        total += len(seen)
    return total


def ngram_counts(texts: DataFrame, tokens: str, max_n: int = 4, buckets: int = 1024, run_words: int = 2_000_000) -> DataFrame:
    """``n, n_grams, n_distinct`` over a column of token arrays (null: none), n = 1..``max_n``; orders without a gram have no row.

    Grams are equal where their words joined by ``NGRAM_JOINER`` are. ``buckets`` sets how many grams of an order one task
    compares at a time (all different ones / ``buckets``); raise it for larger tables.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, left in word_runs(batches, max_n, run_words):
            yield from run_blocks(words, left, max_n, buckets)

    def count(group: pa.Table) -> pa.Table:
        found = count_bucket(group["block"].to_pylist(), group["size"].to_pylist())
        return pa.table({"n": group["n"][:1], "places": pa.array([pc.sum(group["places"]).as_py()], pa.int64()), "found": pa.array([found], pa.int64())})

    blocks = texts.select(tokens).mapInArrow(send, "n int, bucket int, places long, size long, block binary")
    counts = blocks.groupBy("n", "bucket").applyInArrow(count, "n int, places long, found long")
    return counts.groupBy("n").agg(F.sum("places").alias("n_grams"), F.sum("found").alias("n_distinct"))
