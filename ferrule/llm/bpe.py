"""Byte-level BPE encoding and decoding with a published vocabulary.

A short word is merged in a contiguous rank array: the ids of its parts, and the merge rank at
every boundary between two parts. A step scans the ranks for the (leftmost) minimum, deletes
that boundary and refreshes the two ranks beside it. Words of one byte length are merged side
by side as the rows of one matrix: each step takes one boundary from every row, so the matrix
stays rectangular and shrinks by a column. Words over ``SHORT_WORD`` bytes go through a heap
with the same rule, so one very long word costs n log n and not n * n.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ferrule.functions.udf_support import ship_by_value
from ferrule.llm.common import text_slices, worker_cache

#: Fixed value: the word pattern of this vocabulary family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The classes of that pattern over the first 256 code points, for the standard (faster) matcher. Letters come first:
#: only the quoted endings and the run of other characters can start alike.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t-\\r \u0085 "
PATTERN_LATIN = rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
SHORT_WORD = 256
NONE = np.int32(2**31 - 1)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: itself if printable Latin-1, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def hash_tables(keys: np.ndarray) -> list[tuple]:
    """Lookup of a key's number: tables of single slots, each for the keys that found theirs taken in the one before."""
    tables, rest, factor = [], np.arange(len(keys)), 0x9E3779B97F4A7C15
    while len(rest):
        bits = len(rest).bit_length() + 3
        shift = np.uint64(64 - bits)
        slot, first = np.unique(keys[rest].view(np.uint64) * np.uint64(factor) >> shift, return_index=True)
        held, number = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        held[slot], number[slot] = keys[rest[first]], rest[first]
        tables.append((np.uint64(factor), shift, held, number))
        rest = np.delete(rest, first)
        factor = factor * 0xD1342543DE82EF95 % 2**64 | 1
    return tables


class Vocabulary:
    """Ids, merges and word rule of a BPE file (``tokenizers`` JSON) over the byte alphabet."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        ids = data["model"]["vocab"]
        stand_in = byte_alphabet()
        end = data["model"].get("end_of_word_suffix") or ""
        self.byte_ids = np.array([ids[c] for c, _ in sorted(stand_in.items(), key=lambda x: x[1])], dtype=np.int64)
        self.last_ids = np.array([ids[c + end] for c, _ in sorted(stand_in.items(), key=lambda x: x[1])], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.pairs: dict[tuple[int, int], int] = {}
        for left, right in merges:
            self.pairs.setdefault((ids[left], ids[right]), len(self.pairs))
        named = {i: t for t, i in ids.items()}
        self.merged = np.array([ids[named[a].removesuffix(end) + named[b]] if end else ids[named[a] + named[b]] for a, b in self.pairs], dtype=np.int64)
        keys = np.array([a << 32 | b for a, b in self.pairs], dtype=np.int64)
        self.tables = hash_tables(keys)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of = {i: bytes(stand_in[c] for c in t.removesuffix(end)) for t, i in ids.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN).findall
        self.words_latin = re.compile(PATTERN_LATIN).findall

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words(text)
        return self.words_latin(text)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of part ids (``NONE``: no such merge)."""
        key = left << 32 | right
        out = np.full(key.shape, NONE)
        for factor, shift, keys, ranks in self.tables:
            slot = key.view(np.uint64) * factor >> shift
            hit = keys[slot] == key
            out[hit] = ranks[slot[hit]]
        return out

    def parts(self, raw: np.ndarray) -> np.ndarray:
        """First part ids of words, given as rows of bytes: one part a byte."""
        out = self.byte_ids[raw]
        out[:, -1] = self.last_ids[raw[:, -1]]
        return out

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words of one byte length, merged side by side."""
        width = len(words[0])
        parts = self.parts(np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), width))
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        out: list[bytes] = [b""] * len(words)
        which = np.arange(len(words))
        while len(which):
            rows = np.arange(len(which))
            at = ranks.argmin(axis=1) if width > 1 else rows
            low = ranks[rows, at] if width > 1 else np.full(len(which), NONE)
            if (done := low == NONE).any():
                packed, size = parts[done].astype("<u4").tobytes(), 4 * width
                for k, i in enumerate(which[done].tolist()):
                    out[i] = packed[k * size:(k + 1) * size]
                which, parts, ranks, at, low = which[~done], parts[~done], ranks[~done], at[~done], low[~done]
                rows = np.arange(len(which))
                if not len(which):
                    break
            parts[rows, at] = self.merged[low]
            keep = np.ones(parts.shape, dtype=bool)
            keep[rows, at + 1] = False
            parts = parts[keep].reshape(len(which), width - 1)
            keep = np.ones(ranks.shape, dtype=bool)
            keep[rows, at] = False
            ranks = ranks[keep].reshape(len(which), width - 2)
            width -= 1
            left, right = at > 0, at < width - 1
            ranks[rows[left], at[left] - 1] = self.rank(parts[rows[left], at[left] - 1], parts[rows[left], at[left]])
            ranks[rows[right], at[right]] = self.rank(parts[rows[right], at[right]], parts[rows[right], at[right] + 1])
        return out

    def merge_long(self, word: bytes) -> bytes:
        """Packed ids of one word, by a heap of (rank, place); stale entries are known by their ids."""
        part = self.parts(np.frombuffer(word, dtype=np.uint8)[None, :])[0].tolist()
        n = len(part)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (rank := self.pairs.get((part[i], part[j]))) is not None:
                heapq.heappush(heap, (rank, i, part[i], part[j]))

        for i in range(n):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            if part[i] != left or (j := after[i]) >= n or part[j] != right:
                continue
            part[i], part[j], after[i] = int(self.merged[rank]), -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return np.array([p for p in part if p >= 0], dtype="<u4").tobytes()


class WordIds(dict):
    """Word -> its packed ids (little-endian unsigned 32-bit); emptied when ``most`` words are held."""

    def __init__(self, vocabulary: Vocabulary, most: int = 300_000):
        self.vocabulary, self.most = vocabulary, most

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of ``words``; those that aren't held yet are merged, all words of one byte length at a time."""
        if len(self) > self.most:
            self.clear()
        out = {word: self.get(word) for word in words}      # smaller than the cache, so the many lookups stay near
        new = [word for word, ids in out.items() if ids is None]
        by_size: dict[int, list[str]] = {}
        for word in new:
            by_size.setdefault(len(word.encode()), []).append(word)
        for size, names in by_size.items():
            for lo in range(0, len(names), 20_000):
                part = names[lo:lo + 20_000]
                raws = [word.encode() for word in part]
                out.update(zip(part, self.vocabulary.merge_short(raws) if size <= SHORT_WORD else map(self.vocabulary.merge_long, raws), strict=True))
        self.update((word, out[word]) for word in new)
        return out


def encode_texts(texts: list[str | None], vocabulary: Vocabulary, cache: WordIds) -> list[bytes]:
    """Packed ids of whole texts; null counts as empty. Texts of special tokens in a text become their ids."""
    pieces = []
    for text in texts:
        if text and vocabulary.special_re is not None and any(s in text for s in vocabulary.special):
            pieces.append([p for piece in vocabulary.special_re.split(text)
                           for p in ([vocabulary.special[piece]] if piece in vocabulary.special else vocabulary.split(piece))])
        else:
            pieces.append(vocabulary.split(text) if text else [])
    words = set().union(*pieces)
    special = {p: p.to_bytes(4, "little") for p in words if isinstance(p, int)}
    look = (cache.learn(words - special.keys()) | special).__getitem__
    return [b"".join(map(look, p)) for p in pieces]


def decode_ids(ids: bytes | None, vocabulary: Vocabulary) -> str:
    """The text of packed ids; bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary nothing."""
    if not ids:
        return ""
    get = vocabulary.bytes_of.get
    return b"".join([get(i, b"") for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


def _tools(spec: str):
    vocabulary = Vocabulary(spec)
    return vocabulary, WordIds(vocabulary)


def _run(docs: DataFrame, vocab_path: str, in_cols: list[str], schema: str, fill) -> DataFrame:
    spark = docs.sparkSession
    with open(vocab_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())     # bounded: one vocabulary file

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = shared.value
        vocabulary, cache = worker_cache(("bpe", hash(spec)), lambda: _tools(spec))
        for part in text_slices(batches, 1, keep="bpe"):
            yield pa.RecordBatch.from_pydict(fill(part, vocabulary, cache))

    return docs.select(*in_cols).mapInArrow(work, schema)


def encode(docs: DataFrame, vocab_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids``: the ids of every whole text, packed as little-endian unsigned 32-bit integers.

    Null and empty texts give no ids; rows, repeated or not, keep their number. The word cache is
    bounded, and a task holds a few MB of texts at a time, or one longer text.
    """
    def fill(part, vocabulary, cache):
        packed = encode_texts(part.column(1).to_pylist(), vocabulary, cache)
        return {"k": part.column(0), "ids": pa.array(packed, pa.binary())}

    kind = docs.schema[key].dataType.simpleString()
    return _run(docs, vocab_path, [key, text], f"k {kind}, ids binary", fill).withColumnRenamed("k", key)


def decode(encoded: DataFrame, vocab_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text``: the text of every row of packed ids (null: the empty text)."""
    def fill(part, vocabulary, cache):
        return {"k": part.column(0), "text": pa.array([decode_ids(i, vocabulary) for i in part.column(1).to_pylist()], pa.string())}

    kind = encoded.schema[key].dataType.simpleString()
    return _run(encoded, vocab_path, [key, ids], f"k {kind}, text string", fill).withColumnRenamed("k", key)


def round_trip(docs: DataFrame, vocab_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids, decoded``: both directions in one pass over the texts."""
    def fill(part, vocabulary, cache):
        packed = encode_texts(part.column(1).to_pylist(), vocabulary, cache)
        return {"k": part.column(0), "ids": pa.array(packed, pa.binary()),
                "decoded": pa.array([decode_ids(i, vocabulary) for i in packed], pa.string())}

    kind = docs.schema[key].dataType.simpleString()
    return _run(docs, vocab_path, [key, text], f"k {kind}, ids binary, decoded string", fill).withColumnRenamed("k", key)


ship_by_value(__name__)
