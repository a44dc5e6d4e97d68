"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Both tokenizers cut the same bytes. A byte offset where a token of each ends is a shared cut: the
cut nearest to the middle of an interval is found by bisecting one tokenizer's ends for those of
the other, outwards from the middle, and both halves are taken on alone. An interval without a cut
inside is a group: all of its tokens of one tokenizer are linked with all of the other's.

A blank after a character that is no white space is always a shared cut: the first's word pattern
never puts it into one word with what is before it, and no piece of the second holds a blank behind
something else (checked when the vocabulary is loaded; without that, texts stay whole). So texts
are split there first, and each different part is encoded and aligned once while it is held in a
bounded table. Nothing of a part without blanks is cut short, however long it is.

The texts are read once. A task hands on each document's linked id pairs, and how many documents
hold a pair. Counts of the most frequent pairs go to every task (a bounded table); the others are
looked up by an equality join.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.udf_support import ship_by_value
from ferrule.llm.bpe import Vocabulary, WordIds
from ferrule.llm.common import materialise, text_slices, worker_cache

#: Fixed value: the blank as it stands in pieces.
BLANK = "▁"
#: White space that ends in a byte beyond ASCII (UTF-8 as a number); a blank behind it is no safe cut.
WIDE_SPACE = [int.from_bytes(c.encode(), "big") for c in map(chr, range(128, 0x3001)) if c.isspace()]
HELD = 450_000              # different parts whose alignment a worker holds
SLICE = 4_000_000           # bytes of texts that a task aligns at a time
KNOWN = 262_144             # pairs whose counts every task gets
STEPS = 8                   # steps a factor of two by which pair counts are sorted into classes of frequency


def groups_of(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """Groups ``(a from, a to, b from, b to)`` of tokens that end at ``a`` and ``b``, in order; both end at one place."""
    out, todo = [], [(0, len(a), 0, len(b))] if a else []
    while todo:
        al, ah, bl, bh = todo.pop()
        if ah - al > 1 and bh - bl > 1:
            middle, last = (al + ah - 2) // 2, bh - 1
            for far in range(ah - 1 - middle):      # the right half is never the shorter one
                for i in (middle + far, middle - far):
                    if al <= i < ah - 1:
                        j = bisect_left(b, a[i], bl, last)
                        if j < last and b[j] == a[i]:
                            todo += [(i + 1, ah, j + 1, bh), (al, i + 1, bl, j + 1)]
                            break
                else:
                    continue
                break
            else:
                out.append((al, ah, bl, bh))
        else:
            out.append((al, ah, bl, bh))
    return out


class Pair:
    """Two tokenizers, and the alignment of parts of texts by them."""

    def __init__(self, bpe_json: str, piece_model: bytes):
        import sentencepiece

        self.first = Vocabulary(bpe_json)
        self.first.special, self.first.special_re = {}, None        # their strings are plain text
        self.first_ids = WordIds(self.first, most=50_000)
        self.first_bytes = self.first.bytes_of
        self.second = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        ids = range(self.second.get_piece_size())
        self.width = len(ids)
        names = [self.second.id_to_piece(i) for i in ids]
        self.second_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
        self.first_sizes = np.zeros(max(self.first_bytes) + 1, dtype=np.int64)
        for i, x in self.first_bytes.items():
            self.first_sizes[i] = len(x)
        self.second_sizes = np.array([len(x) for x in self.second_bytes], dtype=np.int64)
        #: Every id in decimal, filled up with zero bytes.
        decimal = [str(i).encode() for i in range(max(len(self.first_sizes), self.width))]
        self.digits = np.array(decimal).view(np.uint8).reshape(len(decimal), -1)
        #: The word pattern of the first puts a blank behind no other character but white space; pieces are looked through.
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in names)
        self.lone_blank = self.second.encode("a ")[len(self.second.encode("a")):]
        self.forget()

    def parts(self, raw: bytes, start: np.ndarray) -> np.ndarray:
        """Where the parts of the texts that begin at ``start`` begin."""
        text = np.frombuffer(raw, dtype=np.uint8)
        if not self.cuts:
            return start
        at = np.flatnonzero(text == 32)
        at = at[at > 0]
        before = text[at - 1].astype(np.int64)
        plain = ~((before <= 32) & ((before >= 28) | (before >= 9) & (before <= 13)))
        wide = before >= 128
        pair = text[at[wide] - 2].astype(np.int64) << 8 | before[wide]
        plain[wide] = ~np.isin(pair, WIDE_SPACE) & ~np.isin(text[at[wide] - 3].astype(np.int64) << 16 | pair, WIDE_SPACE)
        return np.union1d(start, at[plain])

    def align(self, parts: list[bytes], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple:
        """Different parts with their tokens end to end, aligned side by side.

        ``numbers`` of each part (tokens of each, groups, links; zeros if the bytes differ), ``told`` (its groups as text),
        and the linked pairs end to end: how many each part has, the pairs, their number. A pair may come several times in a part.
        """
        size = np.array([len(p) for p in parts], dtype=np.int64)
        of_a, of_b = np.repeat(np.arange(len(parts)), n_a), np.repeat(np.arange(len(parts)), n_b)
        size_a, size_b = self.first_sizes[a], self.second_sizes[b]
        # The first's tokens are the bytes themselves; the second's are compared where they are as many.
        good = (np.bincount(of_a, size_a, len(parts)) == size) & (np.bincount(of_b, size_b, len(parts)) == size)
        left = np.frombuffer(b"".join([p for p, g in zip(parts, good.tolist(), strict=True) if g]), dtype=np.uint8)
        right = np.frombuffer(b"".join(map(self.second_bytes.__getitem__, b[good[of_b]].tolist())), dtype=np.uint8)
        if (differ := left != right).any():
            good[np.repeat(np.flatnonzero(good), size[good])[differ]] = False
        use_a, use_b = good[of_a], good[of_b]
        a, b, of_a, of_b = a[use_a], b[use_b], of_a[use_a], of_b[use_b]
        first_ends, second_ends = np.cumsum(size_a[use_a]), np.cumsum(size_b[use_b])
        # Every part ends at a shared cut. Where all tokens end alike, each is a group; the other parts are searched together.
        like = (n_a == n_b) & good
        twin_a, twin_b = np.flatnonzero(like[of_a]), np.flatnonzero(like[of_b])
        like[of_a[twin_a[first_ends[twin_a] != second_ends[twin_b]]]] = False
        last_a, last_b = like[of_a], like[of_b]
        rest_a, rest_b = np.flatnonzero(~last_a), np.flatnonzero(~last_b)
        found = np.array(groups_of(first_ends[rest_a].tolist(), second_ends[rest_b].tolist()), dtype=np.int64).reshape(-1, 4)
        last_a[rest_a[found[:, 1] - 1]] = last_b[rest_b[found[:, 3] - 1]] = True
        ah, bh = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        al, bl = np.concatenate([[0], ah[:-1]])[:len(ah)], np.concatenate([[0], bh[:-1]])[:len(bh)]
        wide_a, wide_b = ah - al, bh - bl
        cells, whose = wide_a * wide_b, of_a[ah - 1]
        sums = lambda x: np.bincount(whose, x, len(parts)).astype(np.int64)
        links = np.zeros(len(parts), dtype=np.int64)
        np.add.at(links, whose, cells)
        numbers = np.stack([sums(wide_a), sums(wide_b), np.bincount(whose, minlength=len(parts)), links], axis=1)

        few = cells <= 64
        many = np.where(few, cells, 0)
        place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        across = np.repeat(wide_b, many)
        keys = a[np.repeat(al, many) + place // across] * self.width + b[np.repeat(bl, many) + place % across]
        times, owner = np.ones(len(keys), dtype=np.int64), np.repeat(whose, many)
        if not few.all():
            more = [(keys, times, owner)]
            for g in np.flatnonzero(~few).tolist():
                (x, i), (y, j) = (np.unique(v, return_counts=True) for v in (a[al[g]:ah[g]], b[bl[g]:bh[g]]))
                more.append(((x[:, None] * self.width + y).ravel(), (i[:, None] * j).ravel(), np.full(len(x) * len(y), whose[g])))
            keys, times, owner = (np.concatenate(x) for x in zip(*more, strict=True))
            order = np.argsort(owner, kind="stable")
            keys, times, owner = keys[order], times[order], owner[order]

        # The text: each group's tokens of the first, then of the second; a token's digits, and the sign behind it.
        at_a = np.arange(len(a)) + np.repeat(bl, wide_a)
        at_b = np.arange(len(b)) + np.repeat(ah, wide_b)
        ids, sign = np.empty(len(a) + len(b), dtype=np.int64), np.full(len(a) + len(b), ord(","), dtype=np.uint8)
        ids[at_a], ids[at_b] = a, b
        sign[at_a[last_a]], sign[at_b[last_b]] = ord("|"), ord(";")
        shown = np.concatenate([self.digits[ids], sign[:, None]], axis=1)
        line = np.concatenate([[0], np.cumsum((shown != 0).sum(axis=1))])
        stop = line[np.cumsum(numbers[:, 0] + numbers[:, 1])].tolist()
        text = shown[shown != 0].tobytes()
        told = [text[lo:hi - 1] if hi > lo else b"" for lo, hi in zip([0, *stop[:-1]], stop, strict=True)]
        return numbers, told, np.bincount(owner, minlength=len(parts)), keys, times

    def places(self, parts: list[bytes]) -> np.ndarray:
        """Where the alignments of different parts are held; those that aren't yet are encoded together."""
        if len(self.index) > HELD or len(self.keys) > 16 * HELD:
            self.forget()
        new = [p for p in parts if p not in self.index]
        for lo in range(0, len(new), 20_000):
            some = new[lo:lo + 20_000]
            texts = [p.decode() for p in some]
            words = [self.first.split(t) for t in texts]
            ids = self.first_ids.learn(set().union(*words))
            first = [b"".join([ids[w] for w in split]) for split in words]
            second = [b if len(p) > 1 else self.lone_blank for p, b in zip(some, self.second.encode([t[1:] for t in texts], num_threads=1), strict=True)]
            sizes = np.array([len(x) for x in second], dtype=np.int64)
            got = self.align(some, np.frombuffer(b"".join(first), dtype="<u4").astype(np.int64), np.array([len(x) for x in first], dtype=np.int64) // 4,
                             np.fromiter(chain.from_iterable(second), np.int64, int(sizes.sum())), sizes)
            self.index.update(zip(some, range(len(self.told), len(self.told) + len(some)), strict=True))
            self.told += got[1]
            self.numbers = np.concatenate([self.numbers, got[0]])
            self.sizes, self.keys, self.times = (np.concatenate(x) for x in zip((self.sizes, self.keys, self.times), got[2:], strict=True))
        return np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))

    def forget(self) -> None:
        """Empties the table of alignments: texts of groups by place, their numbers, and their linked pairs end to end."""
        self.index: dict[bytes, int] = {}
        self.told: list[bytes] = []
        self.numbers = np.zeros((0, 4), dtype=np.int64)     # no tokens: the bytes differ
        self.sizes, self.keys, self.times = (np.zeros(0, dtype=np.int64) for _ in range(3))


ROWS = ("row long, k {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs array<long>, links array<long>, pair long, docs long")


def _align_slice(keys: pa.Array, texts: list[bytes | None], tools: Pair, row: int) -> Iterator[dict]:
    """Columns of ``ROWS``: one row for each text, and one for each different pair with the number of texts that hold it."""
    n = len(texts)
    full = np.array([i for i, t in enumerate(texts) if t], dtype=np.int64)
    lines = [b" " + texts[i] for i in full]
    raw = b"".join(lines)
    start = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
    cut = tools.parts(raw, start[:-1]) if lines else start[:0]
    words = pa.Array.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(np.append(cut, len(raw)).astype(np.int64)), pa.py_buffer(raw)])
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    place = tools.places(coded.dictionary.to_pylist())
    kinds = len(place)
    whose = np.searchsorted(start, cut, side="right") - 1      # text of every part, among the full ones
    numbers = tools.numbers[place]
    bad = numbers[:, 0] == 0
    good = np.ones(len(full), dtype=bool)
    good[whose[bad[code]]] = False                  # one part whose bytes differ: the text has no tokens
    totals = np.zeros((n, 4), dtype=np.int64)
    sums = np.zeros((len(full), 4), dtype=np.int64)
    edge = np.searchsorted(whose, np.arange(len(full) + 1))
    if len(full):
        sums = np.add.reduceat(numbers[code], edge[:-1])
    totals[full[good]] = sums[good]
    digest = [""] * n
    told = [tools.told[i] for i in place.tolist()]
    listed = code.tolist()
    for i in np.flatnonzero(good).tolist():
        digest[full[i]] = hashlib.sha256(b";".join([told[c] for c in listed[edge[i]:edge[i + 1]]])).hexdigest()

    use = good[whose]
    cell, times = np.unique(whose[use] * max(1, kinds) + code[use], return_counts=True)
    size, stops = tools.sizes[place], np.cumsum(tools.sizes)
    own = np.repeat(stops[place] - size - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    flat, weight = tools.keys[own], tools.times[own]        # the pairs of this slice's parts, end to end
    first = np.cumsum(size) - size
    name, number = np.unique(flat, return_inverse=True)
    kind, text = cell % max(1, kinds), cell // max(1, kinds)
    many = size[kind]
    at = np.repeat(first[kind] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    linked = np.repeat(text, many) * max(1, len(name)) + number[at]
    order = np.argsort(linked, kind="stable")
    linked, strength = linked[order], (weight[at] * np.repeat(times, many))[order]
    new = np.flatnonzero(np.concatenate([[True], linked[1:] != linked[:-1]])) if len(linked) else np.zeros(0, np.int64)
    strength = np.add.reduceat(strength, new) if len(new) else strength
    linked = linked[new]
    owner, pair = full[linked // max(1, len(name))], linked % max(1, len(name))
    stop = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(stop), pa.array(x))
    none = lambda kind, m: pa.nulls(m, kind)
    yield {"row": pa.array(row + np.arange(n)), "k": keys, **{c: pa.array(totals[:, i]) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
           "groups_sha256": pa.array(digest, pa.string()), "pairs": lists(name[pair]), "links": lists(strength),
           "pair": none(pa.int64(), n), "docs": none(pa.int64(), n)}
    m = len(name)
    yield {"row": none(pa.int64(), m), "k": none(keys.type, m), **{c: none(pa.int64(), m) for c in ("n_a", "n_b", "n_groups", "n_links")},
           "groups_sha256": none(pa.string(), m), "pairs": none(pa.list_(pa.int64()), m), "links": none(pa.list_(pa.int64()), m),
           "pair": pa.array(name), "docs": pa.array(np.bincount(pair, minlength=m))}


def _aligned_rows(docs: DataFrame, bpe_path: str, piece_path: str, key: str, text: str) -> tuple[DataFrame, int]:
    with open(bpe_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        files = (uuid.uuid4().hex, f.read(), g.read())      # bounded: two vocabulary files
    shared = docs.sparkSession.sparkContext.broadcast(files)
    width = Pair(json.dumps(json.loads(files[1])), files[2]).width
    fields = ROWS.format(kind=docs.schema[key].dataType.simpleString())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, bpe_json, piece_model = shared.value
        tools = worker_cache(("align", name), lambda: Pair(bpe_json, piece_model))
        row = TaskContext.get().partitionId() << 33
        for part in text_slices(batches, 1, most=SLICE, keep="align"):
            for columns in _align_slice(part.column(0), part.column(1).cast(pa.binary()).to_pylist(), tools, row):
                if len(columns["row"]):
                    yield pa.RecordBatch.from_pydict(columns)
            row += part.num_rows

    return materialise(docs.select(key, text).mapInArrow(work, fields), "aligned", compression="zstd"), width


def align(docs: DataFrame, bpe_path: str, piece_path: str, key: str = "doc_id", text: str = "text", known: int = KNOWN) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    Every text, with a blank before it, is encoded by both vocabularies without special tokens. An id
    pair's count is the number of rows whose texts link it; ``n_best`` are the links whose count is
    the highest of their first id, ties included, ``count_sum`` sums the counts over all links.

    Texts that are null or empty, or that the tokens of either vocabulary don't give back byte for
    byte, have zeros and an empty digest, and don't count for any pair. Repeated rows count again and
    keep their rows, null keys too; an empty table gives an empty result; other columns aren't read.
    """
    rows, width = _aligned_rows(docs, bpe_path, piece_path, key, text)
    counts = rows.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("docs").alias("c")).where("c > 0")
    counts = materialise(counts, "pair-counts")
    top = counts.groupBy(F.expr(f"pair div {width}").alias("first")).agg(F.max("c").alias("top"))
    rated = counts.withColumn("first", F.expr(f"pair div {width}")).join(top, "first").select("pair", "c", (F.col("c") == F.col("top")).alias("best"))
    rated = materialise(rated, "pair-ranks")
    frequency = F.floor(F.log2("c") * STEPS)
    least, room = 1 << 20, known
    for step in rated.groupBy(frequency.alias("f")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("f")).collect():     # at most 64 * STEPS rows
        if step["n"] > room:
            break
        least, room = step["f"], room - step["n"]
    head = rated.where(frequency >= least).toArrow().sort_by("pair")       # at most ``known`` rows
    shared = docs.sparkSession.sparkContext.broadcast(tuple(head.column(c).to_numpy() for c in ("pair", "c", "best")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, c, best = shared.value
        for batch in batches:
            pairs, links = batch.column(1), batch.column(2)
            edge = pairs.offsets.to_numpy().astype(np.int64)
            flat, weight = (x.values.to_numpy()[edge[0]:edge[-1]] for x in (pairs, links))
            owner = np.repeat(np.arange(len(pairs)), np.diff(edge))
            at = np.minimum(np.searchsorted(pair, flat), max(0, len(pair) - 1))
            hit = pair[at] == flat if len(pair) else np.zeros(len(flat), dtype=bool)
            sums = np.zeros((len(pairs), 2), dtype=np.int64)
            np.add.at(sums[:, 0], owner[hit], weight[hit] * best[at[hit]])
            np.add.at(sums[:, 1], owner[hit], weight[hit] * c[at[hit]])
            rest = np.searchsorted(owner[~hit], np.arange(len(pairs) + 1)).astype(np.int32)
            struct = pa.StructArray.from_arrays([pa.array(flat[~hit]), pa.array(weight[~hit])], ["pair", "n"])
            yield pa.RecordBatch.from_pydict({"row": batch.column(0), "best": pa.array(sums[:, 0]), "total": pa.array(sums[:, 1]),
                                              "tail": pa.ListArray.from_arrays(pa.array(rest), struct)})

    texts = rows.where("row IS NOT NULL")
    looked = texts.select("row", "pairs", "links").mapInArrow(work, "row long, best long, total long, tail array<struct<pair: long, n: long>>")
    looked = materialise(looked, "pair-sums")
    asked = looked.select("row", F.explode("tail").alias("t")).select("row", "t.pair", "t.n").join(rated.where(frequency < least), "pair")
    more = asked.select("row", (F.col("n") * F.col("best").cast("long")).alias("best"), (F.col("n") * F.col("c")).alias("total"))
    sums = looked.select("row", "best", "total").unionByName(more).groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("total").alias("count_sum"))
    return texts.select("row", "k", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row").select(
        F.col("k").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def best_links(docs: DataFrame, bpe_path: str, piece_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``a_id, b_id, docs``: for every id of the first vocabulary its most often linked ids of the second, ties included."""
    rows, width = _aligned_rows(docs, bpe_path, piece_path, key, text)
    counts = rows.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("docs").alias("docs")).where("docs > 0")
    named = counts.select(F.expr(f"cast(pair div {width} AS int)").alias("a_id"), F.expr(f"cast(pair % {width} AS int)").alias("b_id"), "docs")
    return named.withColumn("place", F.rank().over(Window.partitionBy("a_id").orderBy(F.desc("docs")))).where("place = 1").drop("place")


ship_by_value(__name__)
