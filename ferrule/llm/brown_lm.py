"""Brown class-based bigram language model, clustered by exchange.

A text is its words, lower-cased in A-Z, and one end. Its probability is the product over its
tokens of P(class | class before) and P(word | class); before the first word stands an end.

*Units.* The exchange moves units between classes. The ``unit_words`` most frequent words are a
unit each; every other word, seen or not, belongs to one of ``shapes`` units by a hash of its last
three bytes. So each word of any text has a class without a lookup in a table that grows with the
corpus, and the pair counts that the exchange works on are bounded by the square of the units.

*Exchange.* Each unit is a row with its neighbours and their counts. In a round, the tasks compute
for one group of units where each of them would raise the likelihood most, given the classes and
class-pair counts so far; all of a group move at once, and the moves stand if the likelihood of
all training tokens rises. Everything is a function of integer counts, so neither partitioning nor
a repeated task changes the classes.

*Smoothing.* Class pairs are smoothed by the class frequencies, words by 0.1 for each word of the
class and for one unseen word.

*Scoring.* Counts of the ``known_words`` most frequent words go to every task (a bounded table);
the other words of a document are looked up by an equality join with all counts.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions.udf_support import ship_by_value
from ferrule.llm.common import materialise, split_words, text_slices, worker_cache

#: Words are separated by the bytes 0x20 and 0x09 to 0x0D; only A-Z are lower-cased.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
END = b""                   # the end token: no word is empty
ADD = 0.1                   # smoothing of word counts, given by the base score
LONG = 256                  # longer words are known by a blank and their 128-bit digest
SLICE = 16_000_000          # bytes of texts that a task counts at a time
STEPS = 8                   # steps a factor of two by which word counts are sorted into classes of frequency
SHAPE = 3                   # last bytes of a word that give its shape


@dataclass
class Model:
    """A fitted model. ``known`` holds the frequent words by rank (the end first); ``rest`` the counts of all other words."""

    known: list[bytes]
    counts: np.ndarray          # of the known words
    units: np.ndarray           # unit of the known words
    unit_words: int
    shapes: int
    classes: np.ndarray         # class of every unit
    tokens: int                 # training tokens, ends included
    words: int                  # different ones
    class_tokens: np.ndarray
    class_words: np.ndarray
    pairs: np.ndarray           # class-pair counts
    rest: DataFrame             # word, c

    def transitions(self) -> np.ndarray:
        """log10 P(class | class before); every row of probabilities sums to 1."""
        share = (self.class_tokens + 1) / (self.tokens + len(self.class_tokens))
        return np.log10((self.pairs + share) / (self.pairs.sum(axis=1, keepdims=True) + 1))

    def class_sizes(self) -> np.ndarray:
        """log10 of what word counts of a class are divided by: its tokens, and ADD for each of its words and an unseen one."""
        return np.log10(self.class_tokens + ADD * (self.class_words + 1))

    def base_size(self) -> float:
        return float(np.log10(self.tokens + ADD * (self.words + 1)))

    def likelihood(self) -> float:
        return objective(self.pairs)


def objective(pairs: np.ndarray) -> float:
    """The part of the training log likelihood (natural log) that depends on the classes."""
    h = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return h(pairs) - h(pairs.sum(axis=0)) - h(pairs.sum(axis=1))


def shape(word: bytes, unit_words: int, shapes: int) -> int:
    return unit_words + zlib.crc32(word[-SHAPE:]) % shapes


def word_codes(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of some texts, the words as numbers of these, in order, and the number of words a text."""
    words, size = split_words(texts, WORD_BYTES)
    coded = words.dictionary_encode()
    kinds = coded.dictionary.to_pylist()
    if len(kinds) and pc.max(pc.binary_length(coded.dictionary)).as_py() > LONG:
        kinds = [w if len(w) <= LONG else b" " + xxhash.xxh3_128_digest(w) for w in kinds]
    return kinds, coded.indices.to_numpy().astype(np.int64), size


def with_ends(codes: np.ndarray, size: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all texts with ``end`` after each text, and where each text begins."""
    stop = np.cumsum(size + 1)
    out = np.full(int(stop[-1]) if len(stop) else 0, end, dtype=np.int64)
    inside = np.ones(len(out), dtype=bool)
    inside[stop - 1] = False
    out[inside] = codes
    return out, stop - size - 1


def _word_counts(docs: DataFrame, text: str) -> DataFrame:
    """``word, c`` over all texts; the end is the empty word."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 0, most=SLICE):
            kinds, codes, _ = word_codes(part.column(0))
            yield pa.RecordBatch.from_pydict({"word": pa.array([*kinds, END], pa.binary()),
                                              "n": pa.array(np.append(np.bincount(codes, minlength=len(kinds)), part.num_rows))})

    return docs.select(text).mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _unit_pairs(docs: DataFrame, text: str, lookup) -> DataFrame:
    """``unit, other, n`` over all neighbours in all texts, the end on both sides of each."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, known, units, unit_words, shapes = lookup.value
        rank = worker_cache(("brown", name), lambda: {w: int(u) for w, u in zip(known, units, strict=True)})
        for part in text_slices(batches, 0, most=SLICE // 2, keep="brown"):
            kinds, codes, size = word_codes(part.column(0))
            unit = np.array([u if (u := rank.get(w)) is not None else shape(w, unit_words, shapes) for w in kinds], dtype=np.int64)
            line, _ = with_ends(unit[codes], size, 0)
            pair, n = np.unique(np.concatenate([[0], line[:-1]]) * (unit_words + shapes) + line, return_counts=True)
            yield pa.RecordBatch.from_pydict({"unit": pa.array((pair // (unit_words + shapes)).astype(np.int32)),
                                              "other": pa.array((pair % (unit_words + shapes)).astype(np.int32)), "n": pa.array(n)})

    return docs.select(text).mapInArrow(work, "unit int, other int, n long").groupBy("unit", "other").agg(F.sum("n").alias("n"))


def _neighbours(pairs: DataFrame) -> DataFrame:
    """One row a unit: ``unit, side, n`` with ``side`` twice the neighbour's unit, and one more where the neighbour comes first.

    A row holds at most twice the number of units.
    """
    both = pairs.select(F.explode(F.array(F.struct("unit", (F.col("other") * 2).alias("side"), "n"),
                                          F.struct(F.col("other").alias("unit"), (F.col("unit") * 2 + 1).alias("side"), "n"))).alias("e")).select("e.*")
    held = both.groupBy("unit").agg(F.collect_list(F.struct("side", "n")).alias("e"))
    return held.select("unit", F.col("e.side").alias("side"), F.col("e.n").alias("n"))


def class_vectors(side: np.ndarray, n: np.ndarray, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the classes that follow a unit, and of those that come before it."""
    group = classes[side >> 1]
    after = side & 1 == 0
    return (np.bincount(group[after], weights=n[after], minlength=k), np.bincount(group[~after], weights=n[~after], minlength=k))


def best_class(own: int, right: np.ndarray, left: np.ndarray, self_pairs: float, pairs: np.ndarray) -> tuple[int, float]:
    """The class in which a unit raises the objective most, and by how much against its ``own``. Class 0 (the end) is closed."""
    h = lambda x: x * np.log(np.maximum(x, 1))
    right, left, m = right.copy(), left.copy(), pairs.astype(np.float64)
    m[own] -= right
    m[:, own] -= left
    m[own, own] += self_pairs       # taken away with both sides
    right[own] -= self_pairs
    left[own] -= self_pairs
    hm, some_right, some_left = h(m), np.flatnonzero(right), np.flatnonzero(left)
    gain = (h(m[:, some_right] + right[some_right]) - hm[:, some_right]).sum(axis=1)
    gain += (h(m[some_left] + left[some_left, None]) - hm[some_left]).sum(axis=0)
    at = np.arange(len(m))
    d = m[at, at]                   # the cell of the class with itself gets both sides and the unit's own pairs
    gain += h(d + right + left + self_pairs) - h(d + right) - h(d + left) + h(d)
    row, column = m.sum(axis=1) + left, m.sum(axis=0) + right       # wherever the unit goes, its neighbours keep it
    gain -= h(row + right.sum() + self_pairs) - h(row) + h(column + left.sum() + self_pairs) - h(column)
    gain[0] = -np.inf
    best = int(gain.argmax())
    return best, float(gain[best] - gain[own])


def _class_pairs(table: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """Counts of class pairs under ``classes``; at most ``k * k`` rows come back."""
    shared = table.sparkSession.sparkContext.broadcast(classes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = shared.value, np.zeros((k, k), dtype=np.int64)
        for batch in batches:
            for unit, side, n in zip(batch.column(0).to_numpy(), batch.column(1), batch.column(2), strict=True):
                right, _ = class_vectors(side.values.to_numpy(), n.values.to_numpy(), held, k)
                out[held[unit]] += right.astype(np.int64)
        cell = np.flatnonzero(out)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cell), "n": pa.array(out.ravel()[cell])})

    sums = table.mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(k * k, dtype=np.int64)
    for cell, n in sums:
        out[cell] = n
    return out.reshape(k, k)


def _moves(table: DataFrame, classes: np.ndarray, pairs: np.ndarray, part: int, parts: int) -> list:
    """``(unit, class)`` of the units of one part that would gain by a move; at most one row a unit comes back."""
    shared = table.sparkSession.sparkContext.broadcast((classes, pairs))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = shared.value
        for batch in batches:
            found = []
            for unit, side, n in zip(batch.column(0).to_numpy(), batch.column(1), batch.column(2), strict=True):
                side, n = side.values.to_numpy(), n.values.to_numpy()
                right, left = class_vectors(side, n, held, len(counts))
                best, gain = best_class(int(held[unit]), right, left, float(n[side == 2 * unit].sum()), counts)
                if gain > 1e-6:
                    found.append((int(unit), best))
            yield pa.RecordBatch.from_pydict({"unit": pa.array([u for u, _ in found], pa.int32()), "best": pa.array([b for _, b in found], pa.int32())})

    return table.where(f"unit > 0 AND unit % {parts} = {part}").mapInArrow(work, "unit int, best int").collect()


def exchange(table: DataFrame, units: int, k: int, sweeps: int, parts: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of all units, the class-pair counts, and the objective after every round that stood."""
    classes = np.zeros(units, dtype=np.int64)
    classes[1:] = 1 + np.arange(units - 1) % (k - 1)
    pairs = _class_pairs(table, classes, k)
    gone = [objective(pairs)]
    for sweep in range(sweeps):
        before = gone[-1]
        for part in range(parts):
            moved = classes.copy()
            for unit, best in _moves(table, classes, pairs, part, parts):
                moved[unit] = best
            if (moved == classes).all():
                continue
            counted = _class_pairs(table, moved, k)
            if (value := objective(counted)) > gone[-1]:
                classes, pairs = moved, counted
                gone.append(value)
        if gone[-1] - before <= 1e-4 * abs(gone[-1]):
            break
    return classes, pairs, gone


def learn(docs: DataFrame, text: str = "text", n_classes: int = 64, unit_words: int = 8192, shapes: int = 512,
          known_words: int = 131_072, sweeps: int = 3, parts: int = 3) -> Model:
    """Fit a model on all texts of ``docs``; null texts count as empty (an end alone).

    Every token of every text is counted. ``known_words``, ``unit_words``, ``shapes`` and ``n_classes``
    bound what tasks and the driver hold (the known words have at most 256 bytes each), whatever the
    input's size. Repeated rows count again; an empty table gives a model of one unseen word.
    """
    sc = docs.sparkSession.sparkContext
    frequency = F.floor(F.log2("c") * STEPS)
    counts = materialise(_word_counts(docs, text), "words")
    steps = counts.groupBy(frequency.alias("f")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).orderBy(F.desc("f")).collect()  # at most 64 * STEPS rows
    least, room = 1 << 20, known_words
    for row in steps:
        if row["n"] > room:
            break
        least, room = row["f"], room - row["n"]
    # The most frequent words, at most ``known_words``: no step is cut, so ties need no order.
    found = counts.where(frequency >= least).where(F.col("word") != F.lit(END)).toArrow()
    head = sorted(zip(found.column("word").to_pylist(), found.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    known, known_counts = [END, *(w for w, _ in head)], np.array([ends, *(c for _, c in head)], dtype=np.int64)
    units = np.array([i if i < unit_words else shape(w, unit_words, shapes) for i, w in enumerate(known)], dtype=np.int64)
    rest = counts.where((frequency < least) & (F.col("word") != F.lit(END)))

    total, kinds = np.zeros(unit_words + shapes, dtype=np.int64), np.zeros(unit_words + shapes, dtype=np.int64)
    np.add.at(total, units, known_counts)
    np.add.at(kinds, units, known_counts > 0)
    by_shape = (F.crc32(F.expr(f"substring(word, -{SHAPE}, {SHAPE})")) % shapes).alias("s")
    for row in rest.groupBy(by_shape).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect():       # at most ``shapes`` rows
        total[unit_words + row["s"]] += row["c"]
        kinds[unit_words + row["s"]] += row["n"]

    lookup = sc.broadcast((uuid.uuid4().hex, known, units, unit_words, shapes))
    table = materialise(_neighbours(_unit_pairs(docs, text, lookup)), "units")
    classes, pairs, _ = exchange(table, unit_words + shapes, n_classes, sweeps, parts)
    by_class = lambda x: np.bincount(classes, weights=x, minlength=n_classes).astype(np.int64)
    return Model(known, known_counts, units, unit_words, shapes, classes, int(total.sum()), int(kinds.sum()), by_class(total), by_class(kinds), pairs, rest)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every row.

    ``score`` is the model's log10 probability of the whole text and its end, ``perplexity`` 10 to
    the power of -score / n_tokens; ``base_score`` is that of the words alone, without classes. A null
    or empty text is an end. Repeated rows and null keys keep their rows; an empty table gives an
    empty result; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        (uuid.uuid4().hex, model.known, np.log10(model.counts + ADD), model.counts > 0, model.units, model.unit_words, model.shapes, model.classes,
         model.transitions(), model.class_sizes(), model.base_size()))
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, known, logs, seen, units, unit_words, shapes, classes, transitions, sizes, base_size = shared.value
        rank = worker_cache(("brown", name), lambda: {w: i for i, w in enumerate(known)})
        row = (TaskContext.get().partitionId() << 33) - 1
        for part in text_slices(batches, 1, most=SLICE // 2, keep="brown"):
            kinds, codes, size = word_codes(part.column(1))
            at = np.array([rank.get(w, -1) for w in kinds], dtype=np.int64)
            rare = at < 0
            unit = units[at]
            unit[rare] = [shape(kinds[i], unit_words, shapes) for i in np.flatnonzero(rare).tolist()]
            word_log = np.where(rare, 0.0, logs[at])            # of the other words, the join brings it
            of_end = len(kinds)
            line, begin = with_ends(codes, size, of_end)
            group = np.append(classes[unit], 0)[line]
            fit = transitions[np.concatenate([[0], group[:-1]]), group] - sizes[group]
            head = np.add.reduceat(np.append(word_log, logs[0])[line], begin)
            known_tokens = np.add.reduceat(np.append(~rare, seen[0])[line].astype(np.int64), begin)
            other = np.append(rare, False)[line]
            cell, n = np.unique(np.repeat(np.arange(len(size)), size + 1)[other] * (of_end + 1) + line[other], return_counts=True)
            edge = np.searchsorted(cell, np.arange(len(size) + 1) * (of_end + 1)).astype(np.int32)
            word = pa.array(kinds, pa.binary()).take(pa.array(cell % (of_end + 1)))
            tail = pa.ListArray.from_arrays(pa.array(edge), pa.StructArray.from_arrays([word, pa.array(n)], ["word", "n"]))
            yield pa.RecordBatch.from_pydict({
                "row": pa.array(row + 1 + np.arange(len(size))), "k": part.column(0), "n_tokens": pa.array(size + 1), "known": pa.array(known_tokens),
                "base": pa.array(head - (size + 1) * base_size), "fit": pa.array(head + np.add.reduceat(fit, begin)), "tail": tail})
            row += len(size)

    fields = f"row long, k {kind}, n_tokens long, known long, base double, fit double, tail array<struct<word: binary, n: long>>"
    rows = materialise(docs.select(key, text).mapInArrow(work, fields), "scored")
    asked = rows.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n")
    told = asked.join(model.rest, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("found"))
    full = rows.drop("tail").join(told, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    value = F.col("fit") + more
    return full.select(F.col("k").alias(key), "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
                       F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), value.alias("score"),
                       F.pow(F.lit(10.0), -value / F.col("n_tokens")).alias("perplexity"))


ship_by_value(__name__)
