"""Quality classifier: a factorisation machine.

Features of a document are hashed words (present or not, scaled to unit length), statistics
of its structure, and metadata. The score is the logistic of
``w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``; the pairwise part is computed in linear
time as ``(|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2) / 2``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions.udf_support import ship_by_value
from ferrule.llm.common import hash_sample, text_slices
from ferrule.llm.simhash import word_chunks

BUCKETS = 1 << 15
STATS = ("words", "word_bytes", "marks", "exclaims", "bars", "upper", "digits", "not_ascii", "different", "top_word", "repeats",
         "lines", "line_repeats", "stops", "commas", "n_chars", "no_n_chars")


def describe(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(word buckets, structure statistics) of a whole text; null counts as empty."""
    raw = (text or "").encode()
    words: Counter[bytes] = Counter()
    n = repeats = 0
    last = b""
    for chunk in word_chunks(raw):
        words.update(chunk)
        n += len(chunk)
        repeats += sum(map(bytes.__eq__, chunk, [last, *chunk]))
        last = chunk[-1] if chunk else last
    lines = [x for x in raw.split(b"\n") if x.strip()]
    size, most = max(1, len(raw)), max(1, n)
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    stats = (math.log1p(n), size / most / 10, share(b"#*$%&<>"), share(b"!"), share(b"|"), share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"),
             share(bytes(range(128, 256))), len(words) / most, max(words.values(), default=0) / most, repeats / most,
             len(lines) / most, 1 - len(set(lines)) / max(1, len(lines)), share(b".?;:"), share(b","),
             math.log1p(max(0, n_chars or 0)), float(n_chars is None))
    buckets = np.fromiter(map(crc32, {w.lower() for w in words}), dtype=np.int64) % BUCKETS
    return np.unique(buckets), np.array(stats)


class Machine:
    """Weights ``w0``, ``w`` and factors ``v`` over word buckets, then standardised statistics."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, factors: int, seed: int):
        self.mean, self.spread = mean, spread
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(BUCKETS + len(STATS))
        self.v = rng.normal(0, 0.05, (BUCKETS + len(STATS), factors))

    def rows(self, described: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows as (feature, value, first entry of each row); every row has all statistics, so none is empty."""
        index, value, first, at = [], [], [], 0
        own = BUCKETS + np.arange(len(STATS))
        for buckets, stats in described:
            z = np.clip((stats - self.mean) / self.spread, -4, 4) / 4
            index += [buckets, own]
            value += [np.full(len(buckets), 1 / math.sqrt(max(1, len(buckets)))), z]
            first.append(at)
            at += len(buckets) + len(own)
        return np.concatenate(index), np.concatenate(value), np.array(first)

    def raw(self, index: np.ndarray, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic, and the factor sums of each row (the sum-of-squares identity)."""
        vx = self.v[index] * value[:, None]
        total = np.add.reduceat(vx, first)
        squares = np.add.reduceat((vx * vx).sum(axis=1), first)
        return self.w0 + np.add.reduceat(self.w[index] * value, first) + ((total * total).sum(axis=1) - squares) / 2, total

    def predict(self, described: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.rows(described))[0], -35, 35)))

    def fit(self, described: list, labels: np.ndarray, epochs: int, rate: float, shrink: float, batch: int, seed: int) -> None:
        """Minimises the log loss by AdaGrad over mini-batches."""
        rng = np.random.default_rng(seed)
        gw, gv, g0 = np.full(self.w.shape, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(described))
            for lo in range(0, len(order), batch):
                part = order[lo:lo + batch]
                index, value, first = self.rows([described[i] for i in part])
                score, total = self.raw(index, value, first)
                error = (1 / (1 + np.exp(-np.clip(score, -35, 35))) - labels[part]) / len(part)
                each = np.repeat(np.arange(len(part)), np.diff([*first, len(index)]))
                pull = (error[each] * value)[:, None]
                touched, place = np.unique(index, return_inverse=True)
                dw = np.bincount(place, pull[:, 0], minlength=len(touched)) + shrink * self.w[touched]
                step = pull * (total[each] - self.v[index] * value[:, None])
                dv = np.stack([np.bincount(place, step[:, f], minlength=len(touched)) for f in range(step.shape[1])], axis=1) + shrink * self.v[touched]
                gw[touched] += dw * dw
                gv[touched] += dv * dv
                g0 += error.sum() ** 2
                self.w[touched] -= rate * dw / np.sqrt(gw[touched])
                self.v[touched] -= rate * dv / np.sqrt(gv[touched])
                self.w0 -= rate * error.sum() / math.sqrt(g0)


def _described(docs: DataFrame, cols: list[str]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1):
            found = [describe(t, n) for t, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"label": part.column(0), "b": pa.array([f[0] for f in found], pa.list_(pa.int64())),
                                              "s": pa.array([f[1] for f in found], pa.list_(pa.float64()))})

    return docs.select(*cols).mapInArrow(work, "label int, b array<long>, s array<double>")


def _metadata(docs: DataFrame, n_chars: str) -> DataFrame:
    return docs if n_chars in docs.columns else docs.withColumn(n_chars, F.lit(None).cast("long"))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", n_chars: str = "n_chars",
          per_class: int = 3000, factors: int = 8, epochs: int = 12, rate: float = 0.1, shrink: float = 1e-5, seed: int = 42) -> Machine:
    """A machine fitted on about ``per_class`` labelled documents of each class (a bounded sample; pass the labels to learn from).

    Labels other than 0 and 1, null labels and labels without a document are left out. Without any
    labelled document the machine scores 0.5 everywhere.
    """
    drawn, _ = hash_sample(labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("label")), "label", key, per_class)
    found = _metadata(docs, n_chars).select(key, text, n_chars).join(F.broadcast(drawn.dropDuplicates([key])), key)    # bounded by per_class
    rows = _described(found, ["label", text, n_chars]).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["label"], r["s"], r["b"]))
    described = [(np.array(r["b"], dtype=np.int64), np.array(r["s"])) for r in rows]
    stats = np.array([d[1] for d in described]).reshape(-1, len(STATS)) if rows else np.zeros((1, len(STATS)))
    machine = Machine(stats.mean(axis=0), stats.std(axis=0) + 1e-6, factors, seed)
    if rows:
        machine.fit(described, np.array([float(r["label"]) for r in rows]), epochs, rate, shrink, 64, seed)
    else:
        machine.v[:] = 0
    return machine


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``key, score``: chance of label 1 of every row's whole text. Null and empty texts are scored by their statistics."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)      # bounded: BUCKETS * (factors + 1) numbers
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1):
            p = shared.value.predict([describe(t, n) for t, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_pydict({"k": part.column(0), "score": pa.array(p)})

    return _metadata(docs, n_chars).select(key, text, F.col(n_chars).cast("long")).mapInArrow(work, f"k {kind}, score double").withColumnRenamed("k", key)


ship_by_value(__name__)
