"""Toxicity severity by cumulative-link ordinal regression.

Grades run from 0 (clean) to ``GRADES``. One weight vector over sparse text features is shared
by all thresholds: ``P(grade >= k) = logistic(w . x - t_k)`` with ``t_1 < t_2 < ...``. The output is
the expected severity, ``sum_k P(grade >= k)``, and the chance of any toxicity.

Features are the words of a text and their beginnings of 4 to 6 bytes, hashed; the model keeps
those that tell toxic documents from clean ones. Labels say toxic or not; a toxic document of the
sample gets its grade from how many of its words carry telling features, cut at the terciles.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions.udf_support import ship_by_value
from ferrule.llm.common import hash_sample, text_slices
from ferrule.llm.simhash import word_chunks

BEGINNINGS = (4, 5, 6)
GRADES = 3
#: Letters and bytes over 127 make words; everything else parts them.
_PLAIN = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))


def features(text: str | None) -> np.ndarray:
    """Hashed features of a whole text, sorted, each once; null counts as empty."""
    found: set[bytes] = set()
    for words in word_chunks((text or "").lower().encode().translate(_PLAIN)):
        found.update(words)
    for n in BEGINNINGS:
        found.update([w[:n] + b"-" for w in found if len(w) > n and w[-1:] != b"-"])
    return np.unique(np.fromiter(map(crc32, found), dtype=np.int64))


class Severity:
    """``kept``: hashes of the kept features in order; ``w``: their weights; ``cuts``: the thresholds."""

    def __init__(self, kept: np.ndarray):
        self.kept = kept
        self.w = np.zeros(len(kept))
        self.cuts = np.full(GRADES, 35.0)

    def place(self, found: np.ndarray) -> np.ndarray:
        """Numbers of the kept features among sorted hashes."""
        at = np.searchsorted(self.kept, found)
        return at[np.append(self.kept, -1)[at] == found]

    def chances(self, found: list[np.ndarray]) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES of each document."""
        z = np.array([self.w[self.place(f)].sum() for f in found])
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.cuts, -35, 35)))

    def fit(self, found: list[np.ndarray], grades: np.ndarray, steps: int, rate: float, shrink: float) -> None:
        """Maximises the ordinal likelihood by Adam steps over all rows; cuts stay in order as sums of exponentials."""
        placed = [self.place(f) for f in found]
        each, cols = np.repeat(np.arange(len(placed)), [len(p) for p in placed]), np.concatenate(placed)
        n = len(self.w)
        theta = np.concatenate([self.w, [1.0], np.zeros(GRADES - 1)])       # weights, first cut, logs of the gaps
        mean, spread = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            first, gaps = theta[n], theta[n + 1:]
            cuts = np.concatenate([[first], first + np.cumsum(np.exp(gaps))])
            z = np.bincount(each, theta[cols], minlength=len(found))
            p = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts, -35, 35)))
            full = np.concatenate([np.ones((len(z), 1)), p, np.zeros((len(z), 1))], axis=1)
            g = grades
            rows = np.arange(len(z))
            chance = np.maximum(full[rows, g] - full[rows, g + 1], 1e-9)
            slope = full * (1 - full)
            up, down = slope[rows, g] / chance, slope[rows, g + 1] / chance
            dz = (up - down) / len(z)
            dcut = np.zeros(GRADES)
            np.add.at(dcut, np.maximum(g - 1, 0), np.where(g > 0, -up, 0) / len(z))
            np.add.at(dcut, np.minimum(g, GRADES - 1), np.where(g < GRADES, down, 0) / len(z))
            grad = np.concatenate([np.bincount(cols, dz[each], minlength=n) - shrink * theta[:n], [dcut.sum()],
                                   [dcut[k + 1:].sum() * np.exp(gaps[k]) for k in range(GRADES - 1)]])
            mean, spread = 0.9 * mean + 0.1 * grad, 0.99 * spread + 0.01 * grad * grad
            theta = theta + rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(spread / (1 - 0.99 ** step)) + 1e-8)
        self.w, first = theta[:n], theta[n]
        self.cuts = np.concatenate([[first], first + np.cumsum(np.exp(theta[n + 1:]))])


def _featured(docs: DataFrame, cols: list[str]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1):
            yield pa.RecordBatch.from_pydict({"label": part.column(0), "f": pa.array([features(t) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))})

    return docs.select(*cols).mapInArrow(work, "label int, f array<long>")


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 3000,
          most_features: int = 4096, least_docs: int = 3, least_odds: float = 30.0, steps: int = 400, rate: float = 0.05, shrink: float = 1e-4) -> Severity:
    """A model fitted on about ``per_class`` labelled documents of each class (a bounded sample; pass the labels to learn from).

    A feature is kept if ``least_docs`` toxic documents hold it and its smoothed odds for toxic documents
    are ``least_odds`` or more; the ``most_features`` with the largest likelihood ratio stay. Labels other than
    0 and 1, null labels and labels without a document are left out; without toxic examples nothing is toxic.
    """
    drawn, _ = hash_sample(labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("label")), "label", key, per_class)
    found = docs.select(key, text).join(F.broadcast(drawn.dropDuplicates([key])), key)      # bounded by per_class
    table = _featured(found, ["label", text]).toArrow()
    order = sorted(range(table.num_rows), key=lambda i: (table["label"][i].as_py(), table["f"][i].as_py()))
    rows = [table["f"][i].values.to_numpy() for i in order]
    toxic = np.array([table["label"][i].as_py() for i in order], dtype=np.int64)
    if not toxic.any():
        return Severity(np.zeros(0, dtype=np.int64))
    known, number = np.unique(np.concatenate(rows), return_inverse=True)
    side = np.repeat(toxic, [len(r) for r in rows])
    hit, miss = np.bincount(number[side == 1], minlength=len(known)), np.bincount(number[side == 0], minlength=len(known))
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    odds = (hit / n1) / ((miss + 0.5) / (n0 + 1))
    good = np.flatnonzero((hit >= least_docs) & (odds >= least_odds))
    model = Severity(np.sort(known[good[np.argsort(-hit[good] * np.log(odds[good]), kind="stable")][:most_features]]))
    telling = np.array([len(model.place(r)) for r in rows])
    cuts = np.quantile(telling[toxic == 1], [1 / 3, 2 / 3])
    model.fit(rows, np.where(toxic == 1, 1 + np.searchsorted(cuts, telling, side="left"), 0), steps, rate, shrink)
    return model


def grade(docs: DataFrame, model: Severity, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, severity, toxic_score, grade, toxic`` of every row's whole text.

    ``severity`` is the expected grade (0 to GRADES), ``toxic_score`` the chance of grade 1 or more, ``grade`` the
    severity rounded, ``toxic`` whether that chance is 0.5 or more. Null and empty texts have no feature.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)        # bounded by most_features
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1):
            p = shared.value.chances([features(t) for t in part.column(1).to_pylist()])
            severity = p.sum(axis=1)
            yield pa.RecordBatch.from_pydict({"k": part.column(0), "severity": pa.array(severity), "toxic_score": pa.array(p[:, 0]),
                                              "grade": pa.array(np.rint(severity).astype(np.int32)), "toxic": pa.array(p[:, 0] >= 0.5)})

    return docs.select(key, text).mapInArrow(work, f"k {kind}, severity double, toxic_score double, grade int, toxic boolean").withColumnRenamed("k", key)


def reject_toxic(docs: DataFrame, model: Severity, text: str = "text", most: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose chance of any toxicity is below ``most``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, at):
            yield part.filter(pa.array(shared.value.chances([features(t) for t in part.column(at).to_pylist()])[:, 0] < most))

    return docs.mapInArrow(work, docs.schema)


ship_by_value(__name__)
