"""Class language model: counts, base and class scores against direct computation; moves against the full objective."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from ferrule.llm import brown_lm
from ferrule.llm.catalog import QUERIES, load_all
from ferrule.llm.common import crc_fold

load_all()
SF = "/root/testdata/sf0.001"


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def ranks(model):
    if not hasattr(model, "rank"):
        model.rank = {w: i for i, w in enumerate(model.known)}
    return model.rank


def class_of(model, word):
    rank = ranks(model)
    return int(model.classes[model.units[rank[word]] if word in rank else brown_lm.shape(word, model.unit_words, model.shapes)])


def check_scores(docs, train, model, got):
    counts = Counter(t for r in train.collect() for t in tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    k = len(model.class_tokens)
    kind = {w: class_of(model, w) for w in counts}
    size, words, pairs = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, k), np.int64)
    for w, c in counts.items():
        size[kind[w]] += c
        words[kind[w]] += 1
    for r in train.collect():
        line = [b"", *tokens(r["text"])]
        for a, b in zip(line, line[1:], strict=False):
            pairs[kind[a], kind[b]] += 1
    assert (model.tokens, model.words) == (n, v)
    assert (pairs == model.pairs).all() and (size == model.class_tokens).all() and (words == model.class_words).all()
    base, fit = {}, {}
    for r in docs.collect():
        line, before = tokens(r["text"]), 0
        base[str(r["doc_id"]), r["text"]] = (len(line), sum(t in counts for t in line), sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in line))
        total = 0.0
        for t in line:
            c = class_of(model, t)
            move = (pairs[before, c] + (size[c] + 1) / (n + k)) / (pairs[before].sum() + 1)
            total += math.log10(move * (counts[t] + 0.1) / (size[c] + 0.1 * (words[c] + 1)))
            before = c
        fit[str(r["doc_id"]), r["text"]] = total
    rows = got.join(docs.select("doc_id", "text"), "doc_id").collect() if "text" not in got.columns else got.collect()
    assert len(rows) >= len(base) - 2
    for r in rows:
        want = base[str(r["doc_id"]), r["text"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (*want[:2], n)
        assert r["base_score"] == pytest.approx(want[2], rel=1e-9) and r["score"] == pytest.approx(fit[str(r["doc_id"]), r["text"]], rel=1e-9)
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"]), rel=1e-9)


@pytest.mark.parametrize("sizes", [{"n_classes": 8, "unit_words": 60, "shapes": 20, "known_words": 300}, {"n_classes": 16, "unit_words": 5, "shapes": 3, "known_words": 9}, {}])
def test_scores_against_direct_computation(spark, sizes):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train = docs.where(crc_fold("doc_id", 10) != 0)
    model = brown_lm.learn(train, **sizes)
    check_scores(docs, train, model, brown_lm.score(docs, model))
    assert np.allclose((10 ** model.transitions()).sum(axis=1), 1)


def test_query_and_held_out_gain(spark):
    rows = QUERIES["op11_brown_lm"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_moves_against_the_full_objective():
    rng = np.random.default_rng(3)
    units, k = 12, 5
    counts = rng.integers(0, 9, (units, units)) * (rng.random((units, units)) < 0.6)
    classes = np.concatenate([[0], 1 + np.arange(units - 1) % (k - 1)])

    def pairs(at):
        out = np.zeros((k, k), np.int64)
        np.add.at(out, (at[:, None], at[None, :]), counts)
        return out

    for unit in range(1, units):
        side = np.concatenate([np.flatnonzero(counts[unit]) * 2, np.flatnonzero(counts[:, unit]) * 2 + 1])
        n = np.concatenate([counts[unit][counts[unit] > 0], counts[:, unit][counts[:, unit] > 0]])
        right, left = brown_lm.class_vectors(side, n, classes, k)
        best, gain = brown_lm.best_class(int(classes[unit]), right, left, float(counts[unit, unit]), pairs(classes))
        values = []
        for c in range(1, k):
            at = classes.copy()
            at[unit] = c
            values.append(brown_lm.objective(pairs(at)))
        assert values[best - 1] == pytest.approx(max(values)) and gain == pytest.approx(max(values) - brown_lm.objective(pairs(classes)), abs=1e-6)


def test_exchange_raises_the_likelihood_and_finds_the_two_kinds(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(x for _ in range(40) for x in (f"a{rng.integers(30)}", f"b{rng.integers(30)}")) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = brown_lm.learn(docs, n_classes=3, unit_words=100, shapes=4, sweeps=6)
    a, b = ({class_of(model, f"{x}{i}".encode()) for i in range(30)} for x in "ab")
    assert len(a) == len(b) == 1 and a != b and 0 not in a | b
    again = brown_lm.learn(docs.repartition(7), n_classes=3, unit_words=100, shapes=4, sweeps=6)
    assert (again.classes == model.classes).all() and (again.pairs == model.pairs).all()


def test_edges(make_docs, edge_texts, spark):
    docs = make_docs([*edge_texts, "hot " * 400 + "y" * 300, "y" * 300 + " Z" + "y" * 300])
    model = brown_lm.learn(docs, n_classes=4, unit_words=20, shapes=5, known_words=50, sweeps=1)
    out = brown_lm.score(docs, model)
    assert out.count() == docs.count() and out.where("n_known <> n_tokens").count() == 0
    keyed = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = brown_lm.score(keyed, model)
    counts = Counter(t for r in docs.collect() for t in tokens(r["text"]))
    size = sum(counts.values()) + 0.1 * (len(counts) + 1)
    want = {r["doc_id"]: sum(math.log10((counts[t] + 0.1) / size) for t in tokens(r["text"])) for r in keyed.collect()}
    assert {r["doc_id"]: round(r["base_score"], 5) for r in got.collect()} == {d: round(x, 5) for d, x in want.items()}
    assert brown_lm.score(docs.limit(0), model).count() == 0
    none = brown_lm.learn(docs.limit(0), n_classes=4)
    assert (none.tokens, none.words) == (0, 0)
    row = brown_lm.score(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string"), none).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["base_score"]) for r in row] == [(1, 0, 0.0), (3, 0, 0.0)] and all(math.isfinite(r["score"]) for r in row)
