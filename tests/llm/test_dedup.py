"""Near-duplicates and components against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import types as T

from ferrule.llm import embedding_dedup, simhash
from ferrule.llm.catalog import QUERIES, load_all
from ferrule.llm.components import components

load_all()


def brute_components(nodes, linked):
    """Smallest node reachable, by repeated relaxation."""
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return least


# -- components --------------------------------------------------------------

@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(30)], [(0, i) for i in range(1, 40)], [(5, 5)], [(3, 9), (9, 3), (3, 9)],
    [(7, 2), (2, 8), (11, 10), (12, 11), (1, 8)], [(-5, 3), (3, 2**62)]])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components({n for a, b in edges if a != b for n in (a, b)}, edges if all(a != b for a, b in edges) else [])
    assert got == want


def test_components_of_random_graphs_and_nothing(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in brute_components(range(300), edges).items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- SimHash -----------------------------------------------------------------

def brute_fingerprint(text, n=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(edge_texts):
    for t in [x for x in edge_texts if not isinstance(x, tuple)]:
        assert simhash.fingerprint(t, 3) == brute_fingerprint(t)
    assert simhash.fingerprint("AÉ b C", 3) == simhash.fingerprint("aÉ B c", 3) != simhash.fingerprint("aé b c", 3)


def test_fingerprint_is_the_same_in_chunks(monkeypatch, edge_texts):
    whole = [simhash.fingerprint(t, 3) for t in edge_texts if not isinstance(t, tuple)]
    monkeypatch.setattr(simhash.word_chunks, "__defaults__", (7,))
    assert [simhash.fingerprint(t if t is None else t[:2000], 3) for t in edge_texts if not isinstance(t, tuple) and (t is None or len(t) <= 2000)] == [
        f for f, t in zip(whole, [t for t in edge_texts if not isinstance(t, tuple)], strict=True) if t is None or len(t) <= 2000]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("most", [2048, 6])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, most):
    """Random walks around a few centres; a small MOST sends the groups through every split."""
    monkeypatch.setattr(simhash, "MOST", most)
    rng = random.Random(1)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(100)}
    near = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3]
    found = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long")).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    assert brute_components(prints, found) == brute_components(prints, near)


def expected_groups(rows):
    """{(doc_id, text)} -> component for rows with an id."""
    prints = [(d, t, brute_fingerprint(t)) for d, t in rows]
    kinds = {f for *_, f in prints}
    least = brute_components(kinds, [(a, b) for a in kinds for b in kinds if a < b and (a ^ b).bit_count() <= 3])
    first = {}
    for d, _, f in prints:
        if d is not None:
            first[least[f]] = min(first.get(least[f], d), d)
    return [(d, t, f, first.get(least[f])) for d, t, f in prints]


def test_simhash_operator_edges(make_docs, edge_texts):
    docs = make_docs([t for t in edge_texts if t is None or len(t) < 10**5])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = simhash.near_duplicates(docs).collect()
    want = expected_groups(rows)
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64, str(r["component_id"])) for r in got) == sorted((str(d), f, str(c)) for d, _, f, c in want)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    out = [(r["doc_id"], r["text"]) for r in kept.collect()]
    groups = {c for d, _, _, c in want if d is not None}
    assert sorted(d for d, _ in out if d is not None) == sorted(groups) and sum(d is None for d, _ in out) == sum(d is None for d, _ in rows)
    assert kept.first()["fp"] == "own fp"
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_first(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs, max_bits=4)


def test_simhash_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = expected_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = QUERIES["op5_simhash_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((d, f"{f:016x}", c) for d, _, f, c in want)


# -- embeddings --------------------------------------------------------------

def brute_vectors(rows, least):
    """{row number: (n_links, component)} by all pairs."""
    use = [(i, k, v) for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(v) / np.linalg.norm(np.array(v) / np.abs(v).max()) / np.abs(v).max() for i, _, v in use}
    near = [(i, j) for i in unit for j in unit if i != j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least]
    least_row = brute_components(range(len(rows)), near)
    first = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            first[least_row[i]] = min(first.get(least_row[i], k), k)
    return {i: (sum(a == i for a, _ in near), first.get(least_row[i])) for i in range(len(rows))}


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("id", T.StringType()),
                        T.StructField("v", T.StringType())])


def test_embedding_edges_and_clusters(spark):
    rng = np.random.default_rng(0)
    rows = [(1, None), (2, []), (3, [0.0] * 8), (4, [float("nan")] + [1.0] * 7), (5, [float("inf")] + [1.0] * 7), (6, [None] + [1.0] * 7),
            (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1e-30] * 8), (None, [1.0] * 8), (10, [1.0] * 8), (10, [1.0] * 8), (11, [-1.0] * 8)]
    for centre in rng.normal(size=(4, 8)):
        for _ in range(60):
            rows.append((len(rows) + 100, [float(np.float32(x)) for x in centre + rng.normal(scale=0.12, size=8)]))
    for _ in range(150):
        rows.append((len(rows) + 100, [float(np.float32(x)) for x in rng.normal(size=8)]))
    rows += rows[40:60]
    df = spark.createDataFrame([(k, v, "i", "v") for k, v in rows], VECTORS)
    want = brute_vectors([(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows], 0.9)
    got = embedding_dedup.near_duplicates(df, passes=24, window=64, block=32).collect()
    found = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got)
    expect = sorted((str(k), n, str(c)) for (k, _), (n, c) in zip(rows, want.values(), strict=True))
    assert found == expect
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_on_a_table(spark):
    """Small windows over many range partitions, so that most links cross chunk and seam borders."""
    rng = np.random.default_rng(5)
    rows = []
    for centre in rng.normal(size=(60, 16)):
        for _ in range(12):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.normal(scale=0.08, size=16)]))
    df = spark.createDataFrame([(k, v, "", "") for k, v in rows], VECTORS)
    want = brute_vectors(rows, 0.9)
    old, embedding_dedup.ROWS_A_PARTITION = embedding_dedup.ROWS_A_PARTITION, 500
    try:
        got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, passes=16, window=8).collect()}
    finally:
        embedding_dedup.ROWS_A_PARTITION = old
    links = sum(n for n, _ in want.values())
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * links
    assert all(r["n_links"] <= want[k][0] for k, r in got.items())


def test_embedding_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want = brute_vectors(rows, 0.9)
    got = QUERIES["op3_sorted_projection_dedup"](spark, "/root/testdata/sf0.01").collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted((k, n, c) for (k, _), (n, c) in zip(rows, want.values(), strict=True))


def test_passes_follow_the_size_of_the_table(spark, monkeypatch):
    for count in (0, 1, 128, 2_000, 400_000, 5_700_000, 10**8, 10**11):
        for window in (8, 128):
            passes = embedding_dedup.passes_for(count, 0.9, window, 0.99)
            chance = (1 - np.arccos(0.9) / np.pi) ** np.log2(max(1.0, count / window))
            assert passes >= 24 and 1 - (1 - chance) ** passes >= 0.99 - 1e-9
    with pytest.raises(ValueError):
        embedding_dedup.passes_for(10, 0.9, 128, 1.0)

    used = []
    keys = embedding_dedup._keys
    monkeypatch.setattr(embedding_dedup, "_keys", lambda reps, passes, seed: used.append(passes) or keys(reps, passes, seed))
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 16))
    near = x + 0.1 * rng.standard_normal(x.shape)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, near]))]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), window=1).collect()
    y = embedding_dedup.unit(pa.array([v for _, v in rows]))
    links = (y @ y.T >= 0.9).sum(axis=1) - 1
    assert used == [embedding_dedup.passes_for(3000, 0.9, 1, 0.99)] and used[0] > 24
    assert sum(r["n_links"] for r in got) >= 0.99 * links.sum() > 0


def test_simhash_keeps_a_row_of_every_group_when_keys_repeat(make_docs):
    one, two = "first text about cats and dogs that sit here", "another thing entirely on boats and long rivers today"
    kept = simhash.keep_first(make_docs([(1, one), (1, two), (2, one), (3, two), (3, one)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, one), (1, two)])
    kept = simhash.keep_first(make_docs([(1, one), (2, two), (2, one), (2, two)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, one), (2, two)])
