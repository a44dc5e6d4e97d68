from pyspark.sql import Window
from pyspark.sql import functions as F

from ferrule.operators import chunk as C
from ferrule.operators import ordering as OR


def _docs(spark, lengths):
    rows = [(i, 0, [f"t{i}_{k}" for k in range(n)]) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "doc_id long, domain_id int, tokens array<string>")


def test_chunk_pad_edges(spark):
    B = 4
    df = _docs(spark, [B - 1, B, B + 1, 0, 2 * B + 3])
    out = {(r["doc_id"], r["block_index"]): r for r in
           C.chunk_pad(df, "tokens", "domain_id", B, "<pad>", keep=("doc_id",)).collect()}
    assert sorted(out) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (4, 1)]
    short = out[(0, 0)]
    assert short["input_ids"][-1] == "<pad>" and short["attention_mask"] == [1, 1, 1, 0]
    assert short["domain_ids"] == [0, 0, 0, -100]
    assert out[(1, 0)]["attention_mask"] == [1] * B          # L == block: one block, no pad
    assert out[(2, 0)]["input_ids"] == ["t2_0", "t2_1", "t2_2", "t2_3"]   # tail dropped
    assert out[(3, 0)]["attention_mask"] == [0] * B


def test_chunk_pad_notebook_variant_keeps_domain(spark):
    df = _docs(spark, [2])
    r = C.chunk_pad(df, "tokens", "domain_id", 4, "<pad>", mask_domain_on_pad=False).first()
    assert r["domain_ids"] == [0, 0, 0, 0]


def test_chunk_drop_tail_short_document_yields_nothing(spark):
    df = _docs(spark, [3, 8, 9])
    rows = C.chunk_drop_tail(df, "tokens", 4, keep=("doc_id",)).collect()
    assert sorted((r["doc_id"], r["block_index"]) for r in rows) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert all(r["attention_mask"] == [1] * 4 for r in rows)


def test_real_tokens_preserved(spark):
    lengths = [1, 5, 16, 17, 40, 3]
    B = 8
    df = _docs(spark, lengths)
    total = C.chunk_pad(df, "tokens", "domain_id", B, "<pad>").agg(F.sum("n_real")).first()[0]
    assert total == sum(n if n < B else n - n % B for n in lengths)


def test_pack_concat(spark):
    df = _docs(spark, [3, 5, 2, 7])
    blocks = C.pack(df, "doc_id", "tokens", 4, drop_tail=False).orderBy("block_id").collect()
    flat = [t for b in blocks for t in b["input_ids"]]
    expected = [t for r in df.orderBy("doc_id").collect() for t in r["tokens"]]
    assert flat == expected
    assert [len(b["input_ids"]) for b in blocks] == [4, 4, 4, 4, 1]
    assert blocks[0]["doc_ids"] == [0, 0, 0, 1]
    kept = C.pack(df, "doc_id", "tokens", 4, drop_tail=True).count()
    assert kept == 4


def test_position_equals_global_row_number(spark):
    df = spark.range(0, 3000).withColumnRenamed("id", "k").withColumn("g", F.col("k") % 3)
    pos = OR.hashed_position(df, 5, ["k"]).select("k", "pos")
    ref = df.select("k", F.row_number().over(Window.orderBy(OR.seeded_hash(5, "k"))).alias("ref"))
    assert pos.join(ref, "k").where(F.col("pos") != F.col("ref")).count() == 0
    grouped = OR.hashed_position(df, 5, ["g", "k"], partition_by=("g",)).select("k", "pos")
    wref = Window.partitionBy("g").orderBy(OR.seeded_hash(5, "g", "k"))
    ref2 = df.select("k", F.row_number().over(wref).alias("ref"))
    assert grouped.join(ref2, "k").where(F.col("pos") != F.col("ref")).count() == 0


def test_running_offset_by_key(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(10000)], "k long, w int")
    out = OR.position(df, F.col("k"), weight=F.col("w"), offset_col="off")
    rows = out.orderBy("k").select("w", "off").collect()
    run = 0
    for r in rows:
        assert r["off"] == run
        run += r["w"]


def test_document_split_is_exact_and_disjoint(spark):
    df = spark.createDataFrame([(i, ["a", "b", "c"][i % 3] if i < 600 else "a") for i in range(900)],
                               "doc_id long, domain string")
    s = OR.document_split(df, "domain", "doc_id", 0.1, seed=100)
    counts = {(r["domain"], r["split"]): r["count"] for r in s.groupBy("domain", "split").count().collect()}
    assert counts[("a", "val")] == round(500 * 0.1) and counts[("b", "val")] == 20 and counts[("c", "val")] == 20
    assert s.count() == 900 and s.select("doc_id").distinct().count() == 900
    again = OR.document_split(df, "domain", "doc_id", 0.1, seed=100)
    assert s.exceptAll(again).count() == 0
    tiny = spark.createDataFrame([(1, "x"), (2, "x")], "doc_id long, domain string")
    assert OR.document_split(tiny, "domain", "doc_id", 0.1).where("split = 'val'").count() == 1


def test_batches_drop_last_and_schedule(spark):
    df = spark.range(0, 10).withColumnRenamed("id", "k")
    ranked = OR.hashed_position(df, 1, ["k"], total_col="total")
    b = OR.batches(ranked, "pos", "total", 4, drop_last=True)
    assert b.count() == 8
    ids = b.groupBy("batch_id").agg(F.lit(2).alias("n"))
    sched = OR.step_schedule(ids, "n", 7).orderBy("step").collect()
    assert [r["batch_id"] for r in sched] == [0, 1, 0, 1, 0, 1, 0]
    keep = OR.batches(ranked, "pos", "total", 4, drop_last=False)
    assert keep.count() == 10


def test_interleave_until_all_exhausted(spark):
    df = spark.createDataFrame([(i, "a") for i in range(5)] + [(10 + i, "b") for i in range(2)],
                               "k long, g string")
    out = OR.interleave(df, "g", "k").collect()
    per = {}
    for r in out:
        per.setdefault(r["g"], []).append(r["round"])
    assert sorted(per["a"]) == [0, 1, 2, 3, 4] and sorted(per["b"]) == [0, 1, 2, 3, 4]


def test_sample_per_group_caps_each_group(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(100)], "k long, g int")
    s = OR.sample_per_group(df, "g", "k", 7)
    assert {r["g"]: r["count"] for r in s.groupBy("g").count().collect()} == {0: 7, 1: 7}


def test_sample_per_group_of_any_size_against_a_sort(spark):
    import hashlib

    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 5}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, domain string").repartition(5)
    for n in (0, 1, 7, 5000):
        want = set()
        for g in {g for _, g in rows}:
            ids = sorted((i for i, x in rows if x == g), key=lambda i: (hashlib.md5(f"100:{i}".encode()).hexdigest(), i))
            want |= {(i, g) for i in ids[:n]}
        got = OR.sample_per_group(df, "domain", "doc_id", n)
        assert got.columns == df.columns and {tuple(r) for r in got.collect()} == want
    plan = OR.sample_per_group(df, "domain", "doc_id", 5000)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_position_of_keys_of_any_type_against_a_sort(spark):
    """Text, sparse, negative and null keys, a hot group, more and fewer cuts than rows: ranks and running sums of a plain sort."""
    import random

    rng = random.Random(5)
    keys = [rng.randint(-2**62, 2**62) for _ in range(3000)] + [None]
    rows = [(k, None if k is None else f"k{k % 977}-{k}", None if i % 13 == 0 else "hot" if i % 3 else f"g{i % 4}", i % 9) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "n long, s string, g string, w int").repartition(7)
    for col, part, cuts in (("n", (), 4096), ("s", (), 300), ("n", ("g",), 64), ("s", ("g",), 1)):
        at = "ns".index(col)
        got = OR.position(df, F.col(col), partition_by=part, weight=F.col("w"), offset_col="off", total_col="t", cuts=cuts)
        seen = {}
        for r in sorted(rows, key=lambda r: (r[at] is not None, r[at] if at == 0 else (r[at] or "").encode()) if r[at] is not None else (False, 0)):
            group = seen.setdefault(r[2] if part else 0, [])
            group.append((r[0], len(group) + 1, sum(x[3] for x in group), r[3]))
        want = {(k, pos, off, len(g)) for g in seen.values() for k, pos, off, _ in g}
        assert {(r["n"], r["pos"], r["off"], r["t"]) for r in got.collect()} == want
    assert OR.position(df.limit(0), F.col("n")).count() == 0


def test_ranges_of_sparse_keys_stay_few_and_even(spark):
    """100,000 keys that are a million apart: the bucket table has as many rows as cuts, and no range is large."""
    df = spark.range(100_000).select((F.col("id") * 1_000_003 - 5_000_000_000).alias("k"))
    sizes = [r["count"] for r in OR.range_bucket(df, [F.col("k")], "b", 256).groupBy("b").count().collect()]
    assert len(sizes) <= 257 and max(sizes) < 100_000 / 256 * 12


def test_splits_do_not_depend_on_the_number_of_hash_buckets(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(300)], "k long, g string")
    for run in (lambda n: OR.document_split(df, "g", "k", 0.2, bucket_chars=n), lambda n: OR.exact_split(df, "k", 41, bucket_chars=n),
                lambda n: OR.interleave(df, "g", "k", bucket_chars=n)):
        few, many = (sorted(map(tuple, run(n).collect())) for n in (1, 5))
        assert few == many and few


def test_split_documents_are_not_shuffled_by_group(spark):
    """A few groups hold all texts, so a shuffle by group would send a third of them to one task."""
    docs = spark.createDataFrame([(i, ["a", "b", None][i % 3], ["w"] * 5) for i in range(60)], "doc_id long, domain string, tokens array<string>")
    split = OR.document_split(docs, "domain", "doc_id", 0.1, 100)
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
    assert split.where("split = 'val'").groupBy("domain").count().select("count").collect() == [(2,)] * 3
