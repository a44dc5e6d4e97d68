import pandas as pd
from pyspark.sql import functions as F

from ferrule.functions import udf as U

from small_data import SF_SMALL


def test_tokenizer_udf_runs_user_tokenizer(spark):
    def char_codes():   # nested: shipped to workers by value
        return lambda text: [ord(c) for c in text]

    tok = U.tokenizer_udf(char_codes)
    df = spark.createDataFrame([("ab",), ("",)], "t string")
    assert [r["ids"] for r in df.select(tok("t").alias("ids")).collect()] == [[97, 98], []]


def test_generate_candidates_is_keyed(spark):
    df = spark.createDataFrame([(0, "eh og"), (1, "a cb")], "pair_id long, source string")
    out = {r["pair_id"]: r["candidate"] for r in U.generate_candidates(df, U.corrupt_words, "pair_id", "source").collect()}
    assert out == {0: "he og", 1: "a cb"}


def test_map_batches(spark):
    df = spark.range(4)
    out = U.map_batches(df, lambda b: pd.DataFrame({"id": b["id"], "y": b["id"] * 2}), "id long, y long")
    assert sorted(r["y"] for r in out.collect()) == [0, 2, 4, 6]


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    row = df.first()
    assert row["n_pairs"] > 0 and 0.0 <= row["gleu"] <= 1.0
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert {n for n in set(qs) - set(sql) if n.startswith("q_")} == set()
    assert len(qs) >= 70


def test_every_query_builds_a_plan(spark):
    import __spark_entry__ as E
    for name, fn in E.queries().items():
        df = fn(spark, SF_SMALL)
        assert df.columns, name


def test_flagship_values_at_smallest_scale(spark):
    import __spark_entry__ as E
    r = E.queries()["q_gleu_corpus"](spark, SF_SMALL).first()
    assert r["cand_len"] == r["ref_len"] and r["den_1"] == r["cand_len"]
    assert F is not None


def test_batches_of_long_texts_are_mapped_a_few_megabytes_at_a_time(spark):
    from ferrule.functions.udf_support import FEW_BYTES

    df = spark.range(24).select("id", F.when(F.col("id") > 0, F.repeat(F.lit("x "), 500_000)).alias("t")).coalesce(1)
    out = U.map_batches(df, lambda b: pd.DataFrame({"size": [int(b["t"].str.len().sum())], "rows": [len(b)], "nulls": [int(b["t"].isna().sum())]}),
                        "size long, rows long, nulls long").collect()
    assert sum(r["rows"] for r in out) == 24 and sum(r["size"] for r in out) == 23_000_000 and sum(r["nulls"] for r in out) == 1
    assert max(r["size"] for r in out) <= FEW_BYTES
    assert U.map_batches(df.limit(0), lambda b: b[["id"]], "id long").count() == 0


def test_edit_distances_hold_few_texts_at_a_time(monkeypatch):
    import pyarrow as pa

    from ferrule.functions import edit

    held, costs = [], edit.edit_costs
    monkeypatch.setattr(edit, "AT_ONCE", 10_000)
    monkeypatch.setattr(edit, "edit_costs", lambda pairs: held.append(sum(len(t) for p in pairs for t in p)) or costs(pairs))
    texts = ["ab" * 500, None, "", *["abc" * 700] * 40, "b" * 30_000]
    got = edit._edit_distances_batch(pa.array(texts), pa.array(["ab" * 500] * len(texts)), pa.array(texts[::-1]))
    want = [[None if a is None or b is None else edit.levenshtein_bits(a, b) for b in ("ab" * 500, other)] for a, other in zip(texts, texts[::-1])]
    assert got.to_pylist() == want and len(held) > 5
