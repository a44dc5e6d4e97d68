"""Rows that earlier plans lost: null groups, null keys, unmatched pairs; and jobs that only building a query must not start."""

import pytest
from pyspark.sql import functions as F

from ferrule.operators import ordering as OR
from ferrule.operators import preference as P

SF = "/root/testdata/sf0.001"


def test_split_keeps_null_groups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "k long, g string")
    out = OR.document_split(df, "g", "k", 0.5)
    assert out.count() == 4 and out.where("split = 'val'").groupBy("g").count().count() == 2
    ranked = OR.hashed_position(df, 1, ["k"], partition_by=("g",), total_col="n").collect()
    assert sorted((r["g"] or "", r["pos"], r["n"]) for r in ranked) == [("", 1, 2), ("", 2, 2), ("a", 1, 2), ("a", 2, 2)]
    nulls = spark.createDataFrame([(None, "a"), (5, "a"), (None, "a")], "k long, g string")
    assert sorted(r["pos"] for r in OR.hashed_position(nulls, 1, ["k"]).collect()) == [1, 2, 3]
    assert sorted(r["pos"] for r in OR.position(nulls, F.col("k")).collect()) == [1, 2, 3]


def test_split_sides_agree_with_ranks(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    out = {r["g"]: r["n"] for r in OR.document_split(df, "g", "k", 0.1).where("split = 'val'").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert out == {0: 33, 1: 33, 2: 33}
    assert OR.exact_split(df, "k", 123).where("split = 'test'").count() == 123
    assert OR.exact_split(df, ["g", "k"], 7).where("split = 'test'").count() == 7


def test_interleave_expands_in_spans(spark):
    df = spark.createDataFrame([(i, "big") for i in range(10_000)] + [(0, "one")], "k long, g string")
    out = OR.interleave(df, "g", "k").groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("round").alias("r"), F.max("round").alias("m")).collect()
    assert sorted((r["g"], r["n"], r["r"], r["m"]) for r in out) == [("big", 10_000, 10_000, 9_999), ("one", 10_000, 10_000, 9_999)]


def test_unmatched_pairs_are_an_error(spark):
    prompts = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "pair_id long, src string, reference string")
    cands = spark.createDataFrame([(1, "x", "b")], "pair_id long, candidate string, candidate_2 string")
    assert P.preference_pairs(prompts.where("pair_id = 1"), cands).count() == 1
    with pytest.raises(Exception, match="no partner for pair_id 2"):
        P.preference_pairs(prompts, cands).collect()
    with pytest.raises(Exception, match="no partner for pair_id 1"):
        P.preference_stats(prompts.where("pair_id = 2"), cands).collect()


def test_building_a_query_reads_schemas_only(spark):
    import __spark_entry__ as E
    sc = spark.sparkContext
    for name, build in E.queries().items():
        if not name.startswith("q_") or build.__module__ == "ferrule.plans.q_io":       # those write first: that is what they check
            continue
        sc.setJobGroup(f"build {name}", name)
        plan = build(spark, SF)
        jobs = sc.statusTracker().getJobIdsForGroup(f"build {name}")
        tasks = sum(s.numTasks for j in jobs for i in (sc.statusTracker().getJobInfo(j).stageIds if sc.statusTracker().getJobInfo(j) else []) if (s := sc.statusTracker().getStageInfo(i)))
        scans = plan._jdf.queryExecution().analyzed().toString().count("Relation [")
        assert tasks <= max(1, scans) * 2, (name, tasks, scans)
    sc.setLocalProperty("spark.jobGroup.id", None)
