import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ferrule.operators import chunk as C
from ferrule.operators import metrics as MT
from ferrule.operators import router as R
from ferrule.sinks import csv as SK
from ferrule.sources import manifest as MF
from ferrule.sources import metrics_csv as MC
from ferrule.streaming import streams as ST

from small_data import SF_SMALL


def test_metric_log_round_trip(spark, scratch):
    path = os.path.join(scratch, "metrics")
    rows = spark.createDataFrame([("train", 1, 2.5)], "phase string, step int, loss double")
    SK.append_metric_rows(rows, path, ["phase", "step", "loss"])
    back = MC.read_metric_csv(spark, path).drop("file", "row_idx").collect()
    assert [r.asDict() for r in back] == [{"phase": "train", "step": "1", "loss": "2.5"}]
    SK.append_metric_rows(spark.createDataFrame([("train", 2)], "phase string, step int"), path,
                          ["phase", "step", "loss"])
    again = MC.read_metric_csv(spark, path).orderBy("step").collect()
    assert again[1]["loss"] in ("", None) and len(again) == 2


def test_read_metric_logs_with_different_headers(spark, scratch):
    a, b = os.path.join(scratch, "a_metrics.csv"), os.path.join(scratch, "b_metrics.csv")
    pd.DataFrame({"phase": ["train"], "step": ["1"], "loss": ["2"]}).to_csv(a, index=False)
    pd.DataFrame({"phase": ["val"], "step": ["1"], "val_loss": ["3"]}).to_csv(b, index=False)
    df = MC.read_metric_logs(spark, os.path.join(scratch, "*metrics*.csv"))
    assert set(df.columns) == {"phase", "step", "loss", "val_loss", "file", "row_idx"}
    nums = {r["column"] for r in MT.numeric_columns(df).collect()}
    assert nums == {"loss", "val_loss"}


def test_series_and_ranges(spark):
    df = spark.createDataFrame([(0, "train", "1", "", "2.5"), (1, "train", "2", "", "2.0"), (2, "", "x", "", "3")],
                               "row_idx long, phase string, step string, domain string, loss string")
    pts = MT.series_points(df, ["loss"])
    got = sorted((r["series"], r["x"], r["y"]) for r in pts.collect())
    assert got == [("run", 2.0, 3.0), ("train", 1.0, 2.5), ("train", 2.0, 2.0)]
    one = spark.createDataFrame([(0, "train", "5", "", "1.0")], "row_idx long, phase string, step string, "
                                                                  "domain string, loss string")
    r = MT.axis_range(MT.series_points(one, ["loss"])).first()
    assert (r["min_x"], r["max_x"]) == (4.0, 6.0) and abs(r["min_y"] - (0.0 - 0.16)) < 1e-9


def test_matrix_and_loss_csv_text(spark, scratch):
    wide = spark.createDataFrame([("Code", 75.0, 25.0), ("Math", 10.0, 90.0)], "d string, e0 double, e1 double")
    p = os.path.join(scratch, "routing")
    SK.write_matrix(wide, p, "d", ["e0", "e1"], ["Expert 0", "Expert 1"])
    rows = {r["label"]: r for r in MC.read_metric_csv(spark, p).collect()}
    assert rows["Code"]["Expert 0"] == "75" and rows["Math"]["Expert 1"] == "90"
    before = spark.createDataFrame([("code", 2.0)], "domain string, loss double")
    after = spark.createDataFrame([("code", 1.5)], "domain string, loss double")
    p2 = os.path.join(scratch, "losses")
    SK.write_domain_losses(R.before_after(before, after, "domain", "loss"), p2)
    r = MC.read_metric_csv(spark, p2).drop("file", "row_idx").first().asDict()
    assert r == {"domain": "code", "before": "2", "after": "1.5", "change": "-0.5"}


def test_prediction_csv_uses_python_booleans(spark, scratch):
    from ferrule.operators import scoring as S
    df = spark.createDataFrame([(1, "Fix grammatical errors in this sentence: He go home.", "He goes home.",
                                 "He goes home.")], "pair_id long, src string, reference string, candidate string")
    p = os.path.join(scratch, "pred")
    SK.write_predictions(S.prediction_stats(df, "pair_id", "src", "reference", "candidate"), p)
    r = MC.read_metric_csv(spark, p).first()
    assert r["prediction"] == "He goes home." and r["copied_source"] == "False"
    assert r["edit_distance_to_reference"] == "0"


def test_manifest_guarded_reuse(spark, scratch):
    path = os.path.join(scratch, "prefs")
    build = lambda: spark.range(5).withColumnRenamed("id", "x")
    m = {"max_prompt_tokens": 64, "seed": 1}
    assert MF.load_or_build(spark, path, m, build).count() == 5
    assert MF.read_manifest(spark, path) == m
    assert MF.load_or_build(spark, path, m, lambda: None).count() == 5
    try:
        MF.load_or_build(spark, path, {**m, "seed": 2}, build)
        raise AssertionError("manifest mismatch not refused")
    except ValueError:
        pass
    assert MF.load_or_build(spark, path, {**m, "seed": 2}, build, rebuild=True).count() == 5
    assert len([x for x in os.listdir(path) if x.startswith("data-")]) == 2     # the first build's rows are still there
    plain = os.path.join(scratch, "plain")
    spark.range(7).write.parquet(os.path.join(plain, "data"))       # saved without a manifest: used, not rebuilt
    assert MF.load_or_build(spark, plain, m, build).count() == 7
    with pytest.raises(ValueError):
        MF.load_or_build(spark, plain, m, build, length_capped=True)
    broken = os.path.join(path, MF.MANIFEST_DIR, "n=3")
    os.makedirs(broken)                                             # a manifest that was never finished doesn't count
    assert MF.read_manifest(spark, path) == {**m, "seed": 2}
    with open(os.path.join(broken, "_SUCCESS"), "w"):
        pass
    with open(os.path.join(broken, "part-0.txt"), "w") as f:
        f.write("{not json")
    with pytest.raises(ValueError):
        MF.load_or_build(spark, path, m, build)
    parted = MF.load_or_build(spark, os.path.join(scratch, "parted"), m, lambda: spark.range(4).selectExpr("id", "id % 2 AS side"), partition_by=("side",))
    assert parted.where("side = 1").count() == 2
    base = os.path.join(scratch, "pub")
    MF.publish_version(spark.range(3), base, "1", {"k": 1})
    assert MF.read_published(spark, base).count() == 3


def test_streaming_tumbling_mean_equals_batch(spark, scratch):
    d = os.path.join(scratch, "stream_in")
    os.makedirs(d)
    steps = list(range(1, 36))
    for part in range(4):
        chunk = [s for s in steps if (s - 1) // 9 == part]
        pd.DataFrame({"phase": ["train"] * len(chunk), "step": [str(s) for s in chunk],
                      "loss": ["" if s % 5 == 0 else str(s / 10) for s in chunk]}).to_csv(
            os.path.join(d, f"part{part}.csv"), index=False)
    stream = ST.metric_stream(spark, d, ["phase", "step", "loss"])
    agg = ST.complete_windows(ST.tumbling_mean_stream(stream, "loss", 10), 10)
    out = os.path.join(scratch, "means")
    for more in (None, "step,loss,phase\n"):
        if more:        # a restart: lines read twice don't fill a window, but count for its mean as they do in the batch form
            pd.DataFrame({"phase": ["train"] * 3, "step": ["3", "31", "31"], "loss": ["9.0", "1.0", "2.0"]}).to_csv(os.path.join(d, "part9.csv"), index=False)
        ST.run_available_now(agg, ST.row_sink(out), os.path.join(scratch, "ckpt"), output_mode="update")
    rows = ST.last_versions(ST.read_rows(spark, out, agg.schema), ["phase", "window_end_step"])
    got = sorted((r["window_end_step"], round(r["mean"], 9)) for r in rows.collect())
    batch = MT.tumbling_mean(MC.read_metric_csv(spark, d), "loss", 10)
    want = sorted((r["window_end_step"], round(r["mean"], 9)) for r in batch.collect())
    assert got == want and len(want) == 3


def test_two_logs_stay_two_charts(spark, scratch):
    """Equal file names in two folders, a quoted header, rows indexed in file order."""
    texts = {"a": 'step,"loss, smooth",phase\n1,0.5,train\n2,0.4,train\n', "b": 'step,"loss, smooth",phase\n1,9.0,train\n,8.0,train\n,7.0,train\n'}
    for name, text in texts.items():
        os.makedirs(os.path.join(scratch, name))
        with open(os.path.join(scratch, name, "log.csv"), "w") as f:
            f.write(text)
    logs = MC.read_metric_logs(spark, os.path.join(scratch, "*", "log.csv"))
    assert sorted(r["row_idx"] for r in logs.collect()) == [0, 0, 1, 1, 2]
    points = MT.series_points(logs, ["loss, smooth"])
    got = {r["file"].split("/")[-2]: (r["n_points"], r["max_x"], r["first_y"]) for r in MT.series_summary(points).collect()}
    assert got == {"a": (2, 2.0, 0.5), "b": (3, 2.0, 8.0)}
    ranges = MT.axis_range(points)
    assert ranges.count() == 2 and MT.plot_points(points, ranges).count() == 5 and MT.axis_ticks(ranges).count() == 10
    assert [r["file"].split("/")[-2] for r in MT.sorted_points(points).collect()] == ["a", "a", "b", "b", "b"]
    assert MT.candidate_metric_columns(logs) == ["loss, smooth"]


def test_windows_belong_to_a_phase_and_domain(spark):
    """One line of another phase at step 10 neither fills nor breaks the train window."""
    rows = [("train", "", str(s), "1.0") for s in range(1, 11)] + [("val", "", "10", "9.0")]
    df = spark.createDataFrame(rows, "phase string, domain string, step string, loss string")
    got = MT.tumbling_mean(df, "loss", 10).collect()
    assert [(r["phase"], r["window_end_step"], r["mean"]) for r in got] == [("train", 10, 1.0)]
    assert MT.tumbling_mean(df.unionByName(df.limit(1)), "loss", 10).count() == 1


def test_streaming_chunking_equals_batch(spark, scratch):
    from ferrule.plans import fixtures as FX
    src = os.path.join(scratch, "docs")
    FX.domain_documents(spark, SF_SMALL).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src)
    blocks = ST.chunk_stream(stream, "tokens", "domain_id", 256, "<eos>", keep=("doc_id",)).select(
        "doc_id", "block_index", "n_real")
    out = os.path.join(scratch, "blocks")
    ST.run_available_now(blocks, ST.row_sink(out), os.path.join(scratch, "ck2"))
    chunked = ST.read_rows(spark, out, blocks.schema).drop("batch_id")
    batch = C.chunk_pad(spark.read.parquet(src), "tokens", "domain_id", 256, "<eos>", keep=("doc_id",)).select(
        "doc_id", "block_index", "n_real")
    assert chunked.exceptAll(batch).count() == 0
    assert batch.exceptAll(chunked).count() == 0


def test_batch_appender_is_idempotent(spark, scratch):
    out = os.path.join(scratch, "log")
    sink = ST.batch_appender(out, ["phase", "step", "loss"])
    df = spark.createDataFrame([("train", "1", "2")], "phase string, step string, loss string")
    sink(df, 0)
    sink(df, 0)   # a committed batch stays as it is
    assert MC.read_metric_csv(spark, out).count() == 1
    assert spark.read.option("header", True).csv(out).select(F.col("batch")).first()[0] == 0


def test_a_new_checkpoint_keeps_earlier_rows_and_unfinished_batches_do_not_count(spark, scratch):
    source, out, fields = os.path.join(scratch, "in"), os.path.join(scratch, "log"), ["phase", "step", "loss"]
    SK.append_metric_rows(spark.createDataFrame([("train", "1", "2")], "phase string, step string, loss string"), source, fields)
    for state in ("one", "one", "two"):
        ST.run_available_now(ST.metric_stream(spark, source, fields), ST.batch_appender(out, fields), os.path.join(scratch, state))
    assert len(ST.committed(spark, out)) == 2 and ST.read_appended(spark, out, fields).count() == 2
    os.makedirs(os.path.join(out, "query=three", "batch=0"))
    with open(os.path.join(out, "query=three", "batch=0", "part-0.csv"), "w") as f:
        f.write("phase,step,loss\ntrain,2,3\n")
    assert ST.read_appended(spark, out, fields).count() == 2
    assert ST.read_appended(spark, os.path.join(scratch, "none"), fields).count() == 0
