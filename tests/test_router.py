import math

import pytest
from pyspark.sql import functions as F

from ferrule.functions import arrays as A
from ferrule.operators import router as R
from ferrule.plans import fixtures as FX


def _rl(spark, rows):
    return spark.createDataFrame(rows, "layer int, block_id long, pos int, domain_id int, mask int, logits array<double>")


def test_load_balance_is_one_for_uniform_routing(spark):
    rows = [(0, 0, e, e, 1, [5.0 if i == e else 0.0 for i in range(3)]) for e in range(3)]
    lb = R.load_balance_loss(_rl(spark, rows), 3).first()["load_balance_loss"]
    assert abs(lb - 1.0) < 0.01


def test_load_balance_is_finite(spark):
    rows = [(0, 0, 0, 0, 1, [4.0, 1.0, 0.0]), (0, 0, 1, 0, 1, [0.0, 3.0, 1.0]),
            (0, 1, 0, 0, 1, [0.0, 0.0, 2.0]), (0, 1, 1, 0, 1, [1.0, 2.0, 0.0])]
    lb = R.load_balance_loss(_rl(spark, rows), 3).first()["load_balance_loss"]
    assert math.isfinite(lb)


def test_specialization_loss_ignores_padding(spark):
    rows = [(0, 0, 0, 0, 1, [8.0, 0.0, 0.0]), (0, 0, 1, 2, 1, [0.0, 0.0, 8.0]), (0, 0, 2, -100, 0, [2.0, 2.0, 2.0])]
    r = R.specialization_loss(_rl(spark, rows)).first()
    assert r["spec_loss"] < 0.01 and r["n_tokens"] == 2


def test_masked_next_token_loss(spark):
    # zero logits over 5 classes, mask 1 1 0 0: one kept position, loss ln 5
    from ferrule.functions import arrays as A
    df = spark.createDataFrame([(0, t, tok, m) for t, (tok, m) in enumerate(zip([1, 2, 3, 4], [1, 1, 0, 0]))],
                               "block_id long, pos int, token int, mask int")
    from pyspark.sql import Window
    w = Window.partitionBy("block_id").orderBy("pos")
    x = df.select("*", F.lead("token").over(w).alias("nt"), F.lead("mask").over(w).alias("nm"),
                  F.array(*[F.lit(0.0)] * 5).alias("logits"))
    kept = x.where(F.col("nm") == 1).select(A.nll_at("logits", F.col("nt")).alias("nll"))
    rows = kept.collect()
    assert len(rows) == 1 and abs(rows[0]["nll"] - math.log(5)) < 1e-9


def test_routing_matrix_rows_sum_to_100_and_empty_domain_is_zero(spark):
    rows = [(15, 0, 0, 0, 1, [3.0, 1.0, 0.0]), (15, 0, 1, 0, 1, [0.0, 3.0, 1.0]),
            (15, 1, 0, 1, 1, [0.0, 0.0, 2.0]), (15, 1, 1, -100, 0, [9.0, 0.0, 0.0])]
    m = {r["domain"]: r for r in R.routing_matrix(_rl(spark, rows), 15, FX.domain_dim(spark), 3).collect()}
    assert abs(m["code"]["expert_0"] - 50.0) < 1e-9 and abs(m["code"]["expert_1"] - 50.0) < 1e-9
    assert m["math"]["expert_2"] == 100.0
    assert m["chat"]["expert_0"] == 0.0 and m["chat"]["expert_1"] == 0.0


def test_utilization_grid_keeps_zero_cells(spark):
    rows = [(0, 0, 0, 0, 1, [3.0, 1.0, 0.0]), (1, 0, 0, 0, 1, [0.0, 3.0, 1.0])]
    u = R.expert_utilization(_rl(spark, rows), 3)
    assert u.count() == 6 and u.where("n_tokens = 0").count() == 4
    pct = R.active_expert_pct(_rl(spark, rows), 3).first()["active_expert_pct"]
    assert abs(pct - 100.0 * 2 / 6) < 1e-9


def test_dominant_expert_tie_goes_to_lowest(spark):
    rows = [(0, 7, 0, 0, 1, [0.0, 1.0, 0.0]), (0, 7, 1, 0, 1, [0.0, 0.0, 1.0])]
    r = R.dominant_expert(_rl(spark, rows), 0).first()
    assert r["dominant_expert"] == 1 and r["share_pct"] == 50.0


def test_before_after_and_missing_key(spark):
    before = spark.createDataFrame([("code", 2.0), ("math", 1.0)], "domain string, loss double")
    after = spark.createDataFrame([("code", 1.5)], "domain string, loss double")
    rows = {r["domain"]: r for r in R.before_after(before.where("domain = 'code'"), after, "domain", "loss").collect()}
    assert rows["code"]["change"] == -0.5 and rows["code"]["direction"] == "good"
    with pytest.raises(Exception, match="no 'after' row for domain math"):
        R.before_after(before, after, "domain", "loss").collect()
    null = spark.createDataFrame([("code", None), ("math", 3.0)], "domain string, loss double")
    rows = {r["domain"]: r["direction"] for r in R.before_after(before, null, "domain", "loss").collect()}
    assert rows == {"code": None, "math": "bad"}


def test_parity_tolerance(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "k long, logits array<double>")
    b = spark.createDataFrame([(1, [1.0, 2.5]), (2, [0.0, 1.0])], "k long, logits array<double>")
    assert R.max_abs_diff(a, b, ["k"]).first()["max_abs_diff"] == 0.5
    assert R.max_abs_diff(a, b, ["k"], tolerance=0.5).first()["n_compared"] == 2
    with pytest.raises(Exception, match="tables differ"):
        R.max_abs_diff(a, b, ["k"], tolerance=0.1).collect()
    with pytest.raises(Exception, match="tables differ"):
        R.max_abs_diff(a, b.where("k = 1"), ["k"], tolerance=9.0).collect()


def test_softmax_is_linear_in_the_expert_count(spark):
    import time
    times = {}
    for n in (4, 64):
        df = spark.range(0, 20_000, 1, 1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (F.col("id") % (i + 7)).cast("double")).alias("z")).cache()
        df.count()
        out = df.select(A.softmax("z").alias("p"), A.nll_at("z", F.lit(1)).alias("l"))
        out.write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        out.write.format("noop").mode("overwrite").save()
        times[n] = time.perf_counter() - start
        assert abs(out.select(A.array_sum("p").alias("s")).first()["s"] - 1) < 1e-9
        df.unpersist()
    assert times[64] < 25 * times[4] + 0.5


def test_losses_without_layers_are_zero_and_domains_may_share_experts(spark):
    rows = [(0, 0, 0, 0, 1, [1.0, 2.0, 0.5]), (0, 0, 1, 1, 1, [0.0, 0.0, 3.0]), (0, 0, 2, -100, 0, [9.0, 0.0, 0.0])]
    rl = _rl(spark, rows)
    assert tuple(R.mean_specialization_loss(rl.where("layer > 5")).first()) == (0.0, 0)
    assert R.mean_specialization_loss(rl).first()["spec_loss"] == R.specialization_loss(rl).first()["spec_loss"]
    experts = {0: [0, 1], 1: [2, 0]}
    got = R.kl_guidance_loss(rl, 3, 2, 1, experts=experts).first()["kl_guidance_loss"]
    want = 0.0
    for _, _, _, domain, _, z in rows[:2]:
        total = math.log(sum(math.exp(x) for x in z))
        for e, x in enumerate(z):
            t = (1 - 0.001) / 2 if e in experts[domain] else 0.001
            want += t * (math.log(t) - (x - total)) / 2
    assert math.isclose(got, want, rel_tol=1e-9)


def test_next_token_loss_stays_in_its_block(spark):
    rows = [(1, 0, 2, 1, [0.0, 1.0, 2.0]), (1, 1, 0, 1, [1.0, 1.0, 1.0]), (1, 2, 1, 0, [0.0, 0.0, 0.0]), (2, 0, 1, 1, [3.0, 0.0, 0.0]), (2, 1, 1, 1, [0.0, 0.0, 0.0])]
    got = {(r["block_id"], r["pos"]): r["nll"] for r in R.next_token_nll(spark.createDataFrame(rows, "block_id long, pos int, token int, mask int, logits array<double>")).collect()}
    loss = lambda z, k: math.log(sum(math.exp(x) for x in z)) - z[k]
    assert set(got) == {(1, 0), (2, 0)}
    assert math.isclose(got[1, 0], loss([0.0, 1.0, 2.0], 0)) and math.isclose(got[2, 0], loss([3.0, 0.0, 0.0], 1))
    assert R.next_token_nll(spark.createDataFrame([], "block_id long, pos int, token int, mask int, logits array<double>")).count() == 0


def test_first_blocks_go_by_rank(spark):
    rows = [(0, b, 0, 0, 1, [1.0, 0.0, 0.0] if b < 100 else [0.0, 1.0, 0.0]) for b in (50, 70, 900, 901)]
    dim = spark.createDataFrame([(0, "code")], "domain_id int, domain string")
    got = R.routing_matrix(_rl(spark, rows), 0, dim, 3, eps=0.0, max_blocks=2).first()
    assert (got["expert_0"], got["expert_1"]) == (100.0, 0.0)
