"""Router and loss queries over the router-logit fixtures F3/F4 (RTR*, LOS*, JOIN3, JOIN10, MTH_1, STR_11, SNK3-SNK5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import mathfn as M
from ferrule.operators import router as R
from ferrule.plans import fixtures as FX
from ferrule.plans import oracle_sql as O
from ferrule.plans.catalog import register

LAYER = 15
E = FX.N_EXPERTS
BATCH = 4
LB_COEF = 0.01
SPEC_COEF = 0.01

_AM = O.argmax("logits")
_LSE = O.lse("logits")
_DOM = "dom AS (SELECT * FROM (VALUES (0, 'code'), (1, 'math'), (2, 'chat')) v(domain_id, domain))"


def _label_sql(e: str) -> str:
    return (f"CASE {e} WHEN 0 THEN 'Expert 0 (Code)' WHEN 1 THEN 'Expert 1 (Math)' "
            f"WHEN 2 THEN 'Expert 2 (Chat)' ELSE 'Expert ' || CAST({e} AS VARCHAR) END")


_LONG_SQL = f"""
, {_DOM},
cnt AS (SELECT domain_id, {_AM} AS expert, count(*) AS n FROM f3 WHERE layer = {LAYER} AND domain_id >= 0 GROUP BY ALL),
grid AS (SELECT domain_id, domain, CAST(e AS INTEGER) AS expert FROM dom, range(0, {E}) t(e)),
cells AS (SELECT g.domain_id, g.domain, g.expert, coalesce(c.n, 0) AS n
          FROM grid g LEFT JOIN cnt c ON g.domain_id = c.domain_id AND g.expert = c.expert),
tot AS (SELECT domain_id, sum(n) AS row_n FROM cells GROUP BY domain_id),
long AS (SELECT c.domain_id, domain, expert, 100.0 * n / greatest(row_n, 1) AS pct
         FROM cells c JOIN tot USING (domain_id))"""


def _long(spark, sf_dir, after=False):
    rl = FX.router_logits(spark, sf_dir, after=after, layers=(LAYER, LAYER))
    return R.routing_long(rl, LAYER, FX.domain_dim(spark), E)


@register("q_routing_matrix", O.with_(O.f3()) + _LONG_SQL + f"""
SELECT domain_id, domain, {", ".join(f"round(max(pct) FILTER (WHERE expert = {e}), 6) AS expert_{e}" for e in range(E))}
FROM long GROUP BY domain_id, domain""")
def q_routing_matrix(spark, sf_dir):
    """RTR1: routing matrix at one layer (% of real tokens per expert, per domain)."""
    rl = FX.router_logits(spark, sf_dir, layers=(LAYER, LAYER))
    m = R.routing_matrix(rl, LAYER, FX.domain_dim(spark), E)
    return m.select("domain_id", "domain", *[F.round(f"expert_{e}", 6).alias(f"expert_{e}") for e in range(E)])


@register("q_routing_matrix_notebook", O.with_(O.f3()) + f"""
, first AS (SELECT DISTINCT block_id FROM f3 WHERE layer = {LAYER} AND block_id % 2 = 1 ORDER BY block_id LIMIT 200),
cnt AS (SELECT domain_id, {_AM} AS expert, count(*) AS n FROM f3 SEMI JOIN first USING (block_id) WHERE layer = {LAYER} AND domain_id >= 0 GROUP BY ALL),
tot AS (SELECT domain_id, sum(n) AS row_n FROM cnt GROUP BY domain_id),
{_DOM}
SELECT dom.domain_id, domain, {", ".join(f"round(coalesce(max(100.0 * n / (row_n + 0.000001)) FILTER (WHERE expert = {e}), 0), 6) AS expert_{e}" for e in range(E))}
FROM dom LEFT JOIN cnt USING (domain_id) LEFT JOIN tot USING (domain_id) GROUP BY dom.domain_id, domain""")
def q_routing_matrix_notebook(spark, sf_dir):
    """RTR4: routing matrix over the first 200 of the odd blocks, with 1e-6 added to each domain's count."""
    rl = FX.router_logits(spark, sf_dir, layers=(LAYER, LAYER)).where("block_id % 2 = 1")
    m = R.routing_matrix(rl, LAYER, FX.domain_dim(spark), E, eps=1e-6, max_blocks=200)
    return m.select("domain_id", "domain", *[F.round(f"expert_{e}", 6).alias(f"expert_{e}") for e in range(E)])


@register("q_routing_matrix_long", O.with_(O.f3()) + _LONG_SQL + f"""
SELECT domain_id, domain, expert, {_label_sql('expert')} AS expert_label, round(pct, 6) AS pct FROM long""")
def q_routing_matrix_long(spark, sf_dir):
    """RTR2/STR_11/JOIN4: long routing matrix with expert labels (broadcast domain dimension)."""
    return _long(spark, sf_dir).withColumn("pct", F.round("pct", 6))


def _viridis_sql(v: str, lo: str, hi: str) -> str:
    t = f"(CASE WHEN {hi} <= {lo} THEN 1.0 ELSE least(1.0, greatest(0.0, ({v} - {lo}) / ({hi} - {lo}))) END)"
    stops = "[[68, 1, 84], [59, 82, 139], [33, 145, 140], [94, 201, 98], [253, 231, 37]]"
    idx = f"CAST(least(floor({t} * 4), 3) AS INTEGER)"
    loc = f"({t} * 4 - {idx})"
    ch = [f"printf('%02x', CAST(round_even({stops}[{idx} + 1][{k}] + ({stops}[{idx} + 2][{k}] - {stops}[{idx} + 1][{k}]) * {loc}, 0) AS INTEGER))"
          for k in (1, 2, 3)]
    return "'#' || " + " || ".join(ch)


@register("q_heatmap_cells", O.with_(O.f3()) + _LONG_SQL + f"""
, mm AS (SELECT min(pct) AS lo, max(pct) AS hi FROM long)
SELECT domain_id, domain, expert, {_label_sql('expert')} AS expert_label, round(pct, 6) AS pct,
       {_viridis_sql('pct', 'lo', 'hi')} AS color, printf('%.1f', round_even(pct, 1)) || '%' AS cell_text
FROM long, mm""")
def q_heatmap_cells(spark, sf_dir):
    """RTR3/MTH_1: heat-map cells - colour on the viridis ramp and 1-decimal text."""
    cells = R.heatmap_cells(_long(spark, sf_dir))
    return cells.withColumn("pct", F.round("pct", 6))


@register("q_expert_utilization", O.with_(O.f3()) + f"""
, cnt AS (SELECT layer, {_AM} AS expert, count(*) AS n FROM f3 GROUP BY ALL),
grid AS (SELECT layer, CAST(e AS INTEGER) AS expert FROM (SELECT DISTINCT layer FROM f3), range(0, {E}) t(e))
SELECT g.layer, g.expert, coalesce(c.n, 0) AS n_tokens FROM grid g LEFT JOIN cnt c USING (layer, expert)""")
def q_expert_utilization(spark, sf_dir):
    """RTR5: tokens per (layer, expert) with zero cells kept."""
    return R.expert_utilization(FX.router_logits(spark, sf_dir), E).select("layer", "expert", "n_tokens")


@register("q_active_expert_pct", O.with_(O.f3()) + f"""
, used AS (SELECT count(DISTINCT (layer, {_AM})) AS n_used FROM f3),
slots AS (SELECT count(DISTINCT layer) * {E} AS n_slots FROM f3)
SELECT round(100.0 * n_used / greatest(n_slots, 1), 6) AS active_expert_pct, n_slots FROM used, slots""")
def q_active_expert_pct(spark, sf_dir):
    """RTR6: % of (layer, expert) slots that received at least one token (pads counted)."""
    out = R.active_expert_pct(FX.router_logits(spark, sf_dir), E)
    return out.select(F.round("active_expert_pct", 6).alias("active_expert_pct"), "n_slots")


_LB_SQL = f"""
, lb_rows AS (SELECT layer, {_AM} AS e, list_transform(logits, lambda x: exp(x - {_LSE})) AS p FROM f3),
lb AS (SELECT layer, {E}.0 * ({" + ".join(f"avg(CASE WHEN e = {e} THEN 1.0 ELSE 0.0 END) * avg(p[{e + 1}])" for e in range(E))})
              AS load_balance_loss, count(*) AS n_tokens FROM lb_rows GROUP BY layer)"""


@register("q_load_balance_loss", O.with_(O.f3()) + _LB_SQL + """
SELECT layer, round(load_balance_loss, 6) AS load_balance_loss, n_tokens FROM lb""")
def q_load_balance_loss(spark, sf_dir):
    """RTR7: Switch-style load-balancing loss per layer (1.0 = uniform routing)."""
    lb = R.load_balance_loss(FX.router_logits(spark, sf_dir), E)
    return lb.select("layer", F.round("load_balance_loss", 6).alias("load_balance_loss"), "n_tokens")


_SPEC_SQL = f"""
, spec AS (SELECT layer, avg({_LSE} - logits[domain_id + 1]) AS spec_loss, count(*) AS n_tokens
           FROM f3 WHERE domain_id <> -100 GROUP BY layer)"""


@register("q_specialization_loss", O.with_(O.f3()) + _SPEC_SQL + """
SELECT layer, round(spec_loss, 6) AS spec_loss, n_tokens FROM spec""")
def q_specialization_loss(spark, sf_dir):
    """RTR8: router cross-entropy against the domain's expert per layer (pads ignored)."""
    s = R.specialization_loss(FX.router_logits(spark, sf_dir))
    return s.select("layer", F.round("spec_loss", 6).alias("spec_loss"), "n_tokens")


@register("q_kl_guidance_loss", O.with_(O.f3()) + f"""
, tok AS (SELECT layer, list_sum(list_transform(logits, lambda x, i:
              (CASE WHEN i - 1 = domain_id THEN 0.998 ELSE 0.001 END) *
              (ln(CASE WHEN i - 1 = domain_id THEN 0.998 ELSE 0.001 END) - (x - {_LSE})))) AS kl
          FROM f3 WHERE domain_id >= 0 AND domain_id < 3),
per_layer AS (SELECT layer, sum(kl) / count(*) AS layer_kl FROM tok GROUP BY layer)
SELECT round(coalesce(sum(layer_kl) FILTER (WHERE isfinite(layer_kl)), 0.0) / {FX.N_LAYERS}.0, 6) AS kl_guidance_loss,
       count(*) FILTER (WHERE isfinite(layer_kl)) AS n_layers_used FROM per_layer""")
def q_kl_guidance_loss(spark, sf_dir):
    """RTR9: KL guidance loss towards high_p on the domain's expert (batchmean, / all layers)."""
    out = R.kl_guidance_loss(FX.router_logits(spark, sf_dir), E, len(FX.DOMAINS), FX.N_LAYERS)
    return out.select(F.round("kl_guidance_loss", 6).alias("kl_guidance_loss"), "n_layers_used")


@register("q_kl_guidance_shared", O.with_(O.f3()) + f"""
, tok AS (SELECT layer, list_sum(list_transform(logits, lambda x, i:
              (CASE WHEN i - 1 IN (domain_id, (domain_id + 1) % 3) THEN 0.4995 ELSE 0.001 END) *
              (ln(CASE WHEN i - 1 IN (domain_id, (domain_id + 1) % 3) THEN 0.4995 ELSE 0.001 END) - (x - {_LSE})))) AS kl
          FROM f3 WHERE domain_id >= 0 AND domain_id < 3),
per_layer AS (SELECT layer, sum(kl) / count(*) AS layer_kl FROM tok GROUP BY layer)
SELECT round(sum(layer_kl) / {FX.N_LAYERS}.0, 6) AS kl_guidance_loss, count(*) AS n_layers_used FROM per_layer""")
def q_kl_guidance_shared(spark, sf_dir):
    """RTR9: KL guidance loss where every domain has two experts, shared with its neighbours."""
    experts = {d: [d, (d + 1) % E] for d in range(len(FX.DOMAINS))}
    out = R.kl_guidance_loss(FX.router_logits(spark, sf_dir), E, len(FX.DOMAINS), FX.N_LAYERS, experts=experts)
    return out.select(F.round("kl_guidance_loss", 6).alias("kl_guidance_loss"), "n_layers_used")


@register("q_specialization_mean", O.with_(O.f3()) + _SPEC_SQL + """
SELECT 'all' AS layers, round(avg(spec_loss), 6) AS spec_loss, count(*) AS n_layers FROM spec
UNION ALL SELECT 'none', 0.0, 0""")
def q_specialization_mean(spark, sf_dir):
    """RTR8: the mean specialisation loss of all layers, and 0 where no layer is selected."""
    rl = FX.router_logits(spark, sf_dir)
    parts = [R.mean_specialization_loss(x).select(F.lit(name).alias("layers"), F.round("spec_loss", 6).alias("spec_loss"), "n_layers")
             for name, x in (("all", rl), ("none", rl.where("layer < 0")))]
    return parts[0].unionByName(parts[1])


@register("q_token_routing", O.with_(O.f3()) + f"""
SELECT {O.domain_name('CAST(block_id % 3 AS INTEGER)')} AS domain, 'block ' || CAST(block_id AS VARCHAR) AS sentence,
       pos AS token_index, replace(CAST(token AS VARCHAR), chr(288), ' ') AS token, {_AM} AS expert
FROM f3 WHERE layer = {LAYER} AND mask = 1""")
def q_token_routing(spark, sf_dir):
    """RTR10/SNK5/STR_12/ARR_2: flat token -> expert rows per sentence (block)."""
    rl = FX.router_logits(spark, sf_dir, layers=(LAYER, LAYER), with_label=True)
    t = R.token_routing(rl, LAYER)
    return t.select(FX.domain_name((F.col("block_id") % 3).cast("int")).alias("domain"),
                    F.concat(F.lit("block "), F.col("block_id").cast("string")).alias("sentence"),
                    "token_index", "token", "expert")


@register("q_dominant_expert", O.with_(O.f3()) + f"""
, c AS (SELECT block_id, {_AM} AS expert, count(*) AS n FROM f3 WHERE layer = {LAYER} AND mask = 1 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY n DESC, expert) AS rn,
             sum(n) OVER (PARTITION BY block_id) AS tot FROM c)
SELECT block_id, expert AS dominant_expert, round(100.0 * n / tot, 6) AS share_pct, CAST(tot AS BIGINT) AS n_tokens
FROM r WHERE rn = 1""")
def q_dominant_expert(spark, sf_dir):
    """RTR11: dominant expert per sentence and its share (ties -> lowest expert)."""
    d = R.dominant_expert(FX.router_logits(spark, sf_dir, layers=(LAYER, LAYER)), LAYER)
    return d.select("block_id", "dominant_expert", F.round("share_pct", 6).alias("share_pct"), "n_tokens")


@register("q_masked_token_nll", O.with_(O.f4()) + """
SELECT count(*) AS n_tokens, round(avg(nll), 6) AS lm_loss FROM f4""")
def q_masked_token_nll(spark, sf_dir):
    """LOS1/JOIN5: masked next-token cross-entropy (mean over kept tokens)."""
    t = FX.token_nll(spark, sf_dir)
    return t.agg(F.count(F.lit(1)).alias("n_tokens"), F.round(F.avg("nll"), 6).alias("lm_loss"))


def _batch_sql(name: str, group: str | None) -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""
, {name}_b AS (SELECT {g}block_id, sum(nll) AS s, count(*) AS c FROM {name} GROUP BY ALL),
{name}_r AS (SELECT *, (row_number() OVER ({part}ORDER BY block_id) - 1) // {BATCH} AS batch_id FROM {name}_b),
{name}_m AS (SELECT {g}batch_id, sum(s) / sum(c) AS m, sum(s) AS s, sum(c) AS c FROM {name}_r GROUP BY ALL),
{name}_l AS (SELECT {g}avg(m) AS loss, sum(s) / sum(c) AS token_mean_loss, count(*) AS n_batches
             FROM {name}_m {"GROUP BY " + group if group else ""})"""


@register("q_batch_mean_loss", O.with_(O.f4()) + _batch_sql("f4", None) + """
SELECT round(loss, 6) AS loss, round(token_mean_loss, 6) AS token_mean_loss, n_batches FROM f4_l""")
def q_batch_mean_loss(spark, sf_dir):
    """LOS2: held-out loss as the mean of batch means (batches of 4 blocks in block order)."""
    out = R.batch_mean_loss(FX.token_nll(spark, sf_dir), BATCH)
    return out.select(F.round("loss", 6).alias("loss"), F.round("token_mean_loss", 6).alias("token_mean_loss"),
                      "n_batches")


def _domain_loss_df(spark, sf_dir, after=False):
    t = FX.token_nll(spark, sf_dir, after=after).withColumn(
        "domain", FX.domain_name((F.col("block_id") % 3).cast("int")))
    return R.batch_mean_loss(t, BATCH, group="domain")


def _dom_nll_sql(after: bool, name: str) -> str:
    return O.f4(after, name + "_t").strip("\n") + f""",
{name} AS (SELECT {O.domain_name('CAST(block_id % 3 AS INTEGER)')} AS domain, block_id, nll FROM {name}_t)"""


@register("q_domain_loss", O.with_(_dom_nll_sql(False, "bt")) + _batch_sql("bt", "domain") + """
SELECT domain, round(loss, 6) AS loss, round(token_mean_loss, 6) AS token_mean_loss, n_batches FROM bt_l""")
def q_domain_loss(spark, sf_dir):
    """LOS3: per-domain held-out loss, batches formed inside each domain."""
    out = _domain_loss_df(spark, sf_dir)
    return out.select("domain", F.round("loss", 6).alias("loss"),
                      F.round("token_mean_loss", 6).alias("token_mean_loss"), "n_batches")


@register("q_domain_loss_change", O.with_(_dom_nll_sql(False, "bt"), _dom_nll_sql(True, "aft")) +
          _batch_sql("bt", "domain") + _batch_sql("aft", "domain") + """
SELECT b.domain, round(b.loss, 6) AS before, round(a.loss, 6) AS after, round(a.loss - b.loss, 6) AS change,
       CASE WHEN a.loss - b.loss < 0 THEN 'good' ELSE 'bad' END AS direction,
       printf('%.6g', b.loss) AS before_text, printf('%.6g', a.loss) AS after_text,
       printf('%+.6g', a.loss - b.loss) AS change_text
FROM bt_l b LEFT JOIN aft_l a USING (domain)""")
def q_domain_loss_change(spark, sf_dir):
    """JOIN3/SNK4/MET8: before vs after per-domain loss, signed change and direction."""
    before = _domain_loss_df(spark, sf_dir, after=False)
    after = _domain_loss_df(spark, sf_dir, after=True)
    ba = R.before_after(before, after, "domain", "loss")
    return ba.select("domain", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"),
                     F.round("change", 6).alias("change"), "direction",
                     M.format_g6("before").alias("before_text"), M.format_g6("after").alias("after_text"),
                     M.format_g6("change", signed=True).alias("change_text"))


@register("q_total_loss", O.with_(O.f3(), O.f4().strip("\n")) + _LB_SQL + _SPEC_SQL + f"""
, parts AS (SELECT (SELECT avg(nll) FROM f4) AS lm, (SELECT avg(load_balance_loss) FROM lb) AS lbl,
                   (SELECT avg(spec_loss) FROM spec) AS sp)
SELECT round(lm, 6) AS lm_loss, round(lbl, 6) AS lb_loss, round(sp, 6) AS spec_loss,
       round(lm + {LB_COEF} * lbl + {SPEC_COEF} * sp, 6) AS total_loss FROM parts""")
def q_total_loss(spark, sf_dir):
    """LOS4: weighted total lm + a * balance + b * specialisation (a = b = 0.01)."""
    rl = FX.router_logits(spark, sf_dir)
    lm = FX.token_nll(spark, sf_dir).agg(F.avg("nll"))
    lb = R.load_balance_loss(rl, E).agg(F.avg("load_balance_loss"))
    sp = R.specialization_loss(rl).agg(F.avg("spec_loss"))
    s = R.combine_scalars({"lm": lm, "lb": lb, "sp": sp})
    return s.select(F.round("lm", 6).alias("lm_loss"), F.round("lb", 6).alias("lb_loss"),
                    F.round("sp", 6).alias("spec_loss"),
                    F.round(F.col("lm") + LB_COEF * F.col("lb") + SPEC_COEF * F.col("sp"), 6).alias("total_loss"))


@register("q_table_max_abs_diff", O.with_(O.f3(False, "fb"), O.f3(True, "fa").strip("\n")) + """
SELECT count(*) FILTER (WHERE fb.layer IS NOT NULL AND fa.layer IS NOT NULL) AS n_compared,
       count(*) FILTER (WHERE fb.layer IS NULL OR fa.layer IS NULL) AS n_unmatched,
       round(max(list_max(list_transform(list_zip(fb.logits, fa.logits), lambda z: abs(z[1] - z[2])))), 6) AS max_abs_diff
FROM fb FULL OUTER JOIN fa ON fb.layer = fa.layer AND fb.block_id = fa.block_id AND fb.pos = fa.pos""")
def q_table_max_abs_diff(spark, sf_dir):
    """JOIN10: parity check of two router-logit tables (before vs after)."""
    keys = ["layer", "block_id", "pos"]
    out = R.max_abs_diff(FX.router_logits(spark, sf_dir), FX.router_logits(spark, sf_dir, after=True), keys)
    return out.select("n_compared", "n_unmatched", F.round("max_abs_diff", 6).alias("max_abs_diff"))
