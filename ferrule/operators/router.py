"""Router and loss analytics over a long table of router logits (RTR*, LOS*, JOIN3, JOIN10).

Input ``router_logits(layer, block_id, pos, domain_id, mask, logits array<double>)``
- one row per (layer, token). Logits are never collected: argmax, softmax and
cross-entropy are row-wise array expressions, followed by small partial/final
aggregations keyed by (layer[, domain], expert). The expert count is a
parameter (the model's configuration), so per-expert statistics are plain
conditional aggregates rather than an explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import arrays as A
from ferrule.functions import mathfn as M
from ferrule.operators.ordering import position

IGNORE_INDEX = -100
# --- fixed values: default expert -> domain names, guidance target floor -----
DEFAULT_EXPERT_DOMAINS = {0: "Code", 1: "Math", 2: "Chat"}
LOW_P = 0.001
# -----------------------------------------------------------------------------


def with_expert(rl: DataFrame) -> DataFrame:
    return rl.withColumn("expert", A.argmax("logits"))


def routing_counts(rl: DataFrame, layer: int, max_blocks: int | None = None) -> DataFrame:
    """Real-token counts per (domain_id, expert) at one layer (pads skipped)."""
    rows = rl.where((F.col("layer") == layer) & (F.col("domain_id") >= 0))
    if max_blocks is not None:      # the first blocks that there are, whatever their numbers; at most ``max_blocks`` rows to broadcast
        first = rl.where(F.col("layer") == layer).select("block_id").distinct().orderBy("block_id").limit(max_blocks)
        rows = rows.join(F.broadcast(first), "block_id", "left_semi")
    x = with_expert(rows)
    return x.groupBy("domain_id", "expert").agg(F.count(F.lit(1)).alias("n"))


def routing_long(rl: DataFrame, layer: int, domains: DataFrame, n_experts: int,
                 eps: float | None = None, max_blocks: int | None = None) -> DataFrame:
    """RTR2: ``(domain_id, domain, expert, expert_label, pct)``; every domain x expert cell present.

    ``domains`` is the small domain dimension (broadcast); an empty domain
    gets 0 % everywhere (row sum clamped to 1). RTR4 (notebook form): ``eps``
    makes the denominator ``row sum + eps`` and ``max_blocks`` limits the
    input to the first blocks (the notebook's first batches).
    """
    cnt = routing_counts(rl, layer, max_blocks)
    grid = F.broadcast(domains).select("domain_id", "domain",
                                       F.explode(F.sequence(F.lit(0), F.lit(n_experts - 1))).alias("expert"))
    cells = grid.join(cnt, ["domain_id", "expert"], "left").fillna(0, subset=["n"])
    tot = cells.groupBy("domain_id").agg(F.sum("n").alias("row_n"))
    out = cells.join(tot, "domain_id")
    denom = (F.col("row_n") + F.lit(eps)) if eps is not None else F.greatest(F.col("row_n"), F.lit(1))
    pct = F.lit(100.0) * F.col("n") / denom
    return out.select("domain_id", "domain", "expert", expert_label(F.col("expert")).alias("expert_label"),
                      pct.alias("pct"))


def routing_matrix(rl: DataFrame, layer: int, domains: DataFrame, n_experts: int,
                   eps: float | None = None, max_blocks: int | None = None) -> DataFrame:
    """RTR1: % of each domain's real tokens per expert, one column per expert (pivot with values); RTR4 with ``eps`` and ``max_blocks``."""
    long = routing_long(rl, layer, domains, n_experts, eps, max_blocks)
    wide = long.groupBy("domain_id", "domain").pivot("expert", list(range(n_experts))).agg(F.first("pct"))
    return wide.select("domain_id", "domain", *[F.col(str(e)).alias(f"expert_{e}") for e in range(n_experts)])


def expert_label(expert: Column, domains: dict[int, str] | None = None) -> Column:
    """STR_11: ``Expert i (Domain)`` for mapped experts, else ``Expert i``."""
    m = domains or DEFAULT_EXPERT_DOMAINS
    name = F.lit(None).cast("string")
    for i, d in reversed(list(m.items())):
        name = F.when(expert == i, F.lit(d)).otherwise(name)
    base = F.concat(F.lit("Expert "), expert.cast("string"))
    return F.when(name.isNotNull(), F.concat(base, F.lit(" ("), name, F.lit(")"))).otherwise(base)


def heatmap_cells(long: DataFrame, value: str = "pct", suffix: str = "%") -> DataFrame:
    """RTR3: global min/max (a one-row aggregate), colour and 1-decimal text per cell."""
    mm = long.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")).withColumn("__one", F.lit(1))
    # the aggregate has exactly one row: a bounded broadcast, joined on a constant key
    j = long.withColumn("__one", F.lit(1)).join(F.broadcast(mm), "__one")
    return j.select(*long.columns, M.viridis_color(F.col(value), F.col("__lo"), F.col("__hi")).alias("color"),
                    F.concat(M.fixed(F.col(value), 1), F.lit(suffix)).alias("cell_text"))


def expert_utilization(rl: DataFrame, n_experts: int) -> DataFrame:
    """RTR5: tokens per (layer, expert), zero cells kept (pads counted, like the model)."""
    x = with_expert(rl)
    cnt = x.groupBy("layer", "expert").agg(F.count(F.lit(1)).alias("n_tokens"))
    grid = rl.select("layer").distinct().select(
        "layer", F.explode(F.sequence(F.lit(0), F.lit(n_experts - 1))).alias("expert"))
    return grid.join(cnt, ["layer", "expert"], "left").fillna(0, subset=["n_tokens"])


def active_expert_pct(rl: DataFrame, n_experts: int) -> DataFrame:
    """RTR6: % of (layer, expert) slots with at least one token; 0 for no input."""
    u = expert_utilization(rl, n_experts)
    return u.agg((F.lit(100.0) * F.count_if(F.col("n_tokens") > 0) /
                  F.greatest(F.count(F.lit(1)), F.lit(1))).alias("active_expert_pct"),
                 F.count(F.lit(1)).alias("n_slots"))


def load_balance_loss(rl: DataFrame, n_experts: int) -> DataFrame:
    """RTR7: per layer ``E * sum_e load_e * importance_e`` over all tokens (pads included)."""
    x = rl.select("layer", A.argmax("logits").alias("e"), A.softmax("logits").alias("p"))
    aggs = []
    for e in range(n_experts):
        aggs += [F.avg(F.when(F.col("e") == e, 1.0).otherwise(0.0)).alias(f"load_{e}"),
                 F.avg(F.element_at("p", e + 1)).alias(f"imp_{e}")]
    g = x.groupBy("layer").agg(*aggs, F.count(F.lit(1)).alias("n_tokens"))
    loss = F.lit(float(n_experts)) * sum(F.col(f"load_{e}") * F.col(f"imp_{e}") for e in range(n_experts))
    return g.select("layer", loss.alias("load_balance_loss"), "n_tokens")


def specialization_loss(rl: DataFrame, target: str = "domain_id") -> DataFrame:
    """RTR8: per layer mean cross-entropy of the router against the target expert (-100 ignored)."""
    x = rl.where(F.col(target) != IGNORE_INDEX).select("layer", A.nll_at("logits", F.col(target)).alias("ce"))
    return x.groupBy("layer").agg(F.avg("ce").alias("spec_loss"), F.count(F.lit(1)).alias("n_tokens"))


def mean_specialization_loss(rl: DataFrame, target: str = "domain_id") -> DataFrame:
    """RTR8 over all layers: one row with the mean of the layers' losses, 0 where there is no layer."""
    return specialization_loss(rl, target).agg(F.coalesce(F.avg("spec_loss"), F.lit(0.0)).alias("spec_loss"), F.count(F.lit(1)).alias("n_layers"))


def kl_guidance_loss(rl: DataFrame, n_experts: int, n_domains: int, n_layers: int,
                     low_p: float = LOW_P, experts: dict[int, list[int]] | None = None) -> DataFrame:
    """RTR9: KL(target || router) with target = high_p on the domain's experts, low_p elsewhere.

    ``experts`` maps every domain to its experts (default: the one of its own number); ``high_p``
    shares what ``low_p`` leaves among as many experts as the first domain has. ``batchmean`` per
    layer (sum over experts / valid tokens); layers without valid tokens or with a non-finite value
    are skipped; the sum is divided by the full layer count.
    """
    experts = experts or {d: [d] for d in range(n_domains)}
    share = len(experts[min(experts)])
    high_p = (1.0 - (n_experts - share) * low_p) / share
    valid = (F.col("domain_id") >= 0) & (F.col("domain_id") < n_domains)
    lp = A.log_softmax("logits")
    own = F.create_map(*[x for d, e in experts.items() for x in (F.lit(d), F.array(*map(F.lit, e)))])

    def kl_term(x, i):
        t = F.when(F.array_contains(own[F.col("domain_id")], i), F.lit(high_p)).otherwise(F.lit(low_p))
        return t * (F.log(t) - x)

    kl = A.array_sum(F.transform(lp, kl_term))
    per_layer = rl.where(valid).select("layer", kl.alias("kl")).groupBy("layer").agg(
        (F.sum("kl") / F.count(F.lit(1))).alias("layer_kl"))
    finite = ~F.isnan("layer_kl") & (F.abs("layer_kl") != float("inf"))
    return per_layer.agg((F.coalesce(F.sum(F.when(finite, F.col("layer_kl"))), F.lit(0.0)) /
                          F.lit(float(max(n_layers, 1)))).alias("kl_guidance_loss"),
                         F.count_if(finite).alias("n_layers_used"))


def token_routing(rl: DataFrame, layer: int, token: str = "token") -> DataFrame:
    """RTR10/SNK5: one row per real token: sentence, position, token text, expert."""
    from ferrule.functions import text as T

    x = with_expert(rl.where((F.col("layer") == layer) & (F.col("mask") == 1)))
    return x.select("block_id", F.col("pos").alias("token_index"),
                    T.clean_subword(F.col(token).cast("string")).alias("token"), "expert")


def dominant_expert(rl: DataFrame, layer: int) -> DataFrame:
    """RTR11: the most used expert per sentence (ties -> lowest index) and its share."""
    x = with_expert(rl.where((F.col("layer") == layer) & (F.col("mask") == 1)))
    c = x.groupBy("block_id", "expert").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("block_id").agg(
        F.max_by("expert", F.struct("n", (-F.col("expert")).alias("neg"))).alias("dominant_expert"),
        (F.lit(100.0) * F.max("n") / F.sum("n")).alias("share_pct"),
        F.sum("n").alias("n_tokens"))


# ------------------------------------------------------------------ losses --

def next_token_nll(rows: DataFrame, block: str = "block_id", pos: str = "pos", token: str = "token", mask: str = "mask",
                   logits: str = "logits", keep: tuple[str, ...] = ()) -> DataFrame:
    """JOIN5/LOS1: loss of each position's next token, ``-log_softmax(logits)[next token]``, where that token is real (mask 1).

    Positions are joined to the next one inside their block only, so a window holds one block.
    """
    w = Window.partitionBy(block).orderBy(pos)
    ahead = rows.select(block, pos, token, mask, *keep, logits, F.lead(token).over(w).alias("__token"), F.lead(mask).over(w).alias("__mask"))
    return ahead.where(F.col("__mask") == 1).select(block, pos, token, mask, *keep, A.nll_at(logits, F.col("__token")).alias("nll"))


def block_sums(token_nll: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per-block NLL sum and kept-token count (the unit a loader batches)."""
    return token_nll.groupBy("block_id", *extra).agg(F.sum("nll").alias("s"), F.count(F.lit(1)).alias("c"))


def batch_mean_loss(token_nll: DataFrame, batch_size: int, group: str | None = None) -> DataFrame:
    """LOS2/LOS3: mean of per-batch token means (batches of consecutive blocks in block order).

    A short last batch weighs as much as a full one; the token mean is given
    as a second column. Without any batch and group, both are 0. With ``group``, batches are formed inside each group.
    """
    part = (group,) if group else ()
    b = block_sums(token_nll, part)
    ranked = position(b, F.col("block_id"), partition_by=part)
    batched = ranked.withColumn("batch_id", F.floor((F.col("pos") - 1) / batch_size))
    per_batch = batched.groupBy(*part, "batch_id").agg((F.sum("s") / F.sum("c")).alias("m"),
                                                       F.sum("s").alias("s"), F.sum("c").alias("c"))
    return per_batch.groupBy(*part).agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("loss"),
                                        F.coalesce(F.sum("s") / F.sum("c"), F.lit(0.0)).alias("token_mean_loss"),
                                        F.count(F.lit(1)).alias("n_batches"))


def combine_scalars(named: dict[str, DataFrame]) -> DataFrame:
    """Put several one-row, one-value results side by side (tagged union + one aggregate)."""
    parts = [df.select(F.lit(k).alias("__k"), F.col(df.columns[0]).cast("double").alias("__v"))
             for k, df in named.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.agg(*[F.max(F.when(F.col("__k") == k, F.col("__v"))).alias(k) for k in named])


def before_after(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """JOIN3/MET8: rows of ``before`` with the ``after`` value, signed change and direction.

    A key missing on the ``after`` side is an error when the plan runs; a null value on either side
    gives a null change and a null direction.
    """
    b = before.select(key, F.col(value).alias("before"))
    a = after.select(key, F.col(value).alias("after"), F.lit(True).alias("__there"))
    j = b.join(a, key, "left")
    missing = F.concat(F.lit(f"no 'after' row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    j = j.withColumn("__ok", F.when(F.col("__there"), F.lit(True)).otherwise(F.raise_error(missing).cast("boolean"))).where("__ok")
    change = F.col("after") - F.col("before")
    return j.select(key, "before", "after", change.alias("change"),
                    F.when(change < 0, F.lit("good")).when(change >= 0, F.lit("bad")).alias("direction"))


def max_abs_diff(a: DataFrame, b: DataFrame, keys: list[str], col: str = "logits", tolerance: float | None = None) -> DataFrame:
    """JOIN10: parity of two tables: full outer join on the key, largest element difference, unmatched keys.

    With ``tolerance``, a larger difference or an unmatched key is an error when the plan runs.
    """
    j = a.select(*keys, F.col(col).alias("__a")).join(b.select(*keys, F.col(col).alias("__b")), keys, "full_outer")
    diff = F.array_max(F.zip_with("__a", "__b", lambda x, y: F.abs(x - y)))
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    out = j.agg(F.count_if(both).alias("n_compared"), F.count_if(~both).alias("n_unmatched"),
                F.max(F.when(both, diff)).alias("max_abs_diff"))
    if tolerance is None:
        return out
    off = (F.col("n_unmatched") > 0) | (F.coalesce("max_abs_diff", F.lit(0.0)) > F.lit(float(tolerance)))
    said = F.concat(F.lit("tables differ: largest difference "), F.coalesce(F.col("max_abs_diff").cast("string"), F.lit("none")),
                    F.lit(", unmatched keys "), F.col("n_unmatched").cast("string"))
    return out.withColumn("n_compared", F.when(off, F.raise_error(said).cast("long")).otherwise(F.col("n_compared")))
