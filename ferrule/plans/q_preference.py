"""Preference-track queries over the correction triples (PRF1-PRF4, JOIN1, JOIN9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.operators import preference as P
from ferrule.plans import fixtures as FX
from ferrule.plans import oracle_sql as O
from ferrule.plans.catalog import register

_DIST = O.distances("f1", {"d1": ("candidate", "reference"), "d2": ("candidate_2", "reference")}) + """,
d AS (SELECT pair_id, src, reference, candidate, candidate_2, d1, d2 FROM f1 JOIN dist USING (pair_id))"""


def _split_tables(spark, sf_dir):
    f1 = FX.correction_triples(spark, sf_dir)
    prompts = f1.select("pair_id", "src", "reference")
    cands = f1.select("pair_id", "candidate", "candidate_2")
    return prompts, cands


@register("q_preference_pairs", O.with_(O.F1, _DIST) + """
SELECT pair_id, src || chr(10) || 'Correction:' AS prompt,
       CASE WHEN d1 < d2 THEN candidate ELSE candidate_2 END AS chosen,
       CASE WHEN d1 < d2 THEN candidate_2 ELSE candidate END AS rejected
FROM d WHERE d1 <> d2""")
def q_preference_pairs(spark, sf_dir):
    """PRF1/JOIN1: prompts joined to two candidates; closer one chosen; ties dropped."""
    prompts, cands = _split_tables(spark, sf_dir)
    return P.preference_pairs(prompts, cands)


@register("q_preference_pairs_raw", O.with_(O.F1, _DIST) + """
SELECT pair_id, src AS prompt, reference AS target,
       CASE WHEN d1 < d2 THEN candidate ELSE candidate_2 END AS chosen,
       CASE WHEN d1 < d2 THEN candidate_2 ELSE candidate END AS rejected
FROM d WHERE d1 <> d2""")
def q_preference_pairs_raw(spark, sf_dir):
    """PRF2: notebook variant - raw prompt and the target kept."""
    prompts, cands = _split_tables(spark, sf_dir)
    return P.preference_pairs(prompts, cands, keep_target=True, raw_prompt=True)


@register("q_preference_stats", O.with_(O.F1, _DIST) + """
SELECT count(*) AS n_pairs, count(*) FILTER (WHERE d1 = d2) AS n_ties, count(*) FILTER (WHERE d1 <> d2) AS n_kept,
       CAST(sum(d1) AS BIGINT) AS sum_d1, CAST(sum(d2) AS BIGINT) AS sum_d2 FROM d""")
def q_preference_stats(spark, sf_dir):
    """PRF3: kept vs tied pair counts."""
    prompts, cands = _split_tables(spark, sf_dir)
    return P.preference_stats(prompts, cands)


_LONG = O.distances("f1", {"c1": ("candidate", "reference"), "c2": ("candidate_2", "reference"), "c3": ("source", "reference")}, "by_cand") + """,
ld AS (SELECT pair_id, 1 AS cand_id, candidate AS text, c1 AS dist FROM f1 JOIN by_cand USING (pair_id)
       UNION ALL SELECT pair_id, 2, candidate_2, c2 FROM f1 JOIN by_cand USING (pair_id)
       UNION ALL SELECT pair_id, 3, source, c3 FROM f1 JOIN by_cand USING (pair_id)),
lr AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY dist, cand_id) AS rb,
              row_number() OVER (PARTITION BY pair_id ORDER BY dist DESC, cand_id) AS rw FROM ld)"""


@register("q_preference_best_worst", O.with_(O.F1, _LONG) + """
SELECT b.pair_id, b.text AS chosen, w.text AS rejected, b.dist AS best_dist, w.dist AS worst_dist
FROM lr b JOIN lr w ON b.pair_id = w.pair_id AND b.rb = 1 AND w.rw = 1 WHERE b.dist <> w.dist""")
def q_preference_best_worst(spark, sf_dir):
    """PRF4: k = 3 candidates per prompt (two systems + the uncorrected source): best vs worst."""
    f1 = FX.correction_triples(spark, sf_dir)
    items = F.array(*[F.struct(F.lit(i).alias("cand_id"), F.col(c).alias("text"))
                      for i, c in ((1, "candidate"), (2, "candidate_2"), (3, "source"))])
    long = f1.select("pair_id", F.explode(items).alias("x")).select("pair_id", "x.cand_id", "x.text")
    out = P.best_worst(long, f1.select("pair_id", "reference"))
    return out.select("pair_id", "chosen", "rejected", F.col("best_dist").cast("long").alias("best_dist"),
                      F.col("worst_dist").cast("long").alias("worst_dist"))


@register("q_model_side_by_side", O.with_(O.F1) + """
SELECT pair_id, reference, candidate, candidate_2 AS candidate_2 FROM f1""")
def q_model_side_by_side(spark, sf_dir):
    """JOIN9: per prompt, one column per model output (groupBy + pivot over a fixed list)."""
    f1 = FX.correction_triples(spark, sf_dir)
    models = ["reference", "candidate", "candidate_2"]
    items = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("output")) for m in models])
    long = f1.select("pair_id", F.explode(items).alias("x")).select("pair_id", "x.model", "x.output")
    return P.side_by_side(long, models)


@register("q_candidates", O.with_(O.F1) + f"""
SELECT pair_id, {O.rev_words(O.tok('source'), 'pair_id', 3)} AS candidate FROM f1""")
def q_candidates(spark, sf_dir):
    """UDF2: candidate generation through the mapInPandas hook (deterministic stand-in model)."""
    from ferrule.functions import udf as U
    f1 = FX.correction_triples(spark, sf_dir)
    return U.generate_candidates(f1, U.corrupt_words, "pair_id", "source")
