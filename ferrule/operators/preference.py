"""Preference-pair building (PRF1-PRF4, JOIN1, JOIN9).

Candidates arrive as a table keyed by ``pair_id`` (model output is an input
table, or comes from the ``mapInPandas`` hook in ``functions.udf``). Prompts
and candidates meet in an inner equi-join on the key; the edit distances are
computed once per pair on the joined rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions import text as T
from ferrule.functions.edit import edit_distance, edit_distances


def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JOIN1: rows of both sides by key; a key that only one side has is an error when the plan runs (T13).

    The reference's positional zip truncates silently; here nothing is dropped.
    """
    l, r = left.withColumn("__left", F.lit(True)), right.withColumn("__right", F.lit(True))
    both = F.col("__left").isNotNull() & F.col("__right").isNotNull()
    one = F.concat(F.lit(f"no partner for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    j = l.join(r, key, "full_outer").withColumn("__ok", F.when(both, F.lit(True)).otherwise(F.raise_error(one).cast("boolean")))
    return j.where("__ok").drop("__left", "__right", "__ok")


def preference_pairs(prompts: DataFrame, candidates: DataFrame, key: str = "pair_id",
                     prompt: str = "src", target: str = "reference", v1: str = "candidate",
                     v2: str = "candidate_2", keep_target: bool = False, raw_prompt: bool = False) -> DataFrame:
    """PRF1/PRF2: chosen = the variant closer to the target (edit distance); ties dropped.

    ``prompt`` is stored in inference format unless ``raw_prompt``; the
    notebook variant also keeps the ``target``.
    """
    j = matched(prompts.select(key, prompt, target), candidates.select(key, v1, v2), key)
    d = j.withColumn("__d", edit_distances(target, v1, v2)).select("*", F.col("__d")[0].alias("d1"), F.col("__d")[1].alias("d2"))
    kept = d.where(F.col("d1") != F.col("d2"))
    first = F.col("d1") < F.col("d2")
    cols = [F.col(key),
            (F.col(prompt) if raw_prompt else T.format_prompt(F.col(prompt))).alias("prompt"),
            F.when(first, F.col(v1)).otherwise(F.col(v2)).alias("chosen"),
            F.when(first, F.col(v2)).otherwise(F.col(v1)).alias("rejected")]
    if keep_target:
        cols.append(F.col(target).alias("target"))
    return kept.select(*cols)


def preference_stats(prompts: DataFrame, candidates: DataFrame, key: str = "pair_id",
                     target: str = "reference", v1: str = "candidate", v2: str = "candidate_2") -> DataFrame:
    """PRF3: pairs considered, ties dropped, pairs kept, and the distance sums."""
    j = matched(prompts.select(key, target), candidates.select(key, v1, v2), key)
    d = j.select(edit_distances(target, v1, v2).alias("__d")).select(F.col("__d")[0].alias("d1"), F.col("__d")[1].alias("d2"))
    return d.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("d1") == F.col("d2")).alias("n_ties"),
                 F.count_if(F.col("d1") != F.col("d2")).alias("n_kept"),
                 F.sum("d1").cast("long").alias("sum_d1"), F.sum("d2").cast("long").alias("sum_d2"))


def best_worst(long_candidates: DataFrame, targets: DataFrame, key: str = "pair_id", cand_id: str = "cand_id",
               text: str = "text", target: str = "reference") -> DataFrame:
    """PRF4: with k candidates per prompt, chosen = closest, rejected = farthest.

    Ties in distance go to the lowest candidate id; prompts whose candidates
    are all equally far are dropped. Groups are one prompt's k candidates.
    """
    j = matched(long_candidates.select(key, cand_id, text), targets.select(key, target), key)
    d = j.select(key, cand_id, text, edit_distance(text, target).alias("dist"))
    g = d.groupBy(key).agg(
        F.min_by(text, F.struct("dist", cand_id)).alias("chosen"),
        F.max_by(text, F.struct("dist", (-F.col(cand_id)).alias("neg"))).alias("rejected"),
        F.min("dist").alias("best_dist"), F.max("dist").alias("worst_dist"))
    return g.where(F.col("best_dist") != F.col("worst_dist"))


def side_by_side(outputs: DataFrame, models: list[str], key: str = "pair_id", model: str = "model",
                 output: str = "output") -> DataFrame:
    """JOIN9: one row per prompt, one column per model (pivot with a fixed value list)."""
    return outputs.groupBy(key).pivot(model, models).agg(F.first(output))
