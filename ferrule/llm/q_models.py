"""Queries of the learned operators: quality, language, toxicity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.llm import fm_quality, langid, toxicity
from ferrule.llm.catalog import register
from ferrule.llm.common import crc_fold, read


@register("op2_fm_quality")
def op2_fm_quality(spark, sf_dir):
    """Quality score of every document; folds 0 and 2 of 3 are learned from."""
    docs = read(spark, sf_dir, "documents")
    machine = fm_quality.learn(docs, read(spark, sf_dir, "labels").where(crc_fold("doc_id", 3) != 1))
    return fm_quality.score(docs, machine).select(
        "doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op4_cross_parsing_langid")
def op4_cross_parsing_langid(spark, sf_dir):
    """Language of every document; folds 0, 1 and 3 of 4 are learned from."""
    docs = read(spark, sf_dir, "documents")
    model = langid.learn(docs.where(crc_fold("doc_id", 4) != 2))
    return langid.identify(docs, model).select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@register("op6_ordinal_toxicity")
def op6_ordinal_toxicity(spark, sf_dir):
    """Expected severity of every document; folds 0 and 2 of 3 are learned from."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read(spark, sf_dir, "labels").where(crc_fold("doc_id", 3) != 1))
    return toxicity.grade(docs, model).withColumn("held_out", crc_fold("doc_id", 3) == 1)
