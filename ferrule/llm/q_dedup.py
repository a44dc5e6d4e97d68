"""Queries of the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.llm import embedding_dedup, simhash
from ferrule.llm.catalog import register
from ferrule.llm.common import read


@register("op3_sorted_projection_dedup")
def op3_sorted_projection_dedup(spark, sf_dir):
    """Links and components of all embeddings at cosine 0.9."""
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), least=0.9)


@register("op5_simhash_dedup")
def op5_simhash_dedup(spark, sf_dir):
    """Fingerprints of all documents over 3-word shingles, linked at 3 bits or fewer."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
