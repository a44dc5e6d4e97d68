"""Corpus pipeline: toxicity, language, near-duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns
a DataFrame: the columns of ``documents`` for all stages but the last, which returns packed pieces.
Models are learned from the stage's own input and the labels beside it.
"""

from __future__ import annotations

import public_tokenizers

from ferrule.llm import langid, packing, secret_scan, simhash, toxicity
from ferrule.llm.common import crc_fold, materialise, read

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def reject_toxic(spark, docs, sf_dir):
    """Documents whose chance of any toxicity is 0.5 or more go."""
    model = toxicity.learn(docs, read(spark, sf_dir, "labels").where(crc_fold("doc_id", 3) != 1))
    return toxicity.reject_toxic(docs, model)


def keep_identified(spark, docs, sf_dir):
    """Documents without a letter that the labelled documents hold go; ``lang`` of the others is the language identified
    where it was null or clearly wrong. Without labels all stay as they are."""
    model = langid.learn(docs.where(crc_fold("doc_id", 4) != 2))
    return langid.keep_identified(docs, model, lang="lang")


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    return simhash.keep_first(docs, shingle=3, max_bits=3)


def redact_secrets(spark, docs, sf_dir):
    """The values of secrets are replaced; every document stays."""
    return secret_scan.redact_secrets(docs, length="n_chars")


def pack(spark, docs, sf_dir):
    """Token sequences of at most 2048 tokens, each of one identified language."""
    return packing.pack(docs, TOKENIZER, by="lang")


STAGES = [("toxicity", reject_toxic), ("language_id", keep_identified), ("simhash_dedup", drop_near_duplicates),
          ("secret_scan", redact_secrets), ("packing", pack)]

#: The models, fingerprints, lexer and tokenizer have no SQL form; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; every stage but the last is written to the shared folder before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
