"""Instruction-data queries over conversation turns (PRJ*, FIL2-FIL4, STR_1-STR_5, JOIN6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import text as T
from ferrule.operators import instruct as I
from ferrule.plans import fixtures as FX
from ferrule.plans import oracle_sql as O
from ferrule.plans.catalog import register

PROMPT_MAX = 64
SFT_MAX = 256
NL = "chr(10)"


def _prompt(src: str) -> str:
    return f"({src} || {NL} || 'Correction:')"


def _sft_text(src: str, tgt: str) -> str:
    return f"({_prompt(src)} || ' ' || {tgt} || '<eos>')"


@register("q_turn_pairs", O.with_(O.F2) + "SELECT conv_id, turn, src, tgt FROM f2")
def q_turn_pairs(spark, sf_dir):
    """JOIN6: user turn + next assistant turn as (src, tgt), folded text."""
    return FX.turn_pairs(spark, sf_dir)


@register("q_format_sft", O.with_(O.F2) + f"""
SELECT conv_id, turn, {_prompt('src')} AS prompt, ' ' || tgt || '<eos>' AS completion FROM f2""")
def q_format_sft(spark, sf_dir):
    """PRJ1/PRJ2: prompt = src + '\\nCorrection:'; completion = ' ' + tgt + EOS."""
    f2 = FX.turn_pairs(spark, sf_dir)
    return f2.select("conv_id", "turn", T.format_prompt("src").alias("prompt"),
                     T.sft_completion("tgt").alias("completion"))


@register("q_format_text", O.with_(O.F2) + """
SELECT conv_id, turn, src || ' ###>' || tgt AS text FROM f2""")
def q_format_text(spark, sf_dir):
    """PRJ3: single-text form with a configurable separator."""
    f2 = FX.turn_pairs(spark, sf_dir)
    return f2.select("conv_id", "turn", T.format_text("src", "tgt").alias("text"))


@register("q_token_lengths", O.with_(O.F2) + f"""
SELECT conv_id, turn, CAST(len({O.tok(_prompt('src'))}) AS INTEGER) AS prompt_tokens,
       CAST(len({O.tok(_sft_text('src', 'tgt'))}) AS INTEGER) AS sft_tokens FROM f2""")
def q_token_lengths(spark, sf_dir):
    """STR_5: prompt and prompt+completion token counts (whitespace tokenizer)."""
    f2 = FX.turn_pairs(spark, sf_dir)
    return f2.select("conv_id", "turn", I.prompt_token_length(F.col("src")).alias("prompt_tokens"),
                     I.sft_token_length(F.col("src"), F.col("tgt")).alias("sft_tokens"))


@register("q_filter_prompt_len", O.with_(O.F2) + f"""
SELECT conv_id, turn, src FROM f2 WHERE len({O.tok(_prompt('src'))}) <= {PROMPT_MAX}""")
def q_filter_prompt_len(spark, sf_dir):
    """FIL2: keep pairs whose prompt has at most 64 tokens."""
    return I.filter_by_prompt_tokens(FX.turn_pairs(spark, sf_dir), PROMPT_MAX).select("conv_id", "turn", "src")


@register("q_filter_sft_len", O.with_(O.F2) + f"""
SELECT conv_id, turn, src, tgt FROM f2 WHERE len({O.tok(_sft_text('src', 'tgt'))}) <= {SFT_MAX}""")
def q_filter_sft_len(spark, sf_dir):
    """FIL3: keep pairs whose prompt + completion has at most 256 tokens."""
    return I.filter_by_sft_tokens(FX.turn_pairs(spark, sf_dir), SFT_MAX).select("conv_id", "turn", "src", "tgt")


@register("q_filter_report", O.with_(O.F2) + f"""
SELECT count(*) AS n_total,
       count(*) FILTER (WHERE len({O.tok(_prompt('src'))}) <= {PROMPT_MAX}) AS n_kept_prompt,
       count(*) FILTER (WHERE len({O.tok(_sft_text('src', 'tgt'))}) <= {SFT_MAX}) AS n_kept_sft FROM f2""")
def q_filter_report(spark, sf_dir):
    """FIL4: original and kept counts of both filters."""
    return I.filter_report(FX.turn_pairs(spark, sf_dir), PROMPT_MAX, SFT_MAX)


@register("q_extract_completion", O.with_(O.F2) + f"""
SELECT conv_id, turn,
       {O.strip(f"string_split({_prompt('src')} || ' ' || tgt, 'Correction:')[-1]")} AS completion,
       {O.strip("string_split(src || ' ###>' || tgt, '###>')[-1]")} AS completion_text FROM f2""")
def q_extract_completion(spark, sf_dir):
    """STR_1/STR_3: the answer after the last marker of a decoded generation, stripped."""
    f2 = FX.turn_pairs(spark, sf_dir)
    decoded = F.concat(T.format_prompt("src"), F.lit(" "), F.col("tgt"))
    return f2.select("conv_id", "turn", T.extract_after_last(decoded).alias("completion"),
                     T.extract_after_last(T.format_text("src", "tgt"), T.TEXT_MARKER).alias("completion_text"))


@register("q_extract_source", O.with_(O.F1, O.F2) + f"""
SELECT 'pair' AS origin, pair_id AS id, {O.extract_source('src')} AS source_sentence FROM f1
UNION ALL
SELECT 'turn', conv_id * 100 + turn, {O.extract_source('src')} FROM f2""")
def q_extract_source(spark, sf_dir):
    """STR_2: sentence after the first ': ' (whole text if absent), stripped."""
    f1 = FX.correction_triples(spark, sf_dir).select(F.lit("pair").alias("origin"), F.col("pair_id").alias("id"),
                                                     T.extract_source_sentence("src").alias("source_sentence"))
    f2 = FX.turn_pairs(spark, sf_dir).select(F.lit("turn").alias("origin"),
                                             (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
                                             T.extract_source_sentence("src").alias("source_sentence"))
    return f1.unionByName(f2)


@register("q_chat_flatten", """
SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text, CAST(count(*) AS INTEGER) AS n_turns
FROM conversations GROUP BY conv_id""")
def q_chat_flatten(spark, sf_dir):
    """PRJ6 + PRJ5: gather turns per conversation, then join their contents with newlines."""
    rows = FX.chat_rows(spark, sf_dir)
    return rows.select("conv_id", I.flatten_chat("input").alias("text"), F.size("input").alias("n_turns"))
