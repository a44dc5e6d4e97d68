"""Instruction-data operators: formatting, length filters, chat flattening (PRJ*, FIL2-FIL4, JOIN6).

The tokenizer is pluggable (UDF1): the default is the whitespace tokenizer,
a pure column expression; a user tokenizer is any ``Column -> array`` callable
(for example ``ferrule.functions.udf.tokenizer_udf``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import text as T

Tokenizer = Callable[[Column], Column]


def whitespace_tokenizer(col: Column) -> Column:
    return T.tokens(col)


def prompt_token_length(src, tokenizer: Tokenizer = whitespace_tokenizer) -> Column:
    """STR_5: tokens in the inference prompt of a source string."""
    return F.size(tokenizer(T.format_prompt(src)))


def sft_token_length(src, tgt, eos: str = T.EOS_TOKEN, tokenizer: Tokenizer = whitespace_tokenizer) -> Column:
    """STR_5: tokens in prompt + completion (as one string)."""
    return F.size(tokenizer(F.concat(T.format_prompt(src), T.sft_completion(tgt, eos))))


def _check_limit(max_tokens: int | None) -> None:
    if max_tokens is not None and max_tokens <= 0:
        raise ValueError("max_tokens must be positive")


def filter_by_prompt_tokens(df: DataFrame, max_tokens: int | None, src: str = "src",
                            tokenizer: Tokenizer = whitespace_tokenizer) -> DataFrame:
    """FIL2: keep rows whose prompt fits; ``None`` keeps everything."""
    _check_limit(max_tokens)
    if max_tokens is None:
        return df
    return df.where(prompt_token_length(F.col(src), tokenizer) <= max_tokens)


def filter_by_sft_tokens(df: DataFrame, max_tokens: int | None, src: str = "src", tgt: str = "tgt",
                         eos: str = T.EOS_TOKEN, tokenizer: Tokenizer = whitespace_tokenizer) -> DataFrame:
    """FIL3: keep rows whose prompt + completion fits."""
    _check_limit(max_tokens)
    if max_tokens is None:
        return df
    return df.where(sft_token_length(F.col(src), F.col(tgt), eos, tokenizer) <= max_tokens)


def filter_report(df: DataFrame, prompt_max: int, sft_max: int, src: str = "src", tgt: str = "tgt",
                  eos: str = T.EOS_TOKEN) -> DataFrame:
    """FIL4: kept/original counts of both filters in one aggregation."""
    return df.agg(F.count(F.lit(1)).alias("n_total"),
                  F.count_if(prompt_token_length(F.col(src)) <= prompt_max).alias("n_kept_prompt"),
                  F.count_if(sft_token_length(F.col(src), F.col(tgt), eos) <= sft_max).alias("n_kept_sft"))


def require_rows(report: DataFrame, column: str) -> None:
    """FIL4 guard: raise when a filter kept nothing (one tiny action on a 1-row report)."""
    row = report.select(column).first()
    if row is None or not row[0]:
        raise ValueError(f"no rows left after filtering ({column} = 0)")


def format_sft(df: DataFrame, src: str = "src", tgt: str = "tgt", eos: str = T.EOS_TOKEN) -> DataFrame:
    """PRJ1/PRJ2/PRJ4: prompt/completion pair, source columns dropped."""
    return df.select(T.format_prompt(F.col(src)).alias("prompt"), T.sft_completion(F.col(tgt), eos).alias("completion"))


def consecutive_turn_pairs(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                           text: str = "text", first: str = "user", second: str = "assistant") -> DataFrame:
    """JOIN6: a ``first`` turn and the next ``second`` turn of a conversation (``lead``).

    The window is one conversation (a handful of turns), never a large group.
    """
    w = Window.partitionBy(key).orderBy(order)
    nxt = turns.select(key, order, role, text, F.lead(role).over(w).alias("__nr"), F.lead(text).over(w).alias("__nt"))
    return nxt.where((F.col(role) == first) & (F.col("__nr") == second)).select(
        key, order, F.col(text).alias("src"), F.col("__nt").alias("tgt"))


def gather_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """PRJ6: one nested row per conversation, ``input = array<struct<role, content>>`` in turn order."""
    t = F.array_sort(F.collect_list(F.struct(order, role, text)))
    return turns.groupBy(key).agg(t.alias("__t")).select(
        key, F.transform("__t", lambda x: F.struct(x[role].alias("role"), x[text].alias("content"))).alias("input"))


def flatten_chat(input_col: str = "input", scalar_col: str | None = None) -> Column:
    """PRJ5: join turn contents with newlines (missing content -> '', a null turn is skipped); a scalar input -> its text."""
    joined = F.array_join(F.transform(F.filter(F.col(input_col), lambda t: t.isNotNull()), lambda t: F.coalesce(t["content"], F.lit(""))), "\n")
    if scalar_col is None:
        return joined
    return F.when(F.col(input_col).isNotNull(), joined).otherwise(F.col(scalar_col).cast("string"))
