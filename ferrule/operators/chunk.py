"""Document -> fixed-size blocks (GEN1-GEN7).

All chunkers are narrow (no shuffle): ``explode`` over block indices, then
``slice``. The explode comes first so the token column is a materialised
attribute when sliced - it is never re-evaluated per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions import text as T
from ferrule.operators.ordering import CUTS, position

PAD_DOMAIN_ID = -100


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def with_eos(tokens, eos=T.EOS_TOKEN) -> Column:
    """GEN1: append the end-of-sequence token."""
    return F.concat(_c(tokens), F.array(F.lit(eos)))


def pad_token(pad=None, eos=T.EOS_TOKEN):
    """GEN5: the pad token, falling back to EOS."""
    return eos if pad is None else pad


def _block_indices(n_blocks: Column) -> Column:
    # sequence(0, -1) is [0, -1], so guard the empty case.
    return F.when(n_blocks > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.array().cast("array<int>"))


def chunk_drop_tail(df: DataFrame, tokens: str, block_size: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """GEN2: non-overlapping full blocks per document; the tail (and short documents) dropped."""
    nb = (F.size(tokens) / F.lit(block_size)).cast("int")
    ex = df.select(*keep, tokens, F.explode(_block_indices(nb)).alias("block_index"))
    return ex.select(*keep, "block_index",
                     F.slice(tokens, F.col("block_index") * block_size + 1, block_size).alias("input_ids"),
                     F.array_repeat(F.lit(1), block_size).alias("attention_mask"))


def chunk_pad(df: DataFrame, tokens: str, domain_id: str, block_size: int, pad,
              keep: tuple[str, ...] = (), mask_domain_on_pad: bool = True) -> DataFrame:
    """GEN3/GEN4: short documents become one right-padded block, long ones full blocks.

    Pads get attention 0 and domain -100 (or the real domain with
    ``mask_domain_on_pad=False``, the notebook variant).
    """
    L = F.size(tokens)
    nb = F.when(L < block_size, F.lit(1)).otherwise((L / F.lit(block_size)).cast("int"))
    ex = df.select(*keep, tokens, domain_id, F.explode(_block_indices(nb)).alias("block_index"))
    Lx = F.size(tokens)
    n_real = F.least(Lx, F.lit(block_size))
    n_pad = F.greatest(F.lit(0), F.lit(block_size) - Lx)
    piece = F.slice(tokens, F.col("block_index") * block_size + 1, block_size)
    pad_dom = F.lit(PAD_DOMAIN_ID) if mask_domain_on_pad else F.col(domain_id)
    return ex.select(
        *keep, domain_id, "block_index",
        F.concat(piece, F.array_repeat(F.lit(pad), n_pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n_real), F.array_repeat(F.lit(0), n_pad)).alias("attention_mask"),
        F.concat(F.array_repeat(F.col(domain_id), n_real), F.array_repeat(pad_dom, n_pad)).alias("domain_ids"),
        n_real.cast("int").alias("n_real"))


def truncate(tokens, n: int, side: str = "right") -> Column:
    """GEN7: keep at most ``n`` tokens (``side='right'`` cuts the end, ``'left'`` the start)."""
    t = _c(tokens)
    if side == "right":
        return F.slice(t, 1, n)
    return F.when(F.size(t) > n, F.slice(t, -n, n)).otherwise(t)


def pack(df: DataFrame, key: str, tokens: str, block_size: int, drop_tail: bool = True,
         cuts: int = CUTS) -> DataFrame:
    """GEN6: concatenate all documents in key order and cut into fixed blocks.

    Each document's global token offset comes from ``position`` (running sums
    over ``cuts`` ranges of the key, which may be of any orderable type). A document then emits one slice per
    block it overlaps; ``groupBy(block_id)`` reassembles at most
    ``block_size`` tokens per block, ordered by offset. Output:
    ``block_id, input_ids, doc_ids`` (the document of every token).
    """
    L = F.size(tokens)
    ranked = position(df.select(key, tokens), F.col(key), weight=L, offset_col="off", cuts=cuts)
    first_b = F.floor(F.col("off") / block_size)
    last_b = F.floor((F.col("off") + F.size(tokens) - 1) / block_size)
    ex = ranked.where(F.size(tokens) > 0).select(
        key, tokens, "off", F.explode(F.sequence(first_b, last_b)).alias("block_id"))
    start = F.greatest(F.lit(0), F.col("block_id") * block_size - F.col("off"))
    stop = F.least(F.size(tokens), (F.col("block_id") + 1) * block_size - F.col("off"))
    pieces = ex.select("block_id", F.struct((F.col("off") + start).alias("o"),
                                            F.slice(tokens, start + 1, stop - start).alias("t"),
                                            F.col(key).alias("k")).alias("p"))
    grouped = pieces.groupBy("block_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    out = grouped.select(
        "block_id",
        F.flatten(F.transform("ps", lambda p: p["t"])).alias("input_ids"),
        F.flatten(F.transform("ps", lambda p: F.array_repeat(p["k"], F.size(p["t"])))).alias("doc_ids"))
    if drop_tail:
        out = out.where(F.size("input_ids") == block_size)
    return out
