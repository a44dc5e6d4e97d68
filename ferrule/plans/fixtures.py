"""Derived tables F1-F7 built from the given test tables.

Each fixture is a deterministic DataFrame expression over the Parquet inputs
(no random function), so the same rows can be produced by the SQL oracle.
Texts are used whole: no prefixes, no row caps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions import arrays as A
from ferrule.functions import text as T
from ferrule.operators import instruct as I
from ferrule.operators import router as R
from ferrule.sources.tables import read_table

# --- fixed values: domain dimension ------------------------------------------
DOMAINS = {"code": 0, "math": 1, "chat": 2}
PAD_DOMAIN_ID = -100
INSTRUCTION = "Fix this text: "
# -----------------------------------------------------------------------------

N_LAYERS = 21
N_EXPERTS = 3
BLOCK_POSITIONS = 16


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows over the session's shuffle partitions by key.

    The test tables are one file split each, and the queries tokenise and align whole texts; a table
    of many splits should be read without this.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def domain_dim(spark: SparkSession) -> DataFrame:
    """Three-row domain dimension ``(domain_id, domain)``; safe to broadcast."""
    return spark.createDataFrame([(v, k) for k, v in DOMAINS.items()], "domain_id int, domain string")


def domain_name(domain_id) -> F.Column:
    c = F.col(domain_id) if isinstance(domain_id, str) else domain_id
    expr = F.lit(None).cast("string")
    for name, did in reversed(list(DOMAINS.items())):
        expr = F.when(c == did, F.lit(name)).otherwise(expr)
    return expr


def correction_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pair_id, src, source, reference, candidate, candidate_2)`` from all documents.

    reference = all whitespace tokens of the folded text; the source reverses
    word i when (i + id) % 7 == 0, the candidate keeps only the errors with
    % 14 == 0 (half corrected), candidate_2 those with % 21 == 0.
    """
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    base = docs.select(F.col("doc_id").alias("pair_id"), T.tokens(T.fold_ascii("text")).alias("tok"))
    out = base.select(
        "pair_id",
        F.array_join("tok", " ").alias("reference"),
        F.array_join(T.reverse_words_where("tok", "pair_id", 7), " ").alias("source"),
        F.array_join(T.reverse_words_where("tok", "pair_id", 14), " ").alias("candidate"),
        F.array_join(T.reverse_words_where("tok", "pair_id", 21), " ").alias("candidate_2"),
    )
    return out.select("pair_id", F.concat(F.lit(INSTRUCTION), "source").alias("src"),
                      "source", "reference", "candidate", "candidate_2")


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a user turn and the next assistant turn, text folded to ASCII."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pairs = I.consecutive_turn_pairs(conv)
    return pairs.select("conv_id", "turn", T.fold_ascii("src").alias("src"), T.fold_ascii("tgt").alias("tgt"))


def router_logits(spark: SparkSession, sf_dir: str, after: bool = False,
                  layers: tuple[int, int] = (0, N_LAYERS - 1), with_label: bool = False) -> DataFrame:
    """``(layer, block_id, pos, domain_id, mask, logits array<double>)``.

    Layer l takes embedding elements 3l+1..3l+3; blocks are 16 consecutive
    vectors; pads sit at the end of a block (pos >= 16 - block_id % 4).
    The "after" version adds 1.0 to the logit of the domain's own expert.
    """
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    block = (F.col("vec_id") / BLOCK_POSITIONS).cast("long")
    pos = (F.col("vec_id") % BLOCK_POSITIONS).cast("int")
    real = pos < F.lit(BLOCK_POSITIONS) - (block % 4)
    base = emb.select(block.alias("block_id"), pos.alias("pos"),
                      F.when(real, (block % 3).cast("int")).otherwise(F.lit(PAD_DOMAIN_ID)).alias("domain_id"),
                      F.when(real, 1).otherwise(0).alias("mask"),
                      "embedding", (F.col("label") % 3).cast("int").alias("token"),
                      F.explode(F.sequence(F.lit(layers[0]), F.lit(layers[1]))).alias("layer"))
    logits = A.as_double_array(F.slice("embedding", F.col("layer") * 3 + 1, N_EXPERTS))
    if after:
        logits = A.add_at(logits, F.col("domain_id"), 1.0)
    cols = ["layer", "block_id", "pos", "domain_id", "mask", logits.alias("logits")]
    return base.select(*cols, "token") if with_label else base.select(*cols)


def token_nll(spark: SparkSession, sf_dir: str, after: bool = False) -> DataFrame:
    """next-token NLL from layer-0 logits with token = label % 3.

    ``nll[t] = -log_softmax(logits[t])[token[t+1]]`` inside a block; rows are
    kept where the next position is real (mask 1). ``lead`` runs in windows of
    one block (16 rows), never over a large group.
    """
    return R.next_token_nll(router_logits(spark, sf_dir, after, layers=(0, 0), with_label=True), keep=("domain_id",))


def domain_documents(spark: SparkSession, sf_dir: str, eos: str = T.EOS_TOKEN) -> DataFrame:
    """``(doc_id, domain, domain_id, tokens)``; domain from the source number % 3."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    did = (F.substring("source", 4, 1 << 20).cast("int") % 3).cast("int")
    return docs.select("doc_id", domain_name(did).alias("domain"), did.alias("domain_id"),
                       F.concat(T.tokens("text"), F.array(F.lit(eos))).alias("tokens"))


def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one nested row per conversation, turns sorted by ``turn``."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return I.gather_turns(conv)


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """an all-text metric log derived from ``events`` (blank = missing)."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    step = F.col("event_id") + 1
    dom = (F.when(F.col("user_id") % 2 == 0, F.lit(""))
           .otherwise(domain_name((F.col("user_id") % 3).cast("int"))))
    val = F.col("value").cast("string")
    return ev.select(
        F.col("event_id").alias("row_idx"),
        F.col("event_type").alias("phase"),
        step.cast("string").alias("step"),
        dom.alias("domain"),
        F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(val).alias("loss"),
        F.when(step % 10 == 0, val).otherwise(F.lit("")).alias("val_loss"),
        F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("note"),
    )
