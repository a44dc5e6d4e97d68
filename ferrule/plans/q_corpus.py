"""Corpus-track queries: sources, chunking, splits, order, batching, packing (SRC*, GEN*, ORD*, SET*, JOIN7/8)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ferrule.operators import chunk as C
from ferrule.operators import ordering as OR
from ferrule.plans import fixtures as FX
from ferrule.plans import oracle_sql as O
from ferrule.plans.catalog import register
from ferrule.sources.tables import load_corpus, load_task, read_table

BLOCK = 256
SPLIT_SEED = 100
VAL_FRACTION = 0.1
SAMPLE_PER_DOMAIN = 250
BATCH = 4
TOTAL_STEPS = 1500
PAD = "<eos>"   # whitespace tokenizer has no pad token: GEN5 falls back to EOS


def _md5(seed, *cols) -> str:
    return "md5(" + " || ':' || ".join([f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in cols]) + ")"


@register("q_corpus_scan", """
SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n_chars_text FROM documents""")
def q_corpus_scan(spark, sf_dir):
    """SRC2: key + text column of a corpus (other columns pruned at the scan)."""
    df = load_corpus(spark, sf_dir, "documents", "doc_id", "text")
    return df.select("doc_id", "text", F.length("text").cast("long").alias("n_chars_text"))


@register("q_task_filter", """
SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en'""")
def q_task_filter(spark, sf_dir):
    """FIL1/SRC1: keep one task (pushed into the Parquet scan as a filter)."""
    return load_task(spark, sf_dir, "documents", "lang", "en").select("doc_id", "source", "n_chars")


@register("q_head_n", """
SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT 100""")
def q_head_n(spark, sf_dir):
    """ORD1: first n rows in source (key) order."""
    return OR.head_n(read_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id", 100)


@register("q_tokenize_eos", O.with_(O.F5) + """
SELECT doc_id, domain, CAST(len(tokens) AS INTEGER) AS n_tokens, tokens[len(tokens)] AS last_token,
       md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM f5""")
def q_tokenize_eos(spark, sf_dir):
    """GEN1: whitespace tokens of each document plus EOS."""
    f5 = FX.domain_documents(spark, sf_dir)
    return f5.select("doc_id", "domain", F.size("tokens").alias("n_tokens"),
                     F.element_at("tokens", -1).alias("last_token"),
                     F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


_CHUNK_TAIL_SQL = O.with_(O.F5) + f"""
SELECT doc_id, CAST(bi AS INTEGER) AS block_index,
       array_to_string(tokens[bi * {BLOCK} + 1 : bi * {BLOCK} + {BLOCK}], ' ') AS block_text
FROM (SELECT doc_id, tokens, unnest(range(len(tokens) // {BLOCK})) AS bi FROM f5)"""


@register("q_chunk_drop_tail", _CHUNK_TAIL_SQL)
def q_chunk_drop_tail(spark, sf_dir):
    """GEN2: full 256-token blocks per document, tail dropped."""
    f5 = FX.domain_documents(spark, sf_dir)
    b = C.chunk_drop_tail(f5, "tokens", BLOCK, keep=("doc_id",))
    return b.select("doc_id", "block_index", F.array_join("input_ids", " ").alias("block_text"))


def _chunk_pad_sql(src: str = "f5") -> str:
    return f"""
SELECT doc_id, domain_id, CAST(bi AS INTEGER) AS block_index, CAST(least(len(tokens), {BLOCK}) AS INTEGER) AS n_real,
       CAST(greatest(0, {BLOCK} - len(tokens)) AS INTEGER) AS n_pad,
       array_to_string(list_concat(tokens[bi * {BLOCK} + 1 : bi * {BLOCK} + {BLOCK}],
           list_transform(range(greatest(0, {BLOCK} - len(tokens))), lambda x: '{PAD}')), ' ') AS block_text
FROM (SELECT doc_id, domain_id, tokens,
             unnest(CASE WHEN len(tokens) < {BLOCK} THEN [0] ELSE range(len(tokens) // {BLOCK}) END) AS bi
      FROM {src})"""


def _pad_out(b):
    return b.select("doc_id", "domain_id", "block_index", "n_real",
                    F.size(F.filter("domain_ids", lambda x: x == C.PAD_DOMAIN_ID)).alias("n_pad"),
                    F.array_join("input_ids", " ").alias("block_text"))


@register("q_chunk_pad", O.with_(O.F5) + _chunk_pad_sql())
def q_chunk_pad(spark, sf_dir):
    """GEN3: short documents -> one padded block (mask 0, domain -100); long -> full blocks."""
    f5 = FX.domain_documents(spark, sf_dir)
    return _pad_out(C.chunk_pad(f5, "tokens", "domain_id", BLOCK, PAD, keep=("doc_id",)))


@register("q_truncate", O.with_(O.F5) + """
SELECT doc_id, CAST(least(len(tokens), 128) AS INTEGER) AS n_kept,
       array_to_string(tokens[1:128], ' ') AS head_text,
       array_to_string(CASE WHEN len(tokens) > 128 THEN tokens[len(tokens) - 127 : len(tokens)] ELSE tokens END, ' ')
           AS tail_text FROM f5""")
def q_truncate(spark, sf_dir):
    """GEN7: length cap by truncation, keeping the start or the end."""
    f5 = FX.domain_documents(spark, sf_dir)
    return f5.select("doc_id", F.size(C.truncate("tokens", 128)).alias("n_kept"),
                     F.array_join(C.truncate("tokens", 128, "right"), " ").alias("head_text"),
                     F.array_join(C.truncate("tokens", 128, "left"), " ").alias("tail_text"))


@register("q_pack_concat", O.with_(O.F5, f"""
d AS (SELECT doc_id, tokens, coalesce(sum(len(tokens)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING
                                                            AND 1 PRECEDING), 0) AS off FROM f5),
t AS (SELECT doc_id, off, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM d)""") + f"""
SELECT CAST((off + i) // {BLOCK} AS BIGINT) AS block_id, CAST(count(*) AS INTEGER) AS n_tokens,
       min(doc_id) AS first_doc, max(doc_id) AS last_doc, CAST(count(DISTINCT doc_id) AS INTEGER) AS n_docs,
       md5(string_agg(token, ' ' ORDER BY off + i)) AS block_md5
FROM t GROUP BY 1 HAVING count(*) = {BLOCK}""")
def q_pack_concat(spark, sf_dir):
    """GEN6: concatenate-and-cut packing across documents (doc-id order)."""
    f5 = FX.domain_documents(spark, sf_dir)
    p = C.pack(f5, "doc_id", "tokens", BLOCK, drop_tail=True)
    return p.select(F.col("block_id").cast("long").alias("block_id"), F.size("input_ids").alias("n_tokens"),
                    F.array_min("doc_ids").alias("first_doc"), F.array_max("doc_ids").alias("last_doc"),
                    F.size(F.array_distinct("doc_ids")).alias("n_docs"),
                    F.md5(F.array_join("input_ids", " ")).alias("block_md5"))


@register("q_hash_split", O.with_(O.F5) + f"""
SELECT doc_id, CASE WHEN CAST(('0x' || substr({_md5(42, 'doc_id')}, 1, 8)) AS BIGINT) / 4294967296.0 < 0.2
                    THEN 'test' ELSE 'train' END AS split FROM f5""")
def q_hash_split(spark, sf_dir):
    """ORD2: seeded row-level train/test split by hash (no shuffle)."""
    return OR.hash_split(FX.domain_documents(spark, sf_dir).select("doc_id"), "doc_id", 0.2, seed=42)


_DOC_SPLIT = f"""
ranked AS (
  SELECT doc_id, domain, domain_id, tokens,
         row_number() OVER (PARTITION BY domain ORDER BY {_md5(SPLIT_SEED, 'domain', 'doc_id')}) AS rn,
         count(*) OVER (PARTITION BY domain) AS cnt FROM f5),
split AS (
  SELECT doc_id, domain, domain_id, tokens,
         CASE WHEN rn <= greatest(1, CAST(round_even(cnt * {VAL_FRACTION}, 0) AS BIGINT)) THEN 'val' ELSE 'train' END
             AS split FROM ranked)"""


def _split_docs(spark, sf_dir):
    f5 = FX.domain_documents(spark, sf_dir)
    return OR.document_split(f5, "domain", "doc_id", VAL_FRACTION, SPLIT_SEED)


@register("q_doc_split", O.with_(O.F5, _DOC_SPLIT) + "SELECT doc_id, domain, split FROM split")
def q_doc_split(spark, sf_dir):
    """ORD3: leak-free document split per domain (exact n_val, bucketed ranks)."""
    return _split_docs(spark, sf_dir).select("doc_id", "domain", "split")


@register("q_domain_sample", O.with_(O.F5) + f"""
SELECT doc_id, domain FROM (
  SELECT doc_id, domain, row_number() OVER (PARTITION BY domain ORDER BY {_md5(SPLIT_SEED, 'doc_id')}, doc_id) AS rn
  FROM f5) WHERE rn <= {SAMPLE_PER_DOMAIN}""")
def q_domain_sample(spark, sf_dir):
    """SRC3: seeded sample of max_samples documents per domain (WindowGroupLimit)."""
    f5 = FX.domain_documents(spark, sf_dir).select("doc_id", "domain")
    return OR.sample_per_group(f5, "domain", "doc_id", SAMPLE_PER_DOMAIN, seed=SPLIT_SEED)


@register("q_global_position", f"""
SELECT doc_id, row_number() OVER (ORDER BY {_md5(7, 'doc_id')}) AS pos FROM documents""")
def q_global_position(spark, sf_dir):
    """ORD4: global position in seeded order without a single-task window."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    return OR.hashed_position(docs, 7, ["doc_id"]).select("doc_id", F.col("pos").cast("long").alias("pos"))


_BLOCK_ORDER = f"""
blocks AS (SELECT doc_id, CAST(bi AS INTEGER) AS block_index FROM
           (SELECT doc_id, unnest(range(len(tokens) // {BLOCK})) AS bi FROM f5)),
bpos AS (SELECT doc_id, block_index, row_number() OVER (ORDER BY {_md5(3, 'doc_id', 'block_index')}) AS pos,
                count(*) OVER () AS total FROM blocks)"""


def _ordered_blocks(spark, sf_dir):
    f5 = FX.domain_documents(spark, sf_dir)
    b = C.chunk_drop_tail(f5, "tokens", BLOCK, keep=("doc_id",)).select("doc_id", "block_index")
    return OR.hashed_position(b, 3, ["doc_id", "block_index"], total_col="total")


@register("q_batches", O.with_(O.F5, _BLOCK_ORDER) + f"""
SELECT doc_id, block_index, CAST((pos - 1) // {BATCH} AS BIGINT) AS batch_id FROM bpos
WHERE pos <= (total // {BATCH}) * {BATCH}""")
def q_batches(spark, sf_dir):
    """ORD5: shuffled training batches of 4 blocks, last short batch dropped."""
    b = OR.batches(_ordered_blocks(spark, sf_dir), "pos", "total", BATCH, drop_last=True)
    return b.select("doc_id", "block_index", "batch_id")


@register("q_step_schedule", O.with_(O.F5, _BLOCK_ORDER) + f"""
SELECT CAST(s AS BIGINT) AS step, CAST((s - 1) % nb AS BIGINT) AS batch_id
FROM (SELECT unnest(range(1, {TOTAL_STEPS} + 1)) AS s),
     (SELECT max(total) // {BATCH} AS nb FROM bpos) WHERE nb > 0""")
def q_step_schedule(spark, sf_dir):
    """ORD6: step -> batch for an endlessly cycled loader (same first-pass order)."""
    b = OR.batches(_ordered_blocks(spark, sf_dir), "pos", "total", BATCH, drop_last=True)
    ids = b.groupBy("batch_id").agg(F.first((F.col("total") / BATCH).cast("long")).alias("n_batches"))
    return OR.step_schedule(ids, "n_batches", TOTAL_STEPS).select("step", "batch_id")


@register("q_interleave", O.with_(O.F5) + f"""
, r AS (SELECT doc_id, domain, row_number() OVER (PARTITION BY domain ORDER BY {_md5(SPLIT_SEED, 'doc_id')}) - 1 AS p,
             count(*) OVER (PARTITION BY domain) AS c FROM f5),
m AS (SELECT max(c) AS mx FROM r)
SELECT CAST(round AS BIGINT) AS round, domain, doc_id FROM
  (SELECT domain, doc_id, unnest(range(p, mx, c)) AS round FROM r, m)""")
def q_interleave(spark, sf_dir):
    """ORD7: equal-probability interleave until all domains are exhausted (round-robin)."""
    f5 = FX.domain_documents(spark, sf_dir).select("doc_id", "domain")
    return OR.interleave(f5, "domain", "doc_id", seed=SPLIT_SEED).select(
        F.col("round").cast("long").alias("round"), "domain", "doc_id")


@register("q_sample_k", O.with_(O.F5) + f"""
SELECT doc_id, domain FROM f5 ORDER BY {_md5(10, 'doc_id')} LIMIT 10""")
def q_sample_k(spark, sf_dir):
    """ORD8: seeded sample of k rows for inspection."""
    return OR.sample_k(FX.domain_documents(spark, sf_dir).select("doc_id", "domain"), "doc_id", 10, seed=10)


@register("q_domain_preview", f"""
SELECT domain, CAST(rn AS INTEGER) AS rank, doc_id, preview FROM (
  SELECT {O.domain_name("CAST(substr(source, 4) AS INTEGER) % 3")} AS domain, doc_id,
         substr(text, 1, 200) AS preview,
         row_number() OVER (PARTITION BY CAST(substr(source, 4) AS INTEGER) % 3
                            ORDER BY {_md5(SPLIT_SEED, 'doc_id')}) AS rn
  FROM documents) WHERE rn <= 2""")
def q_domain_preview(spark, sf_dir):
    """ORD9: top-2 documents per domain with a 200-character preview."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    did = (F.substring("source", 4, 1 << 20).cast("int") % 3).cast("int")
    d = docs.select("doc_id", FX.domain_name(did).alias("domain"),
                    F.substring("text", 1, 200).alias("preview"))
    w = Window.partitionBy("domain").orderBy(OR.seeded_hash(SPLIT_SEED, "doc_id"), F.col("doc_id"))
    ranked = d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 2)   # WindowGroupLimit
    return ranked.select("domain", "rank", "doc_id", "preview")


def _val_blocks(spark, sf_dir):
    sp = _split_docs(spark, sf_dir)
    return C.chunk_pad(sp, "tokens", "domain_id", BLOCK, PAD, keep=("doc_id", "domain", "split"))


@register("q_split_counts", O.with_(O.F5, _DOC_SPLIT) + f"""
, b AS (SELECT split, domain, doc_id,
        unnest(CASE WHEN len(tokens) < {BLOCK} THEN [0] ELSE range(len(tokens) // {BLOCK}) END) AS bi FROM split)
SELECT split, domain, count(*) AS n_blocks, count(DISTINCT doc_id) AS n_docs FROM b GROUP BY split, domain""")
def q_split_counts(spark, sf_dir):
    """RTR13: blocks and documents per split side and domain."""
    b = _val_blocks(spark, sf_dir)
    return b.groupBy("split", "domain").agg(F.count(F.lit(1)).alias("n_blocks"),
                                            F.count_distinct("doc_id").alias("n_docs"))


@register("q_split_leak_check", O.with_(O.F5, _DOC_SPLIT) + """
SELECT (SELECT count(*) FROM split WHERE split = 'train') AS n_train_docs,
       (SELECT count(*) FROM split WHERE split = 'val') AS n_val_docs,
       (SELECT count(*) FROM split t WHERE split = 'train'
          AND EXISTS (SELECT 1 FROM split v WHERE v.split = 'val' AND v.doc_id = t.doc_id)) AS n_leaked""")
def q_split_leak_check(spark, sf_dir):
    """JOIN7: no document contributes blocks to both sides (left_semi must be empty)."""
    b = _val_blocks(spark, sf_dir)
    sides = b.groupBy("doc_id").agg(F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "val").alias("v"))
    return sides.agg(F.count_if(F.col("t") > 0).alias("n_train_docs"), F.count_if(F.col("v") > 0).alias("n_val_docs"),
                     F.count_if((F.col("t") > 0) & (F.col("v") > 0)).alias("n_leaked"))


@register("q_heldout_docs", O.with_(O.F5, _DOC_SPLIT) + """
SELECT f5.doc_id, f5.domain FROM f5 WHERE NOT EXISTS (
  SELECT 1 FROM split s WHERE s.split = 'train' AND s.doc_id = f5.doc_id)""")
def q_heldout_docs(spark, sf_dir):
    """JOIN8: held-out documents = all documents minus the training side (left_anti)."""
    f5 = FX.domain_documents(spark, sf_dir).select("doc_id", "domain")
    train = _split_docs(spark, sf_dir).where(F.col("split") == "train").select("doc_id")
    return f5.join(train, "doc_id", "left_anti")


@register("q_domain_views", O.with_(O.F5, _DOC_SPLIT) + f"""
, b AS (SELECT doc_id, domain, domain_id, tokens,
        unnest(CASE WHEN len(tokens) < {BLOCK} THEN [0] ELSE range(len(tokens) // {BLOCK}) END) AS bi
        FROM split WHERE split = 'val')
SELECT domain AS view, doc_id, CAST(bi AS INTEGER) AS block_index,
       CAST(least(len(tokens), {BLOCK}) AS INTEGER) AS n_real FROM b""")
def q_domain_views(spark, sf_dir):
    """FIL5: one view per domain of the held-out blocks, chosen by the block's first domain id."""
    b = _val_blocks(spark, sf_dir).where(F.col("split") == "val")
    # the views are one table with the view's name as a column: one scan for all of them
    return b.select(FX.domain_name(F.element_at("domain_ids", 1)).alias("view"), "doc_id", "block_index", "n_real").where(F.col("view").isNotNull())


@register("q_union_domains", O.with_(O.F5) + f"""
SELECT domain, count(*) AS n_blocks,
       CAST(sum(least(len(tokens), {BLOCK})) AS BIGINT) AS n_real_tokens FROM
  (SELECT domain, tokens, unnest(CASE WHEN len(tokens) < {BLOCK} THEN [0] ELSE range(len(tokens) // {BLOCK}) END)
   FROM f5) GROUP BY domain""")
def q_union_domains(spark, sf_dir):
    """SET1: the blocks of all domains in one table, then an inventory per domain."""
    f5 = FX.domain_documents(spark, sf_dir)
    u = C.chunk_pad(f5, "tokens", "domain_id", BLOCK, PAD, keep=("domain",))     # the domain column stands for the union of tables
    return u.groupBy("domain").agg(F.count(F.lit(1)).alias("n_blocks"),
                                   F.sum("n_real").cast("long").alias("n_real_tokens"))


@register("q_domain_token_counts", O.with_(O.F5) + f"""
, b AS (SELECT domain_id, tokens,
        unnest(CASE WHEN len(tokens) < {BLOCK} THEN [0] ELSE range(len(tokens) // {BLOCK}) END) AS bi FROM f5),
c AS (SELECT domain_id, CAST(least(len(tokens), {BLOCK}) AS BIGINT) AS n FROM b
      UNION ALL SELECT -100, CAST(greatest(0, {BLOCK} - len(tokens)) AS BIGINT) FROM b)
SELECT domain_id, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY domain_id HAVING sum(n) > 0""")
def q_domain_token_counts(spark, sf_dir):
    """RTR12/SET3: token counts per domain id (pads as -100) over all padded blocks.

    Blocks are domain-pure, so each block contributes (domain, n_real) and
    (-100, n_pad) - two rows instead of exploding 256 tokens.
    """
    f5 = FX.domain_documents(spark, sf_dir)
    b = C.chunk_pad(f5, "tokens", "domain_id", BLOCK, PAD)
    parts = F.array(F.struct(F.col("domain_id").alias("d"), F.col("n_real").cast("long").alias("n")),
                    F.struct(F.lit(C.PAD_DOMAIN_ID).alias("d"), (F.lit(BLOCK) - F.col("n_real")).cast("long").alias("n")))
    ex = b.select(F.explode(parts).alias("x")).select(F.col("x.d").alias("domain_id"), F.col("x.n").alias("n"))
    return ex.groupBy("domain_id").agg(F.sum("n").cast("long").alias("n_tokens")).where(F.col("n_tokens") > 0)
