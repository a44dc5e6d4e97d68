"""Queries that write, read back and stream: metric logs, guarded datasets, CSV sinks, hooks, streams.

Each writes rows derived from the given tables to a new folder below the session's shared checkpoint
folder, and returns what the library reads back.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ferrule.functions import arrays as A
from ferrule.functions import text as T
from ferrule.functions import udf as U
from ferrule.operators import chunk as C
from ferrule.operators import metrics as MT
from ferrule.operators import router as R
from ferrule.plans import fixtures as FX
from ferrule.plans import oracle_sql as O
from ferrule.plans.catalog import ORACLE, register
from ferrule.plans.q_corpus import BLOCK, PAD
from ferrule.plans.q_metrics import LOG_EVERY, lenient
from ferrule.plans.q_router import LAYER
from ferrule.session import checkpoint_dir
from ferrule.sinks import csv as SK
from ferrule.sources import manifest as MF
from ferrule.sources import metrics_csv as MC
from ferrule.sources.tables import read_table
from ferrule.streaming import streams as ST

LOG = ["phase", "step", "domain", "loss", "val_loss", "note"]
_NUMBERS = f"{lenient('step')} AS step, {lenient('loss')} AS loss, {lenient('val_loss')} AS val_loss"


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/ferrule-io/{name}-{uuid.uuid4().hex}"


def _typed(log):
    return MT.typed(log, ["step", "loss", "val_loss"])


@register("q_metrics_read", O.with_(O.F7) + f"SELECT phase, domain, note, {_NUMBERS} FROM f7")
def q_metrics_read(spark, sf_dir):
    """SNK1/SRC4: a metric log appended as CSV under one header in two goes, read back as text and typed."""
    path, log = _folder(spark, "log"), FX.metric_rows(spark, sf_dir)
    SK.append_metric_rows(log.where("row_idx % 2 = 0"), path, LOG)
    SK.append_metric_rows(log.where("row_idx % 2 = 1"), path, LOG)
    return _typed(MC.read_metric_csv(spark, path)).select("phase", "domain", "note", "step", "loss", "val_loss")


@register("q_metric_logs_union", O.with_(O.F7) + f"""
SELECT phase, NULL::VARCHAR AS note, {lenient('step')} AS step, {lenient('loss')} AS loss, NULL::DOUBLE AS val_loss FROM f7
UNION ALL SELECT NULL, note, {lenient('step')}, NULL, {lenient('val_loss')} FROM f7 WHERE row_idx % 3 = 0""")
def q_metric_logs_union(spark, sf_dir):
    """SRC5/SET2: logs with different headers below one glob, in one table; a column that a log lacks is null."""
    path, log = _folder(spark, "logs"), FX.metric_rows(spark, sf_dir)
    SK.append_metric_rows(log, f"{path}/a", ["phase", "step", "loss"])
    SK.append_metric_rows(log.where("row_idx % 3 = 0"), f"{path}/b", ["note", "step", "val_loss"])
    return _typed(MC.read_metric_logs(spark, f"{path}/*/part-*.csv")).select("phase", "note", "step", "loss", "val_loss")


@register("q_manifest_reuse", O.with_(O.F5) + "SELECT doc_id, domain, domain_id, len(tokens) AS n_tokens FROM f5")
def q_manifest_reuse(spark, sf_dir):
    """SRC7/SNK6: a dataset saved by domain under a manifest, then taken from there; another manifest is refused."""
    path, manifest = _folder(spark, "dataset"), {"table": "documents", "eos": T.EOS_TOKEN}

    def build():
        return FX.domain_documents(spark, sf_dir).select("doc_id", "domain", "domain_id", F.size("tokens").cast("long").alias("n_tokens"))

    def never():
        raise AssertionError("a saved dataset with this manifest is there")

    MF.load_or_build(spark, path, manifest, build, partition_by=("domain",))
    try:
        MF.load_or_build(spark, path, {**manifest, "eos": ""}, never)
    except ValueError:
        return MF.load_or_build(spark, path, manifest, never).select("doc_id", "domain", "domain_id", "n_tokens")
    raise AssertionError("a dataset was re-used under another manifest")


@register("q_published_version", O.with_(O.F5) + "SELECT domain, count(*) AS n_docs, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens FROM f5 GROUP BY domain")
def q_published_version(spark, sf_dir):
    """SNK7: two published versions of a table of domain sizes; readers get the second."""
    base = _folder(spark, "published")
    docs = FX.domain_documents(spark, sf_dir)
    MF.publish_version(docs.select("domain").distinct(), base, "1", {"of": "domains"})
    sizes = docs.groupBy("domain").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("tokens")).cast("long").alias("n_tokens"))
    MF.publish_version(sizes, base, "2", {"of": "domain sizes"})
    return MF.read_published(spark, base)


@register("q_manifest_json", O.with_(O.F5) + """
SELECT '{"domain":"' || domain || '","n_docs":' || count(*) || '}' AS manifest FROM f5 GROUP BY domain""")
def q_manifest_json(spark, sf_dir):
    """JSON_1: one manifest row a domain as JSON text with sorted keys."""
    return MF.manifest_json(FX.domain_documents(spark, sf_dir).groupBy("domain").agg(F.count(F.lit(1)).alias("n_docs")), ["n_docs", "domain"])


@register("q_matrix_csv", f"""
SELECT domain AS label, {", ".join(f"CAST(printf('%.6g', expert_{e}) AS DOUBLE) AS expert_{e}" for e in range(FX.N_EXPERTS))}
FROM ({ORACLE["q_routing_matrix"]})""")
def q_matrix_csv(spark, sf_dir):
    """SNK3: the routing matrix written as CSV with six significant digits, read back."""
    path, names = _folder(spark, "matrix"), [f"expert_{e}" for e in range(FX.N_EXPERTS)]
    logits = FX.router_logits(spark, sf_dir, layers=(LAYER, LAYER))
    wide = R.routing_matrix(logits, LAYER, FX.domain_dim(spark), FX.N_EXPERTS).select("domain", *[F.round(n, 6).alias(n) for n in names])
    SK.write_matrix(wide, path, "domain", names)
    back = MC.read_metric_csv(spark, path, ["label", *names])
    return back.select("label", *[F.col(n).cast("double").alias(n) for n in names])


@register("q_matrix_rows", """
SELECT vec_id, CAST(2 AS INTEGER) AS n_rows, round(list_sum(list_transform(embedding[1:3], lambda x: x::DOUBLE)), 6) AS first_sum,
       round(list_sum(list_transform(embedding[4:6], lambda x: x::DOUBLE)), 6) AS second_sum FROM embeddings""")
def q_matrix_rows(spark, sf_dir):
    """ARR_3: nested arrays as rows of doubles."""
    emb = read_table(spark, sf_dir, "embeddings")
    rows = emb.select("vec_id", A.as_matrix(F.array(F.slice("embedding", 1, 3), F.slice("embedding", 4, 3))).alias("m"))
    return rows.select("vec_id", F.size("m").alias("n_rows"), *[F.round(A.array_sum(F.col("m")[i]), 6).alias(n) for i, n in enumerate(("first_sum", "second_sum"))])


@register("q_chunk_pad_notebook", O.with_(O.F5) + f"""
SELECT doc_id, CAST(bi AS INTEGER) AS block_index, CAST(least(len(tokens), {BLOCK}) AS INTEGER) AS n_real, CAST({BLOCK} AS INTEGER) AS n_own_domain,
       md5(array_to_string(list_concat(tokens[bi * {BLOCK} + 1 : bi * {BLOCK} + {BLOCK}],
           list_transform(range(greatest(0, {BLOCK} - len(tokens))), lambda x: '<eos>')), ' ')) AS block_md5
FROM (SELECT doc_id, tokens, unnest(CASE WHEN len(tokens) < {BLOCK} THEN [0] ELSE range(len(tokens) // {BLOCK}) END) AS bi FROM f5)""")
def q_chunk_pad_notebook(spark, sf_dir):
    """GEN4/GEN5: padded blocks whose pads carry the real domain, and EOS as the pad where none is set."""
    blocks = C.chunk_pad(FX.domain_documents(spark, sf_dir), "tokens", "domain_id", BLOCK, C.pad_token(None), keep=("doc_id",), mask_domain_on_pad=False)
    return blocks.select("doc_id", "block_index", "n_real", F.size(F.filter("domain_ids", lambda d: d == F.col("domain_id"))).alias("n_own_domain"),
                         F.md5(F.array_join("input_ids", " ")).alias("block_md5"))


@register("q_tokenizer_udf", """
SELECT conv_id, turn, len(c) AS n_tokens, CAST(coalesce(list_sum(list_transform(c, lambda x: unicode(x))), 0) AS BIGINT) AS id_sum
FROM (SELECT conv_id, turn, regexp_extract_all(text, '(?s).') AS c FROM conversations WHERE text IS NOT NULL)""")
def q_tokenizer_udf(spark, sf_dir):
    """UDF1: a user's tokenizer (code points) over every turn."""
    def code_points():
        return lambda text: [ord(c) for c in text]

    turns = read_table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    ids = turns.select("conv_id", "turn", U.tokenizer_udf(code_points)("text").alias("ids"))
    return ids.select("conv_id", "turn", F.size("ids").cast("long").alias("n_tokens"),
                      F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("id_sum"))


@register("q_map_batches", """
SELECT doc_id, length(text) - length(replace(text, ' ', '')) AS n_blanks FROM documents WHERE text IS NOT NULL""")
def q_map_batches(spark, sf_dir):
    """UDF3: a user's batch mapper over every document."""
    def blanks(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": batch["doc_id"], "n_blanks": batch["text"].str.count(" ").astype("int64")})

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL")
    return U.map_batches(docs, blanks, "doc_id long, n_blanks long")


_READ_TWICE = "row_idx % 4 = 0"


@register("q_stream_means", O.with_(O.F7, f"""
lines AS (SELECT step, loss, 'train' AS phase FROM f7 UNION ALL SELECT step, loss, 'train' FROM f7 WHERE {_READ_TWICE}""" + ")") + f"""
SELECT phase, CAST(w * {LOG_EVERY} AS BIGINT) AS window_end_step, round(avg({lenient('loss')}), 6) AS mean, count({lenient('loss')}) AS n_values
FROM (SELECT *, CAST(ceil({lenient('step')} / {LOG_EVERY}) AS BIGINT) AS w FROM lines WHERE {lenient('step')} IS NOT NULL)
GROUP BY phase, w HAVING count(DISTINCT step) = {LOG_EVERY}""")
def q_stream_means(spark, sf_dir):
    """STR1: tumbling means of a log that grows between two runs of one stream, with lines that come twice."""
    source, out, state = (_folder(spark, n) for n in ("tail", "means", "state"))
    log = FX.metric_rows(spark, sf_dir).select(F.lit("train").alias("phase"), "step", "loss", "row_idx")
    for lines in (log.where("row_idx % 3 <> 1"), log.where("row_idx % 3 = 1").unionByName(log.where(_READ_TWICE))):
        SK.append_metric_rows(lines, source, ["phase", "step", "loss"])
        means = ST.complete_windows(ST.tumbling_mean_stream(ST.metric_stream(spark, source, ["phase", "step", "loss"]), "loss", LOG_EVERY), LOG_EVERY)
        ST.run_available_now(means, ST.row_sink(out), state, output_mode="update")
    last = ST.last_versions(ST.read_rows(spark, out, means.schema), ["phase", "window_end_step"])
    return last.select("phase", "window_end_step", F.round("mean", 6).alias("mean"), "n_values")


@register("q_stream_append", O.with_(O.F7) + f"""
SELECT phase, {lenient('step')} AS step, {lenient('loss')} AS loss FROM f7
UNION ALL SELECT phase, {lenient('step')}, {lenient('loss')} FROM f7""")
def q_stream_append(spark, sf_dir):
    """STR2: two streams with checkpoints of their own append the same log to one path; both copies stay."""
    source, out, fields = _folder(spark, "source"), _folder(spark, "appended"), ["phase", "step", "loss"]
    SK.append_metric_rows(FX.metric_rows(spark, sf_dir), source, fields)
    for _ in range(2):
        ST.run_available_now(ST.metric_stream(spark, source, fields), ST.batch_appender(out, fields), _folder(spark, "state"))
    return MT.typed(ST.read_appended(spark, out, fields), ["step", "loss"]).select("phase", "step", "loss")


@register("q_stream_chunks", f"""SELECT doc_id, block_index, n_real, md5(block_text) AS block_md5 FROM ({ORACLE["q_chunk_pad"]})""")
def q_stream_chunks(spark, sf_dir):
    """STR3: documents chunked as they arrive."""
    source, out = _folder(spark, "documents"), _folder(spark, "blocks")
    FX.domain_documents(spark, sf_dir).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    blocks = ST.chunk_stream(stream, "tokens", "domain_id", BLOCK, PAD, keep=("doc_id",))
    blocks = blocks.select("doc_id", "block_index", "n_real", F.md5(F.array_join("input_ids", " ")).alias("block_md5"))
    ST.run_available_now(blocks, ST.row_sink(out), _folder(spark, "state"))
    return ST.read_rows(spark, out, blocks.schema).drop("batch_id")
