"""Structured Streaming forms (STR1-STR3).

* STR1: tail a metric-log directory and keep the tumbling means current. State is one row per
  phase, domain and step window with the different steps seen, so lines read twice fill nothing.
  Windows are handed on when they are complete, and again if a later line changes them; readers
  take the last version of each.
* STR2: append micro-batches to a log. Rows go to ``query=<id>/batch=<number>``, and count once
  Spark's ``_SUCCESS`` marker is there: a batch tried again replaces only what it left unfinished,
  a committed one stays, and another query (a new checkpoint) writes beside the earlier rows.
* STR3: chunk documents as they arrive - the chunker is stateless per row, so the batch column
  expressions apply unchanged.

Checkpoints live under the session's ``spark.checkpoint.dir`` (a shared folder on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions import text as TX
from ferrule.operators import chunk as C
from ferrule.operators import metrics as M
from ferrule.sources.manifest import exists, file_system


def metric_stream(spark: SparkSession, directory: str, columns: list[str]) -> DataFrame:
    """All-text streaming read of a metric CSV directory (new files become micro-batches)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return (spark.readStream.schema(schema).option("header", True).option("emptyValue", "")
            .option("maxFilesPerTrigger", 64).csv(directory))


def tumbling_mean_stream(stream: DataFrame, value: str = "loss", every: int = 10, step: str = "step") -> DataFrame:
    """STR1: streaming MET1 - per phase, domain and step window: different steps seen, mean of parseable values."""
    s = TX.lenient_float(F.col(step))
    v = TX.lenient_float(F.col(value))
    return (stream.where(s.isNotNull()).groupBy(*M.window_keys(stream), F.ceil(s / F.lit(every)).cast("long").alias("window"))
            .agg(F.size(F.collect_set(s)).cast("long").alias("n_steps"), F.avg(v).alias("mean"), F.count(v).alias("n_values")))


def complete_windows(agg: DataFrame, every: int) -> DataFrame:
    return agg.where(F.col("n_steps") == every).select(
        *M.window_keys(agg), (F.col("window") * every).alias("window_end_step"), "mean", "n_values")


def run_available_now(df: DataFrame, sink, checkpoint: str, output_mode: str = "append"):
    """Process everything available, then stop (``Trigger.AvailableNow``); ``sink`` is a ``foreachBatch`` function."""
    q = df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return q


def _commit(batch: DataFrame, batch_id: int, path: str, write) -> None:
    """``write(target)`` unless this batch of this query is committed already."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
    target = f"{path}/query={query}/batch={batch_id}"
    if not exists(batch.sparkSession, f"{target}/_SUCCESS"):
        write(target)


def committed(spark: SparkSession, path: str) -> list[str]:
    """The folders of the committed batches below ``path`` (names only), in order."""
    p, fs = file_system(spark, f"{path}/query=*/batch=*/_SUCCESS")
    return sorted(str(s.getPath().getParent().toString()) for s in (fs.globStatus(p) or []))


def batch_appender(path: str, fieldnames: list[str]):
    """STR2: a ``foreachBatch`` sink that appends each micro-batch as CSV under a fixed header, once."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        cols = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in batch.columns
                else F.lit("").alias(f) for f in fieldnames]
        _commit(batch, batch_id, path, lambda target: batch.select(*cols).write.mode("overwrite").option("header", True)
                .option("emptyValue", "").csv(target))
    return sink


def read_appended(spark: SparkSession, path: str, fieldnames: list[str]) -> DataFrame:
    """The rows of all committed batches, all text; a batch that wasn't finished adds nothing."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fieldnames])
    folders = committed(spark, path)
    return spark.read.schema(schema).option("header", True).option("emptyValue", "").csv(folders) if folders else spark.createDataFrame([], schema)


def row_sink(path: str):
    """A ``foreachBatch`` sink that appends typed rows (Parquet) with the number of their batch, once."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        _commit(batch, batch_id, path, lambda target: batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(target))
    return sink


def read_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``row_sink`` committed, with ``batch_id``."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    folders = committed(spark, path)
    return spark.read.schema(full).parquet(*folders) if folders else spark.createDataFrame([], full)


def last_versions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows written in update mode by one query, the last of each key."""
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("last"))
    return last.select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def chunk_stream(stream: DataFrame, tokens: str, domain_id: str, block_size: int, pad,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """STR3: GEN3 applied to a stream of tokenised documents."""
    return C.chunk_pad(stream, tokens, domain_id, block_size, pad, keep=keep)
