"""CSV sinks (SNK1-SNK5).

Writers produce part files in a directory (one header per part file), which
the metric readers in ``sources.metrics_csv`` read back. Text formatting that
must match Python's (``True``/``False``, ``%.6g``) is done with column
expressions before writing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions import mathfn as M

PREDICTION_COLUMNS = ["raw_src", "source_sentence", "reference", "prediction", "prompt_token_length",
                      "length_bucket", "copied_source", "empty_prediction", "edit_distance_to_reference",
                      "edit_distance_to_source"]


def _write(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def append_metric_rows(df: DataFrame, path: str, fieldnames: list[str]) -> None:
    """SNK1: append rows with a fixed header; missing fields written blank, unknown ones dropped."""
    cols = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f)
            for f in fieldnames]
    _write(df.select(*cols), path, "append")


def write_predictions(pred_stats: DataFrame, path: str, parquet_path: str | None = None) -> None:
    """SNK2: the 10-column inspection CSV (booleans as ``True``/``False``); typed Parquet alongside."""
    if parquet_path:
        pred_stats.select(*PREDICTION_COLUMNS).write.mode("overwrite").parquet(parquet_path)
    out = pred_stats.select(*[
        F.initcap(F.col(c).cast("string")).alias(c) if c in ("copied_source", "empty_prediction")
        else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in PREDICTION_COLUMNS])
    _write(out, path, "overwrite")


def write_matrix(wide: DataFrame, path: str, label_col: str, value_cols: list[str],
                 column_labels: list[str] | None = None) -> None:
    """SNK3: labelled matrix, first column ``label``, values as ``%.6g``."""
    names = column_labels or value_cols
    out = wide.select(F.col(label_col).alias("label"),
                      *[M.format_g6(F.col(c)).alias(n) for c, n in zip(value_cols, names)])
    _write(out, path, "overwrite")


def write_domain_losses(before_after: DataFrame, path: str) -> None:
    """SNK4: ``domain, before, after, change`` with a signed change."""
    out = before_after.select("domain", M.format_g6("before").alias("before"), M.format_g6("after").alias("after"),
                              M.format_g6("change", signed=True).alias("change"))
    _write(out, path, "overwrite")


def write_token_routing(rows: DataFrame, path: str) -> None:
    """SNK5: flat ``domain, sentence, token_index, token, expert`` rows."""
    _write(rows.select("domain", "sentence", "token_index", "token", "expert"), path, "overwrite")
