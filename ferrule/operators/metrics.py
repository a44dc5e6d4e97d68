"""Metric-log analytics (MET1-MET8, STR_9, STR_10, ORD10).

A metric log is an all-text table (blank = missing). Metric columns are
unpivoted once into ``(row_idx, phase, domain, step, metric, raw)`` so every
later step is a grouped aggregate keyed by (metric, series) - no per-series
collect, and the number of groups is bounded by columns x series keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions import text as T

EXCLUDED = ("step", "phase", "domain")
# --- fixed values: chart geometry (pixels) ------------------------------------
WIDTH, HEIGHT = 900, 320
LEFT, RIGHT, TOP, BOTTOM = 58, 24, 34, 54
Y_PAD = 0.08
N_TICKS = 5
# -----------------------------------------------------------------------------
PLOT_W = WIDTH - LEFT - RIGHT
PLOT_H = HEIGHT - TOP - BOTTOM


def file_key(df: DataFrame) -> list[str]:
    """``["file"]`` for logs read from files, whose charts are kept apart; nothing for one log."""
    return ["file"] if "file" in df.columns else []


def candidate_metric_columns(df: DataFrame, exclude: tuple[str, ...] = EXCLUDED,
                             index_col: str = "row_idx") -> list[str]:
    return [c for c in df.columns if c not in exclude and c not in (index_col, "file")]


def unpivot_metrics(df: DataFrame, metrics: list[str], index_col: str = "row_idx") -> DataFrame:
    """One row per (log row, metric) with the raw text value."""
    keep = [c for c in ("file", index_col, "phase", "step", "domain") if c in df.columns]
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("raw")) for m in metrics])
    return df.select(*keep, F.explode(items).alias("__m")).select(*keep, "__m.metric", "__m.raw")


def typed(df: DataFrame, cols: list[str]) -> DataFrame:
    """STR_9: lenient float for the given text columns (blank/unparseable -> null)."""
    return df.select(*[T.lenient_float(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = EXCLUDED, index_col: str = "row_idx") -> DataFrame:
    """MET2: columns (besides step/phase/domain) with at least one parseable value."""
    cols = candidate_metric_columns(df, exclude, index_col)
    agg = df.agg(*[F.count(T.lenient_float(F.col(c))).alias(c) for c in cols])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_values")) for c in cols])
    return agg.select(F.explode(items).alias("x")).select("x.column", "x.n_values").where(F.col("n_values") > 0)


def series_points(df: DataFrame, metrics: list[str], index_col: str = "row_idx") -> DataFrame:
    """MET3: ``([file,] metric, series, x, y)``; x = step or the row index; null y skipped."""
    u = unpivot_metrics(df, metrics, index_col)
    y = T.lenient_float(F.col("raw"))
    x = F.coalesce(T.lenient_float(F.col("step")) if "step" in df.columns else F.lit(None).cast("double"),
                   F.col(index_col).cast("double"))
    phase = F.col("phase") if "phase" in df.columns else F.lit("")
    domain = F.col("domain") if "domain" in df.columns else F.lit("")
    return u.select(*file_key(u), "metric", T.series_key(phase, domain).alias("series"), x.alias("x"), y.alias("y")) \
        .where(F.col("y").isNotNull())


def series_summary(points: DataFrame) -> DataFrame:
    """MET3/MET7/ORD10: per ([file,] metric, series): point count, x range, first/last y in (x, y) order."""
    return points.groupBy(*file_key(points), "metric", "series").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("x").alias("min_x"), F.max("x").alias("max_x"),
        F.min_by("y", F.struct("x", "y")).alias("first_y"), F.max_by("y", F.struct("x", "y")).alias("last_y"),
        F.sum("y").alias("sum_y"))


def sorted_points(points: DataFrame) -> DataFrame:
    """ORD10 for plotting: points sorted by ([file,] metric, series, x, y) - a distributed range sort."""
    return points.orderBy(*file_key(points), "metric", "series", "x", "y")


def axis_range(points: DataFrame) -> DataFrame:
    """MET4: per [file and] metric, x/y range over all series; equal ends widened by 1; y padded by 8 %."""
    by = [*file_key(points), "metric"]
    r = points.groupBy(*by).agg(F.min("x").alias("x0"), F.max("x").alias("x1"),
                                     F.min("y").alias("y0"), F.max("y").alias("y1"))
    same_x = F.col("x0") == F.col("x1")
    same_y = F.col("y0") == F.col("y1")
    r = r.select(*by,
                 F.when(same_x, F.col("x0") - 1).otherwise(F.col("x0")).alias("min_x"),
                 F.when(same_x, F.col("x1") + 1).otherwise(F.col("x1")).alias("max_x"),
                 F.when(same_y, F.col("y0") - 1).otherwise(F.col("y0")).alias("y0"),
                 F.when(same_y, F.col("y1") + 1).otherwise(F.col("y1")).alias("y1"))
    pad = (F.col("y1") - F.col("y0")) * Y_PAD
    return r.select(*by, "min_x", "max_x", (F.col("y0") - pad).alias("min_y"), (F.col("y1") + pad).alias("max_y"))


def axis_ticks(ranges: DataFrame) -> DataFrame:
    """MET5: five evenly spaced ticks per axis with their pixel positions."""
    t = ranges.select("*", F.explode(F.sequence(F.lit(0), F.lit(N_TICKS - 1))).alias("tick"))
    frac = F.col("tick") / F.lit(float(N_TICKS - 1))
    return t.select(*file_key(t), "metric", "tick",
                    (F.lit(float(TOP)) + frac * PLOT_H).alias("y_px"),
                    (F.col("max_y") - frac * (F.col("max_y") - F.col("min_y"))).alias("y_value"),
                    (F.lit(float(LEFT)) + frac * PLOT_W).alias("x_px"),
                    (F.col("min_x") + frac * (F.col("max_x") - F.col("min_x"))).alias("x_value"))


def plot_points(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """MET6: pixel coordinates of every point.

    ``ranges`` has one row per [file and] metric; the join side is left to AQE.
    """
    j = points.join(ranges, [*file_key(points), "metric"])
    sx = F.lit(float(LEFT)) + (F.col("x") - F.col("min_x")) / (F.col("max_x") - F.col("min_x")) * PLOT_W
    sy = F.lit(float(TOP)) + (F.col("max_y") - F.col("y")) / (F.col("max_y") - F.col("min_y")) * PLOT_H
    return j.select(*file_key(points), "metric", "series", "x", "y", sx.alias("sx"), sy.alias("sy"))


def window_keys(df: DataFrame) -> list[str]:
    """The columns besides the step that tell the lines of a log apart."""
    return [c for c in ("phase", "domain") if c in df.columns]


def tumbling_mean(df: DataFrame, value: str, every: int, step: str = "step") -> DataFrame:
    """MET1: mean of ``value`` over consecutive windows of ``every`` steps, for each phase and domain.

    A window counts when it holds ``every`` different steps of its phase and domain.

    (A true mean over the window's parseable values - the reference's running
    sum divided by ``every`` after a resume is deliberately not reproduced.)
    """
    s = T.lenient_float(F.col(step))
    w = F.ceil(s / F.lit(every)).cast("long")
    by = window_keys(df)
    g = df.where(s.isNotNull()).groupBy(*by, w.alias("window")).agg(
        F.count_distinct(s).alias("n_steps"), F.avg(T.lenient_float(F.col(value))).alias("mean"),
        F.count(T.lenient_float(F.col(value))).alias("n_values"))
    return g.where(F.col("n_steps") == every).select(
        *by, (F.col("window") * every).alias("window_end_step"), "mean", "n_values")
