"""Metric-log queries over F7 (MET1-MET8, STR_9, STR_10, MTH_2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import mathfn as M
from ferrule.operators import metrics as MT
from ferrule.plans import fixtures as FX
from ferrule.plans import oracle_sql as O
from ferrule.plans.catalog import register
from ferrule.sources.tables import read_table

METRICS = ["loss", "val_loss", "note"]
LOG_EVERY = 10
_FLOAT_RE = r"^[\t\n\x0b\f\r \x1c-\x1f]*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[nN][aA][nN]|[iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY])[\t\n\x0b\f\r \x1c-\x1f]*$"


def lenient(expr: str) -> str:
    return f"CASE WHEN regexp_matches({expr}, '{_FLOAT_RE}') THEN TRY_CAST(trim({expr}) AS DOUBLE) END"


def _series_key(phase: str, domain: str) -> str:
    return f"coalesce(nullif(concat_ws(' / ', nullif({phase}, ''), nullif({domain}, '')), ''), 'run')"


_POINTS = f"""
, u AS (SELECT row_idx, phase, step, domain, 'loss' AS metric, loss AS raw FROM f7
        UNION ALL SELECT row_idx, phase, step, domain, 'val_loss', val_loss FROM f7
        UNION ALL SELECT row_idx, phase, step, domain, 'note', note FROM f7),
pts AS (SELECT metric, {_series_key('phase', 'domain')} AS series,
               coalesce({lenient('step')}, CAST(row_idx AS DOUBLE)) AS x, {lenient('raw')} AS y
        FROM u WHERE {lenient('raw')} IS NOT NULL)"""

_RANGE = f"""
, r0 AS (SELECT metric, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts GROUP BY metric),
r1 AS (SELECT metric, CASE WHEN x0 = x1 THEN x0 - 1 ELSE x0 END AS min_x, CASE WHEN x0 = x1 THEN x1 + 1 ELSE x1 END AS max_x,
              CASE WHEN y0 = y1 THEN y0 - 1 ELSE y0 END AS y0, CASE WHEN y0 = y1 THEN y1 + 1 ELSE y1 END AS y1 FROM r0),
rng AS (SELECT metric, min_x, max_x, y0 - (y1 - y0) * 0.08 AS min_y, y1 + (y1 - y0) * 0.08 AS max_y FROM r1)"""


def _points(spark, sf_dir):
    return MT.series_points(FX.metric_rows(spark, sf_dir), METRICS)


@register("q_metrics_typed", O.with_(O.F7) + f"""
SELECT row_idx, {lenient('step')} AS step, {lenient('loss')} AS loss, {lenient('val_loss')} AS val_loss,
       {lenient('note')} AS note FROM f7""")
def q_metrics_typed(spark, sf_dir):
    """STR_9/SRC4: all-text metric rows read back with lenient floats (blank/bad -> null)."""
    t = MT.typed(FX.metric_rows(spark, sf_dir), ["step", "loss", "val_loss", "note"])
    return t.select("row_idx", "step", "loss", "val_loss", "note")


@register("q_numeric_columns", O.with_(O.F7) + f"""
SELECT * FROM (SELECT 'loss' AS column, count({lenient('loss')}) AS n_values FROM f7
               UNION ALL SELECT 'val_loss', count({lenient('val_loss')}) FROM f7
               UNION ALL SELECT 'note', count({lenient('note')}) FROM f7) WHERE n_values > 0""")
def q_numeric_columns(spark, sf_dir):
    """MET2: metric columns with at least one parseable value (step/phase/domain excluded)."""
    return MT.numeric_columns(FX.metric_rows(spark, sf_dir))


@register("q_metric_series", O.with_(O.F7) + _POINTS + """
SELECT metric, series, count(*) AS n_points, min(x) AS min_x, max(x) AS max_x,
       round(arg_min(y, (x, y)), 6) AS first_y, round(arg_max(y, (x, y)), 6) AS last_y, round(sum(y), 6) AS sum_y
FROM pts GROUP BY metric, series""")
def q_metric_series(spark, sf_dir):
    """MET3/MET7/STR_10/ORD10: series per metric and phase/domain key, with ordered end points."""
    s = MT.series_summary(_points(spark, sf_dir))
    return s.select("metric", "series", "n_points", "min_x", "max_x", F.round("first_y", 6).alias("first_y"),
                    F.round("last_y", 6).alias("last_y"), F.round("sum_y", 6).alias("sum_y"))


@register("q_axis_range", O.with_(O.F7) + _POINTS + _RANGE + """
SELECT metric, round(min_x, 6) AS min_x, round(max_x, 6) AS max_x, round(min_y, 6) AS min_y, round(max_y, 6) AS max_y
FROM rng""")
def q_axis_range(spark, sf_dir):
    """MET4: chart ranges per metric (equal ends widened, y padded by 8 %)."""
    r = MT.axis_range(_points(spark, sf_dir))
    return r.select("metric", *[F.round(c, 6).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")])


@register("q_axis_ticks", O.with_(O.F7) + _POINTS + _RANGE + f"""
SELECT metric, CAST(t AS INTEGER) AS tick, round(34 + t / 4.0 * 232, 6) AS y_px,
       round(max_y - t / 4.0 * (max_y - min_y), 6) AS y_value, round(58 + t / 4.0 * 818, 6) AS x_px,
       round(min_x + t / 4.0 * (max_x - min_x), 6) AS x_value
FROM rng, range(0, 5) tt(t)""")
def q_axis_ticks(spark, sf_dir):
    """MET5: five even ticks per axis."""
    t = MT.axis_ticks(MT.axis_range(_points(spark, sf_dir)))
    return t.select("metric", "tick", *[F.round(c, 6).alias(c) for c in ("y_px", "y_value", "x_px", "x_value")])


@register("q_plot_points", O.with_(O.F7) + _POINTS + _RANGE + f"""
SELECT p.metric, series, x, round(y, 6) AS y,
       round(58 + (x - min_x) / (max_x - min_x) * 818, 4) AS sx,
       round(34 + (max_y - y) / (max_y - min_y) * 232, 4) AS sy
FROM pts p JOIN rng USING (metric)""")
def q_plot_points(spark, sf_dir):
    """MET6: pixel coordinates of each point."""
    pts = _points(spark, sf_dir)
    p = MT.plot_points(pts, MT.axis_range(pts))
    return p.select("metric", "series", "x", F.round("y", 6).alias("y"), F.round("sx", 4).alias("sx"),
                    F.round("sy", 4).alias("sy"))


@register("q_step_tumbling_mean", O.with_(O.F7, """
lines AS (SELECT 'train' AS phase, '' AS domain, step, loss FROM f7
          UNION ALL SELECT 'val', '', step, loss FROM f7 WHERE (row_idx // 10) % 2 = 0 AND row_idx % 70 <> 3)""") + f"""
SELECT phase, domain, CAST(w * {LOG_EVERY} AS BIGINT) AS window_end_step, round(avg({lenient('loss')}), 6) AS mean,
       count({lenient('loss')}) AS n_values
FROM (SELECT *, CAST(ceil({lenient('step')} / {LOG_EVERY}) AS BIGINT) AS w FROM lines WHERE {lenient('step')} IS NOT NULL)
GROUP BY phase, domain, w HAVING count(*) = {LOG_EVERY}""")
def q_step_tumbling_mean(spark, sf_dir):
    """MET1: tumbling mean of the loss over 10-step windows of two phases; incomplete windows not emitted."""
    log = FX.metric_rows(spark, sf_dir)
    val = (F.floor(F.col("row_idx") / 10) % 2 == 0) & (F.col("row_idx") % 70 != 3)
    phases = F.when(val, F.array(F.lit("train"), F.lit("val"))).otherwise(F.array(F.lit("train")))
    lines = log.select("step", "loss", F.lit("").alias("domain"), F.explode(phases).alias("phase"))
    t = MT.tumbling_mean(lines, "loss", LOG_EVERY)
    return t.select("phase", "domain", "window_end_step", F.round("mean", 6).alias("mean"), "n_values")


def _pretty_sql(s: str) -> str:
    h = f"floor({s} / 3600)"
    rem = f"({s} - {h} * 3600)"
    m = f"floor({rem} / 60)"
    sec = f"floor({rem} - {m} * 60)"
    return f"""CASE WHEN {s} < 1e-6 THEN printf('%.0f', {s} * 1e9) || ' ns'
            WHEN {s} < 1e-3 THEN printf('%.0f', {s} * 1e6) || ' µs'
            WHEN {s} < 1 THEN printf('%.0f', {s} * 1e3) || ' ms'
            WHEN {s} < 60 THEN printf('%.3f', {s}) || ' s'
            WHEN {h} < 1 THEN printf('%dm %ds', CAST({m} AS BIGINT), CAST({sec} AS BIGINT))
            ELSE printf('%dh %dm %ds', CAST({h} AS BIGINT), CAST({m} AS BIGINT), CAST({sec} AS BIGINT)) END"""


_SCALES = [10.0 ** k for k in range(-9, 4)]
_SCALE_SQL = "CASE event_id % 13 " + " ".join(
    f"WHEN {i} THEN CAST('{v!r}' AS DOUBLE)" for i, v in enumerate(_SCALES)) + " END"


@register("q_pretty_duration", f"""
SELECT event_id, {_pretty_sql(f'(value * {_SCALE_SQL})')} AS duration_text FROM events""")
def q_pretty_duration(spark, sf_dir):
    """MTH_2: human-readable durations; seconds = value * 10^(event_id % 13 - 9) spans ns to hours."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "value")
    scale = F.element_at(F.array(*[F.lit(v) for v in _SCALES]), (F.col("event_id") % 13 + 1).cast("int"))
    s = F.col("value") * scale
    return ev.select("event_id", M.pretty_duration(s).alias("duration_text"))
