"""Numeric formatting and colour expressions (MTH_*, T6, T7)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ferrule.functions.udf_support import ship_by_value

# --- fixed values: five-stop viridis-like colour ramp (RGB) ------------------
VIRIDIS_STOPS = [
    (68, 1, 84),
    (59, 82, 139),
    (33, 145, 140),
    (94, 201, 98),
    (253, 231, 37),
]
# -----------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _hex2(v: Column) -> Column:
    return F.lower(F.lpad(F.hex(v.cast("int")), 2, "0"))


def viridis_color(value, min_value, max_value) -> Column:
    """Hex colour on the 5-stop ramp; clamps to [0, 1]; ``max <= min`` -> top stop.

    Channel interpolation rounds half-to-even, like Python's ``round``.
    """
    v, lo, hi = _c(value), _c(min_value), _c(max_value)
    t = F.when(hi <= lo, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - lo) / (hi - lo))))
    n_seg = len(VIRIDIS_STOPS) - 1
    scaled = t * F.lit(float(n_seg))
    idx = F.least(F.floor(scaled), F.lit(n_seg - 1)).cast("int")
    local = scaled - idx
    stops = F.array(*[F.array(*[F.lit(c) for c in stop]) for stop in VIRIDIS_STOPS])
    c0 = F.element_at(stops, idx + 1)
    c1 = F.element_at(stops, idx + 2)
    chans = [F.bround(F.element_at(c0, k) + (F.element_at(c1, k) - F.element_at(c0, k)) * local, 0)
             for k in (1, 2, 3)]
    return F.concat(F.lit("#"), *[_hex2(ch) for ch in chans])


def fixed(x: Column, digits: int) -> Column:
    """``f"{x:.{digits}f}"`` for |x| below about 1e12: rounds the double's exact binary value, half to even.

    ``x = high + low`` with 26 bits in ``high``, so both products with 10 ** digits are exact, and
    so is the sign of their distance from the middle between two neighbouring results.
    """
    scale = float(10 ** digits)
    v = F.abs(x.cast("double"))
    c = v * F.lit(134217729.0)
    high = c - (c - v)
    low = v - high
    k = F.floor(v * F.lit(scale)).cast("double")
    off = (high * F.lit(scale) - (k + F.lit(0.5))) + low * F.lit(scale)
    n = F.when(off > 0, k + 1).when(off < 0, k).otherwise(k + k % 2).cast("long")
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    if not digits:
        return F.concat(sign, n.cast("string"))
    whole, rest = F.floor(n / F.lit(10 ** digits)).cast("long"), n % F.lit(10 ** digits)
    return F.concat(sign, whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), digits, "0"))


def pretty_duration(seconds) -> Column:
    """Duration text in ns / µs / ms / s / "Xm Ys" / "Xh Ym Zs"."""
    s = _c(seconds).cast("double")
    h = F.floor(s / 3600)
    rem = s - h * 3600
    m = F.floor(rem / 60)
    sec = F.floor(rem - m * 60)
    long_form = F.when(h < 1, F.format_string("%dm %ds", m.cast("long"), sec.cast("long"))) \
        .otherwise(F.format_string("%dh %dm %ds", h.cast("long"), m.cast("long"), sec.cast("long")))
    return (F.when(s < 1e-6, F.concat(fixed(s * 1e9, 0), F.lit(" ns")))
            .when(s < 1e-3, F.concat(fixed(s * 1e6, 0), F.lit(" µs")))
            .when(s < 1, F.concat(fixed(s * 1e3, 0), F.lit(" ms")))
            .when(s < 60, F.concat(fixed(s, 3), F.lit(" s")))
            .otherwise(long_form))


def _g6(values: pd.Series) -> pd.Series:
    return values.map(lambda v: f"{v:.6g}")


_g6_udf = F.pandas_udf(_g6, StringType())


def format_g6(value, signed: bool = False) -> Column:
    """``%.6g`` (or ``%+.6g``): 6 significant digits of the exact binary value, ties to even, no trailing zeros.

    The JVM's own formatter rounds the shortest decimal text instead, which is wrong at ties, and no
    built-in function gives a double's exact digits; so the text is made in Arrow batches.
    """
    v = _c(value).cast("double")
    text = F.when(v.isNull(), F.lit(None)).when(F.isnan(v), F.lit("nan")).otherwise(_g6_udf(v))
    return F.when(F.startswith(text, F.lit("-")), text).otherwise(F.concat(F.lit("+"), text)) if signed else text


ship_by_value(__name__)
