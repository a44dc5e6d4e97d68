"""Small-array math as higher-order column expressions (ARR_*).

Router logits are short arrays (one value per expert), so softmax, argmax and
cross-entropy run row-wise in the JVM with ``transform``/``aggregate``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double_array(col) -> Column:
    return _c(col).cast("array<double>")


def argmax(col) -> Column:
    """0-based index of the largest element; lowest index on ties."""
    z = _c(col)
    return (F.array_position(z, F.array_max(z)) - F.lit(1)).cast("int")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda over a one-element array binds it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def logsumexp(col) -> Column:
    z = _c(col)
    return _let(F.array_max(z), lambda m: m + F.log(F.aggregate(z, F.lit(0.0).cast("double"), lambda acc, x: acc + F.exp(x - m))))


def log_softmax(col) -> Column:
    z = _c(col)
    return _let(logsumexp(z), lambda lse: F.transform(z, lambda x: x - lse))


def softmax(col) -> Column:
    z = _c(col)
    return _let(logsumexp(z), lambda lse: F.transform(z, lambda x: F.exp(x - lse)))


def nll_at(col, index) -> Column:
    """``-log_softmax(z)[index]`` for a 0-based index column: the log-sum less one element."""
    z = _c(col)
    return logsumexp(z) - F.element_at(z, _c(index) + F.lit(1))


def add_at(col, index, delta: float) -> Column:
    """Add ``delta`` at one 0-based position of an array."""
    z, k = _c(col), _c(index)
    return F.transform(z, lambda x, i: F.when(i == k, x + F.lit(float(delta))).otherwise(x))


def array_sum(col) -> Column:
    return F.aggregate(_c(col), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def as_matrix(col) -> Column:
    """ARR_3: nested numeric arrays as float rows (``array<array<double>>``)."""
    return _c(col).cast("array<array<double>>")
