"""Plan helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import functions as F


def rounded(col: str, digits: int = 6):
    return F.round(F.col(col), digits).alias(col)
