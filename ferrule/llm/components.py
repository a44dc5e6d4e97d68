"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum and an equality join; nothing is gathered per node, so a
node with any number of neighbours costs partial aggregates only. The edge table is
written to the shared checkpoint folder after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = _both_ways(edges)
    least = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).select("k", F.least("k", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
    tied = down.join(least, F.col("a") == F.col("k"))
    return tied.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                         F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")


def _state(edges: DataFrame) -> tuple:
    """Order-free digest of an edge table: equal digests mean that a round changed nothing."""
    h = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(a, b)`` links of longs -> ``(node, component)``: every linked node and its smallest reachable node.

    Self-links and nulls are ignored; an empty table gives an empty table. Raises if
    ``max_rounds`` rounds don't settle it (each round shortens paths by a constant
    factor, so 50 is far beyond any table that fits a cluster).
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        now = materialise(_small_star(_large_star(now)).where("a <> b").distinct(), "stars")
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
