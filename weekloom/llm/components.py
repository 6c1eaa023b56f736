"""Connected components of an edge table, without a driver-side graph.

Alternates large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014). Every round is two aggregations and two equi-joins; a hub's rows sit on the
probe side of a sort-merge join, which AQE splits, and its minimum is a map-side combined ``min``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import counted, forget, written


def _star(edges: DataFrame) -> DataFrame:
    """(node, other) -> (other, least node around), including the node itself."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few: int = 0) -> DataFrame:
    """Rows (node, root) for every node of ``edges``; root is the smallest node reachable.

    Null ends and loops are ignored. An empty table gives an empty result. ``max_rounds`` is a
    guard against a defect only: rounds grow with the logarithm of the longest chain, and running
    out of them raises. Edges that are counted to be at most ``few`` are kept in one partition, so
    that a round of them has no shuffles; none are by default.
    """
    e = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u < v").distinct()
    e = written(counted(e), "edges")
    together = (lambda t: t.coalesce(1)) if few and e.measured["rows"] <= few else (lambda t: t)
    seen = None
    for _ in range(max_rounds):
        both = together(e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every edge now points from the larger end (u) to a smaller one (v)
        stars = _star(large)
        little = together(stars.select(F.col("v").alias("a"), F.col("m").alias("b")).union(stars.select(F.col("u").alias("a"), F.col("m").alias("b")))).where("a <> b").distinct()
        last, e = e, written(counted(little.select(F.col("b").alias("u"), F.col("a").alias("v")), x=F.bit_xor(F.xxhash64("u", "v"))), "edges")
        forget(last)
        now = e.measured
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
