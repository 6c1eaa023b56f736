"""Deterministic splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.operators.metrics import ranked


def stratified(rows: DataFrame, label: str, id_col: str, ratio: float = 0.15, seed: int = 42) -> DataFrame:
    """With ``part``: round(ratio * n) rows of each label go to val, by the hash of seed and id.

    Rows are ranked by label and hash over ranges, so no task sorts a whole label; a label's first rank
    is its offset. Null is a label like others. One row a label comes back to be joined."""
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))
    placed = ranked(rows.withColumn("__k", key), (label, "__k", id_col))
    per = placed.groupBy(F.col(label).alias("__l")).agg((F.min("rank") - 1 + F.round(F.count(F.lit(1)) * ratio)).alias("__last"))
    out = placed.join(per, placed[label].eqNullSafe(per["__l"]))
    return out.withColumn("part", F.when(F.col("rank") <= F.col("__last"), "val").otherwise("train")).drop("__k", "__l", "__last", "rank")


def by_time(rows: DataFrame, order: tuple[str, ...], share: float = 0.8) -> DataFrame:
    """With ``part``: the first int(share * n) rows in order train, the rest test. ``order`` must
    settle ties."""
    placed = ranked(rows, order)
    n = F.broadcast(rows.agg(F.count(F.lit(1)).alias("__n")))
    return placed.join(n).withColumn("part", F.when(F.col("rank") <= F.floor(F.col("__n") * share), "train").otherwise("test")).drop("__n", "rank")
