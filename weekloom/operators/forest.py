"""Isolation forest: random partition trees over small subsamples; rows that are isolated early stand out."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import ceil, log, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weekloom.operators import trees
from weekloom.sources.shared import written

EULER = 0.5772156649015329


@dataclass(frozen=True)
class ForestConfig:
    # The trainer's defaults.
    contamination: float = 0.1
    trees: int = 100
    sample: int = 256
    seed: int = 42


def average_path(n: float) -> float:
    """Expected depth of a search among ``n`` points: what a leaf of that size still stands for."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (log(n - 1) + EULER) - 2 * (n - 1) / n


def draws(seed: int, tree: int, node: int) -> tuple[float, float]:
    """Two numbers from 0 to 1 that depend on the place in the forest alone."""
    h = hashlib.blake2b(f"{seed}:{tree}:{node}".encode(), digest_size=16).digest()
    return int.from_bytes(h[:8], "big") / 2**64, int.from_bytes(h[8:], "big") / 2**64


def subsamples(rows: DataFrame, n: int, cfg: ForestConfig, key: tuple[str, ...]) -> DataFrame:
    """(tree, place, features): each tree's ``cfg.sample`` rows with the least hashes. A row is kept for the few trees
    whose hash lies below twice the share needed, so that only those are dealt out and ranked, whatever ``n`` is."""
    share = min(1.0, 2.0 * cfg.sample / max(n, 1) + 64.0 / max(n, 1))
    # rows by trees as a generator and a filter, which are compiled; array functions over the trees are not
    each = rows.select(*key, "features", F.explode(F.sequence(F.lit(0), F.lit(cfg.trees - 1))).alias("tree"))
    some = each.withColumn("u", F.pmod(F.xxhash64(*key, F.lit(cfg.seed), "tree"), F.lit(1 << 40)) / float(1 << 40)).where(F.col("u") < share)
    by = W.partitionBy("tree").orderBy("u", *key, "features")
    return some.withColumn("place", F.row_number().over(by)).where(F.col("place") <= cfg.sample).select("tree", "place", "features")


def grown(x: np.ndarray, tree: int, cfg: ForestConfig) -> list[tuple]:
    """Nodes (node, feature, threshold, left, right, value) of one tree over the rows of ``x``: a feature drawn among
    those that vary, a threshold drawn in its range, down to single rows or the depth of a balanced tree."""
    out: list[tuple] = []
    limit = ceil(log2(max(len(x), 2)))
    pending = [(0, np.arange(len(x)), 0)]
    names = 1
    while pending:
        node, at, depth = pending.pop()
        low, high = x[at].min(axis=0), x[at].max(axis=0)
        vary = np.flatnonzero(high > low)
        if depth >= limit or len(at) <= 1 or not len(vary):
            out.append((node, None, None, None, None, depth + average_path(len(at))))
            continue
        u, v = draws(cfg.seed, tree, node)
        f = int(vary[int(u * len(vary))])
        threshold = float(low[f] + v * (high[f] - low[f]))
        goes = x[at, f] <= threshold
        out.append((node, f, threshold, names, names + 1, None))
        pending += [(names, at[goes], depth + 1), (names + 1, at[~goes], depth + 1)]
        names += 2
    return sorted(out)


def fit(rows: DataFrame, key: tuple[str, ...], cfg: ForestConfig = ForestConfig(), name: str = "isolation") -> DataFrame:
    """Node table of a forest over ``rows`` (key columns, features array<double>); leaves hold path lengths. Rows with a
    null array, or one that holds null or NaN, take no part; a table without others gives no nodes. Rows need a
    key that tells them apart, or equal ones are drawn together."""
    usable = rows.where(F.col("features").isNotNull() & ~F.exists("features", lambda v: v.isNull() | F.isnan(v)))
    n = usable.count()

    def grow(key_: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(key_[0])
        x = np.stack(sample.sort_values("place")["features"].to_list())
        return pd.DataFrame([(name, tree, *node) for node in grown(x, tree, cfg)], columns=[c.split(" ")[0] for c in trees.NODES.split(", ")])

    return subsamples(usable, n, cfg, key).groupBy("tree").applyInPandas(grow, trees.NODES)  # cfg.sample rows a group


def anomaly_score(path: Column, sample: Column | int = 256) -> Column:
    """From 0 to 1 by a row's mean path length in trees grown on ``sample`` rows; about one half is ordinary. Null where
    trees of a single row tell nothing."""
    size = F.lit(sample) if isinstance(sample, int) else sample
    expected = F.when(size <= 1, None).when(size == 2, 1.0).otherwise(2 * (F.log(size - 1) + EULER) - 2 * (size - 1) / size)
    return F.pow(F.lit(2.0), -path / expected)


def score(packed_trees: Column, x: Column, sample: Column | int = 256) -> Column:
    """``anomaly_score`` of a feature array by packed trees."""
    return anomaly_score(trees.mean(packed_trees, x), sample)


def cutoff(scored: DataFrame, contamination: float, col: str = "score", bins: int = 10_000) -> float:
    """The score that a share of ``contamination`` of all rows lies at or above, to one of ``bins`` steps: only the
    histogram comes to the driver. 1 for no rows."""
    counts = scored.where(F.col(col).isNotNull()).groupBy(F.least(F.floor(F.col(col) * bins), F.lit(bins - 1)).cast("int").alias("b")).count().collect()
    total, above = sum(r["count"] for r in counts), 0
    for r in sorted(counts, reverse=True):
        above += r["count"]
        if above >= contamination * total:
            return r["b"] / bins
    return 1.0


def anomalies(rows: DataFrame, nodes: DataFrame, cfg: ForestConfig = ForestConfig(), name: str = "isolation") -> DataFrame:
    """``rows`` with score, decision (negative for anomalies) and anomaly, by a stored forest. ``cfg.sample`` must be the
    rows that its trees were grown on at most; of fewer rows, their number counts as in ``fit``."""
    n = F.least(F.lit(cfg.sample), F.greatest(F.lit(rows.count()), F.lit(1)))
    path = F.col("__s.total") / F.col("__s.trees")
    scored = written(trees.summed(rows, nodes, name, "__s").withColumn("score", anomaly_score(path, n)).drop("__s"), "scored")
    at = cutoff(scored, cfg.contamination)
    return scored.withColumn("decision", F.lit(at) - F.col("score")).withColumn("anomaly", F.col("score") >= at)
