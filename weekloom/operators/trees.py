"""Stored tree ensembles and their sums as column expressions.

An ensemble is a table of nodes (model, tree, node, feature, threshold, left, right, value): node 0 is a
tree's root, a leaf has a null feature, and a row goes left where its feature is at most the threshold;
null and NaN go right. ``packed`` makes one row a model of it, to be joined to the rows it scores: for a
few rows, or a model a row. ``summed`` scores whole tables by one model, some forty times as fast (Arrow and numpy).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = "model string, tree int, node int, feature int, threshold double, left int, right int, value double"


def packed(nodes: DataFrame) -> DataFrame:
    """(model, trees): every model's trees as arrays by node, in order. Models are small: their size is that of their
    node tables, and only they are grouped."""
    tree = nodes.groupBy("model", "tree").agg(F.sort_array(F.collect_list(F.struct("node", F.coalesce("feature", F.lit(-1)).alias("feature"), "threshold", "left", "right", "value"))).alias("n"))
    arrays = F.struct("tree", *(F.col(f"n.{c}").alias(c) for c in ("feature", "threshold", "left", "right", "value")), _depth(F.col("n")).alias("depth"))
    return tree.groupBy("model").agg(F.sort_array(F.collect_list(arrays)).alias("trees"))


def _depth(nodes: Column) -> Column:
    """Splits on the longest way from the root, by levels of nodes."""
    inner = F.size(F.filter(nodes, lambda n: n["feature"] >= 0))

    def below(level: Column) -> Column:
        splits = F.filter(level, lambda i: F.get(nodes, i)["feature"] >= 0)
        return F.flatten(F.transform(splits, lambda i: F.array(F.get(nodes, i)["left"], F.get(nodes, i)["right"])))

    level = F.struct(F.array(F.lit(0)).alias("at"), F.lit(0).alias("d"))
    step = lambda s, _: F.struct(below(s["at"]).alias("at"), (s["d"] + F.exists(s["at"], lambda i: F.get(nodes, i)["feature"] >= 0).cast("int")).alias("d"))
    return F.aggregate(F.sequence(F.lit(0), inner), level, step)["d"]


def leaf(tree: Column, x: Column) -> Column:
    """Value of the leaf that the feature array ``x`` reaches. The walk has as many steps as the tree is deep, and
    stands still at a leaf."""

    def step(at: Column, _: Column) -> Column:
        f = F.get(tree["feature"], at)
        down = F.when(F.get(x, f) <= F.get(tree["threshold"], at), F.get(tree["left"], at)).otherwise(F.get(tree["right"], at))
        return F.when(f < 0, at).otherwise(down)

    return F.get(tree["value"], F.aggregate(F.sequence(F.lit(0), tree["depth"]), F.lit(0), step))


def total(trees: Column, x: Column) -> Column:
    """Sum of the leaves' values over an ensemble; 0 without trees."""
    return F.aggregate(trees, F.lit(0.0), lambda acc, t: acc + leaf(t, x))


def mean(trees: Column, x: Column) -> Column:
    return total(trees, x) / F.size(trees)


def with_model(rows: DataFrame, nodes: DataFrame, name: str, into: str = "trees") -> DataFrame:
    """``rows`` with the trees of the model ``name``. One row of at most ``MODEL_NODES`` nodes is broadcast."""
    one = nodes.where(F.col("model") == name)
    if one.count() > MODEL_NODES:
        raise ValueError(f"model {name} has over {MODEL_NODES} nodes")
    held = packed(one).select(F.col("model").alias("__model"), F.col("trees").alias(into))
    return rows.withColumn("__model", F.lit(name)).join(F.broadcast(held), "__model", "left").drop("__model")


def summed(rows: DataFrame, nodes: DataFrame, name: str, into: str, features: str = "features") -> DataFrame:
    """``rows`` with the sum of one model's leaves and the number of its trees, as a struct (total, trees); null where
    the feature array is null or the model has no nodes. Its nodes, ``MODEL_NODES`` at most, go to every task."""
    found = nodes.where(F.col("model") == name).orderBy("tree", "node").limit(MODEL_NODES + 1).collect()
    if len(found) > MODEL_NODES:
        raise ValueError(f"model {name} has over {MODEL_NODES} nodes")
    out = T.StructType().add("total", T.DoubleType()).add("trees", T.IntegerType())
    if not found:
        return rows.withColumn(into, F.lit(None).cast(out))
    first: dict[int, int] = {}
    for i, r in enumerate(found):
        first.setdefault(r.tree, i)
    place = {(r.tree, r.node): i for i, r in enumerate(found)}
    feature = np.array([-1 if r.feature is None else r.feature for r in found])
    threshold = np.array([np.nan if r.threshold is None else r.threshold for r in found])
    left = np.array([i if r.left is None else place[r.tree, r.left] for i, r in enumerate(found)])
    right = np.array([i if r.right is None else place[r.tree, r.right] for i, r in enumerate(found)])
    value = np.array([0.0 if r.value is None else r.value for r in found])
    roots, width = np.array(list(first.values())), int(feature.max()) + 1

    @F.pandas_udf(out)
    def run(x: pd.Series) -> pd.DataFrame:
        total = np.full(len(x), np.nan)
        there = np.flatnonzero(x.notna().to_numpy())
        for i in range(0, len(there), 4096):
            part = there[i : i + 4096]
            wide = np.full((len(part), max(width, 1)), np.nan)
            for k, a in enumerate(x.iloc[part]):
                wide[k, : len(a)] = a[:width]
            at = np.tile(roots, (len(part), 1))
            row = np.arange(len(part))[:, None]
            while (feature[at] >= 0).any():
                with np.errstate(invalid="ignore"):
                    goes = wide[row, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(goes, left[at], right[at])  # a leaf leads to itself
            total[part] = value[at].sum(axis=1)
        return pd.DataFrame({"total": total, "trees": len(roots)})

    return rows.withColumn(into, F.when(F.col(features).isNotNull(), run(F.col(features))))


#: Nodes of a model that may be broadcast (some 40 bytes each).
MODEL_NODES = 500_000
