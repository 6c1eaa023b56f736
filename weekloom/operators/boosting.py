"""Gradient-boosted regression trees over histograms, with early stopping.

A row is its bins, its label and the sum of trees so far. A level of a tree is one aggregation of gradients by
(node, feature, bin), which are summed before they are shuffled; the sums, as many as nodes times
features times bins, are all that comes to the driver. They are decimals, so their order is of no account.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.operators import trees as T
from weekloom.sources.shared import forget, written


@dataclass(frozen=True)
class BoostConfig:
    # The trainer's defaults.
    num_leaves: int = 7
    learning_rate: float = 0.02
    n_estimators: int = 500
    min_child_samples: int = 10
    lambda_l1: float = 0.5
    lambda_l2: float = 0.5
    stopping_rounds: int = 10
    #: Bins of a feature, and trees between rewrites of the rows' sums.
    bins: int = 63
    rewrite: int = 8


@dataclass
class Tree:
    """Splits by node (feature, bin, left, right), and leaf values."""

    splits: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def column(self, bins: Column, leaf) -> Column:
        """The tree as a conditional expression; ``leaf`` makes a leaf's column of its number."""

        def at(node: int) -> Column:
            if node not in self.splits:
                return leaf(node)
            f, b, left, right = self.splits[node]
            return F.when(bins[f] <= b, at(left)).otherwise(at(right))

        return at(0)


def edges_of(rows: DataFrame, n_features: int, bins: int) -> list[list[float]]:
    """Ascending upper edges of each feature's bins, from approximate quantiles; a value above all is in the last bin."""
    at = [i / bins for i in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(F.get("features", F.lit(i)), at, 10_000).alias(f"f{i}") for i in range(n_features))).first()
    return [sorted({float(v) for v in found[i] or ()}) for i in range(n_features)]


def binned(x: Column, edges: list[float]) -> Column:
    """Number of edges below a value; beyond them all for null and NaN."""
    e = F.array(*map(F.lit, edges)) if edges else F.array().cast("array<double>")
    return F.when(x.isNull() | F.isnan(x), len(edges)).otherwise(F.size(F.filter(e, lambda v: v < x)))


def _gain(g: float, h: float, cfg: BoostConfig) -> float:
    t = max(abs(g) - cfg.lambda_l1, 0.0)
    return t * t / (h + cfg.lambda_l2)


def leaf_value(g: float, h: float, cfg: BoostConfig) -> float:
    """The step of a leaf with gradient sum ``g`` over ``h`` rows."""
    t = max(abs(g) - cfg.lambda_l1, 0.0)
    return -cfg.learning_rate * (t if g > 0 else -t) / (h + cfg.lambda_l2)


def best_split(histogram: dict[tuple[int, int], tuple[float, int]], g: float, h: int, cfg: BoostConfig) -> tuple | None:
    """(gain, feature, bin, left sums, right sums) of the best split of a node by its (feature, bin) sums; ties go to
    the least feature and bin."""
    best = None
    for f in sorted({f for f, _ in histogram}):
        gl, hl = 0.0, 0
        for b in sorted(b for x, b in histogram if x == f)[:-1]:
            gl, hl = gl + histogram[f, b][0], hl + histogram[f, b][1]
            if hl < cfg.min_child_samples or h - hl < cfg.min_child_samples:
                continue
            gain = _gain(gl, hl, cfg) + _gain(g - gl, h - hl, cfg) - _gain(g, h, cfg)
            if gain > 1e-10 and (best is None or gain > best[0] + 1e-12):
                best = gain, f, b, (gl, hl), (g - gl, h - hl)
    return best


def _each(rows: DataFrame, node: Column) -> DataFrame:
    """(node, g, f, b): a row for each feature of a training row in an open node. Node and gradient are made before rows are
    multiplied: the sum of trees so far is a long expression."""
    made = rows.where("train").select(node.alias("node"), (F.col("sum") - F.col("y")).cast("decimal(28,12)").alias("g"), "bins").where("node IS NOT NULL")
    return made.select("node", "g", F.posexplode("bins").alias("f", "b"))


def _sums(rows: DataFrame, node: Column) -> dict[int, dict[tuple[int, int], tuple[float, int]]]:
    """Gradient sums and counts of training rows by node, feature and bin."""
    found: dict[int, dict] = {}
    for r in _each(rows, node).groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("h")).collect():
        found.setdefault(r.node, {})[r.f, r.b] = float(r.g), r.h
    return found


def _grow(rows: DataFrame, cfg: BoostConfig) -> Tree:
    """One tree, level by level; where leaves run out, the splits of the largest gain come first."""
    tree, n_nodes, leaves = Tree(), 1, 1
    open_: dict[int, tuple[float, int] | None] = {0: None}
    while open_:
        node = tree.column(F.col("bins"), lambda i: F.lit(i if i in open_ else None).cast("int"))
        histograms = _sums(rows, node)
        wanted = []
        for i, known in open_.items():
            h = histograms.get(i, {})
            first = [v for (f, _), v in h.items() if f == 0]
            g, n = known or (sum(v[0] for v in first), sum(v[1] for v in first))
            tree.values[i] = leaf_value(g, n, cfg)
            if (s := best_split(h, g, n, cfg)) is not None:
                wanted.append((-s[0], i, s))
        open_ = {}
        for _, i, (_, f, b, left, right) in sorted(wanted)[: cfg.num_leaves - leaves]:
            tree.splits[i] = f, b, n_nodes, n_nodes + 1
            del tree.values[i]
            tree.values[n_nodes], tree.values[n_nodes + 1] = leaf_value(*left, cfg), leaf_value(*right, cfg)
            open_ |= {n_nodes: left, n_nodes + 1: right}
            n_nodes, leaves = n_nodes + 2, leaves + 1
        if leaves >= cfg.num_leaves:
            break
    return tree


def fit(rows: DataFrame, cfg: BoostConfig = BoostConfig(), name: str = "boosted", edges: list[list[float]] | None = None) -> tuple[DataFrame, list[float]]:
    """(nodes, losses): the node table of trees on (features array<double>, y double, train boolean) rows, and the
    validation loss after each tree.

    Training rows (``train``) grow the trees, the others stop them: when ``stopping_rounds`` trees bring no lower mean
    squared error, the trees after the best are dropped. Without others all trees stay. The first tree is a
    single leaf, the mean label. Rows with a null y or features take no part; without training rows there are no nodes."""
    spark = rows.sparkSession
    rows = rows.where("y IS NOT NULL AND NOT isnan(y) AND features IS NOT NULL").select("features", F.col("y").cast("double").alias("y"), F.coalesce("train", F.lit(False)).alias("train"))
    first = rows.where("train").agg(F.avg(F.col("y").cast("decimal(28,12)")).cast("double").alias("mean"), F.max(F.size("features")).alias("d")).first()
    if first.mean is None:
        return spark.createDataFrame([], T.NODES), []
    edges = edges_of(rows.where("train"), first.d, cfg.bins) if edges is None else edges
    bins = F.array(*(binned(F.get("features", F.lit(i)), e).cast("int") for i, e in enumerate(edges)))
    state = written(rows.select(bins.alias("bins"), "y", "train", F.lit(first.mean).alias("sum")), "boosting")
    grown: list[Tree] = []
    losses: list[float] = []
    best, now = 0, state
    for k in range(cfg.n_estimators):
        tree = _grow(now, cfg)
        grown.append(tree)
        now = now.withColumn("sum", F.col("sum") + tree.column(F.col("bins"), lambda i, t=tree: F.lit(t.values[i])))
        if (k + 1) % cfg.rewrite == 0:
            last, state = state, written(now, "boosting")
            forget(last)
            now = state
        error = F.pow(F.col("sum") - F.col("y"), F.lit(2)).cast("decimal(28,12)")
        loss = now.where("NOT train").agg((F.sum(error) / F.count(F.lit(1))).cast("double").alias("x")).first().x
        if loss is not None:
            losses.append(loss)
            best = k if loss < losses[best] else best
            if k - best >= cfg.stopping_rounds:
                grown = grown[: best + 1]
                break
    forget(state)
    if losses:
        grown = grown[: best + 1]
    table = [(name, 0, 0, None, None, None, None, first.mean)]
    for t, tree in enumerate(grown, 1):
        table += [(name, t, i, f, edges[f][b], left, right, None) for i, (f, b, left, right) in tree.splits.items()]
        table += [(name, t, i, None, None, None, None, v) for i, v in tree.values.items()]
    return spark.createDataFrame(table, T.NODES), losses


def predicted(rows: DataFrame, nodes: DataFrame, name: str = "boosted", into: str = "prediction") -> DataFrame:
    """``rows`` with the ensemble's value of their features; null without the model."""
    return T.summed(rows, nodes, name, "__s").withColumn(into, F.col("__s.total")).drop("__s")
