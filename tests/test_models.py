"""Forests, boosted trees, model tables and Shapiro-Wilk against plain loops and published samples."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.functions import normal
from weekloom.operators import boosting, forest, metrics, trees
from weekloom.sources import models


def walk(nodes, x):
    at = 0
    while nodes[at][1] is not None:
        f, threshold, left, right = nodes[at][1:5]
        v = x[f] if f < len(x) else None
        at = left if v is not None and v <= threshold else right
    return nodes[at][5]


def test_normal_distribution(spark):
    n = NormalDist()
    ps = [1e-12, 1e-6, 0.001, 0.0242, 0.025, 0.3, 0.5, 0.77, 0.99, 1 - 1e-9]
    zs = [-9, -6.5, -3, -0.2, 0, 0.7, 2.5, 6.9, 7.3]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(normal.quantile(F.col("p"))).collect()
    assert all(abs(r[0] - n.inv_cdf(p)) < 1e-7 * max(1, abs(n.inv_cdf(p))) for r, p in zip(got, ps))
    got = spark.createDataFrame([(float(z),) for z in zs], "z double").select(normal.upper_tail(F.col("z"))).collect()
    tail = [math.erfc(z / math.sqrt(2)) / 2 for z in zs]
    assert all(abs(r[0] - t) < 1e-7 * t for r, t in zip(got, tail))
    assert spark.range(1).select(normal.quantile(F.lit(0.0)).alias("a"), normal.quantile(F.lit(1.0)).alias("b")).first() == (None, None)


PUBLISHED = [
    ([0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75, 0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53, 4.55, 0.47, 6.66], 0.90047299861907959, 0.042089745402336121),
    ([1.36, 1.14, 2.92, 2.55, 1.46, 1.06, 5.27, -1.11, 3.48, 1.10, 0.88, -0.51, 1.46, 0.52, 6.20, 1.69, 0.08, 3.67, 2.81, 3.49], 0.9590270, 0.52460),
]


@pytest.mark.parametrize(("xs", "w", "p"), PUBLISHED)
def test_shapiro_published(spark, xs, w, p):
    rows = spark.createDataFrame(list(enumerate(xs)) + [(98, None), (99, math.nan)], "k int, x double").repartition(3)
    got = metrics.shapiro_wilk(rows, "x", ("k",)).first()
    assert got.n == len(xs) and abs(got.w - w) < 1e-5 and abs(got.p - p) < 1e-4


def slow_shapiro(xs):
    n = len(xs)
    xs, nd = sorted(xs), NormalDist()
    m = [nd.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mm, u = sum(v * v for v in m), n**-0.5
    poly = lambda c, v: sum(k * v**j for j, k in enumerate(c))
    if n == 3:
        a = [-math.sqrt(0.5), 0, math.sqrt(0.5)]
    else:
        last = poly([0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056], u) + m[-1] / math.sqrt(mm)
        if n > 5:
            second = poly([0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633], u) + m[-2] / math.sqrt(mm)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = [-last, -second, *(v / math.sqrt(phi) for v in m[2:-2]), second, last]
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = [-last, *(v / math.sqrt(phi) for v in m[1:-1]), last]
    mean = sum(xs) / n
    return sum(x * y for x, y in zip(a, xs)) ** 2 / sum((x - mean) ** 2 for x in xs)


@pytest.mark.parametrize("n", [3, 4, 5, 6, 11, 12, 50, 400])
def test_shapiro_sizes(spark, n):
    rng = random.Random(n)
    xs = [rng.gauss(3, 2) for _ in range(n)]
    got = metrics.shapiro_wilk(spark.createDataFrame(list(enumerate(xs)), "k int, x double"), "x", ("k",)).first()
    assert abs(got.w - slow_shapiro(xs)) < 1e-8 and 0 < got.p <= 1
    skewed = metrics.shapiro_wilk(spark.createDataFrame([(k, math.exp(2 * x)) for k, x in enumerate(xs)], "k int, x double"), "x", ("k",)).first()
    assert n < 50 or skewed.p < 1e-6


def test_shapiro_first_rows_and_nothing(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(k, rng.gauss(0, 1) if k < 60 else 1000.0 * k) for k in range(200)], "k int, x double")
    assert metrics.shapiro_wilk(rows, "x", ("k",), 60).first() == metrics.shapiro_wilk(rows.where("k < 60"), "x", ("k",)).first()
    for part in (rows.where("false"), rows.where("k < 2"), rows.withColumn("x", F.lit(4.0))):
        got = metrics.shapiro_wilk(part, "x", ("k",)).first()
        assert got.w is None and got.p is None and got.n == part.count()


def points(n=700):
    rng = random.Random(4)
    return [(i, [rng.gauss(0, 1), rng.gauss(0, 1), 3.0]) for i in range(n)] + [(9000 + i, [rng.choice([-9.0, 9.0]), 8.0 + i, 3.0]) for i in range(12)]


def test_isolation_forest_against_plain_one(spark):
    cfg = forest.ForestConfig(trees=40, sample=64, contamination=0.02)
    rows = spark.createDataFrame([*points(), (-1, None), (-2, [1.0, None, 2.0]), (-3, [math.nan, 1.0, 1.0])], "id long, features array<double>").repartition(5)
    nodes = forest.fit(rows, ("id",), cfg).cache()
    assert nodes.columns == [c.split(" ")[0] for c in trees.NODES.split(", ")]
    drawn = {}
    for r in forest.subsamples(rows.where("id >= 0"), len(points()), cfg, ("id",)).collect():
        drawn.setdefault(r.tree, []).append((r.place, r.features))
    assert len(drawn) == cfg.trees and all(len(v) == cfg.sample for v in drawn.values())

    def plain(sample, tree):
        """A recursive forest on the same draws."""
        found, names = {}, [1]
        limit = math.ceil(math.log2(len(sample)))
        todo = [(0, sample, 0)]
        while todo:
            node, at, depth = todo.pop()
            vary = [f for f in range(3) if min(x[f] for x in at) < max(x[f] for x in at)] if at else []
            if depth >= limit or len(at) <= 1 or not vary:
                found[node] = (node, None, None, None, None, depth + forest.average_path(len(at)))
                continue
            u, v = forest.draws(cfg.seed, tree, node)
            f = vary[int(u * len(vary))]
            low, high = min(x[f] for x in at), max(x[f] for x in at)
            threshold = low + v * (high - low)
            left, right = names[0], names[0] + 1
            names[0] += 2
            found[node] = (node, f, threshold, left, right, None)
            todo += [(left, [x for x in at if x[f] <= threshold], depth + 1), (right, [x for x in at if x[f] > threshold], depth + 1)]
        return found

    grown = {t: plain([x for _, x in sorted(v)], t) for t, v in drawn.items()}
    want = {i: 2 ** (-np.mean([walk(t, x) for t in grown.values()]) / forest.average_path(64)) for i, x in points()}
    out = forest.anomalies(rows.where("id >= 0"), nodes, cfg)
    got = {r.id: r for r in out.collect()}
    assert all(abs(got[i].score - s) < 1e-9 for i, s in want.items())
    top = sorted(want, key=want.get, reverse=True)[:15]
    assert {i for i in got if got[i].anomaly} >= set(top[:10]) and sum(r.anomaly for r in got.values()) <= 30
    assert all((r.decision <= 0) == r.anomaly for r in got.values())
    assert len({i for i in top if i >= 9000}) >= 11  # what lies apart is found
    again = forest.fit(rows.repartition(2), ("id",), cfg).collect()
    assert sorted(map(str, again)) == sorted(map(str, nodes.collect()))
    assert forest.fit(rows.where("false"), ("id",), cfg).count() == 0


def slow_boosting(rows, edges, cfg):
    """Level-wise boosting with plain lists; (values of all rows, losses)."""
    train = [r for r in rows if r[2]]
    mean = sum(r[1] for r in train) / len(train)
    value = [mean] * len(rows)
    bins = [[sum(e < x for e in es) for x, es in zip(r[0], edges)] for r in rows]
    kept, losses, best = [list(value)], [], 0
    t = lambda g: max(abs(g) - cfg.lambda_l1, 0.0)
    for k in range(cfg.n_estimators):
        g = [v - r[1] for v, r in zip(value, rows)]
        leaves, level = {0: list(range(len(rows)))}, [0]
        name = 1
        while level and len(leaves) < cfg.num_leaves:
            wanted = []
            for node in level:
                at = [i for i in leaves[node] if rows[i][2]]
                G, top = sum(g[i] for i in at), None
                for f in range(len(edges)):
                    for b in sorted({bins[i][f] for i in at})[:-1]:
                        left = [i for i in at if bins[i][f] <= b]
                        if min(len(left), len(at) - len(left)) < cfg.min_child_samples:
                            continue
                        gl = sum(g[i] for i in left)
                        gain = t(gl) ** 2 / (len(left) + cfg.lambda_l2) + t(G - gl) ** 2 / (len(at) - len(left) + cfg.lambda_l2) - t(G) ** 2 / (len(at) + cfg.lambda_l2)
                        if gain > 1e-10 and (top is None or gain > top[0] + 1e-12):
                            top = gain, f, b
                if top:
                    wanted.append((-top[0], node, top[1], top[2]))
            level = []
            for _, node, f, b in sorted(wanted)[: cfg.num_leaves - len(leaves)]:
                at = leaves.pop(node)
                leaves[name], leaves[name + 1] = [i for i in at if bins[i][f] <= b], [i for i in at if bins[i][f] > b]
                level += [name, name + 1]
                name += 2
        for at in leaves.values():
            own = [i for i in at if rows[i][2]]
            G = sum(g[i] for i in own)
            step = -cfg.learning_rate * (t(G) if G > 0 else -t(G)) / (len(own) + cfg.lambda_l2)
            for i in at:
                value[i] += step
        kept.append(list(value))
        held = [i for i, r in enumerate(rows) if not r[2]]
        if held:
            losses.append(sum((value[i] - rows[i][1]) ** 2 for i in held) / len(held))
            best = k if losses[k] < losses[best] else best
            if k - best >= cfg.stopping_rounds:
                break
    return kept[best + 1 if losses else -1], losses


@pytest.mark.parametrize("noise", [0.1, 3.0])
def test_boosting_against_plain_loop(spark, noise):
    rng = random.Random(11)
    rows = []
    for i in range(260):
        x = [rng.gauss(0, 1), rng.random(), float(rng.randint(0, 4))]
        rows.append((x, math.sin(2 * x[0]) + x[2] / 2 + rng.gauss(0, noise), i % 5 != 0))
    cfg = boosting.BoostConfig(n_estimators=14, learning_rate=0.3, stopping_rounds=3, bins=16, rewrite=4)
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, features array<double>, y double, train boolean")
    edges = boosting.edges_of(table.where("train"), 3, cfg.bins)
    nodes, losses = boosting.fit(table, cfg)
    want, slow_losses = slow_boosting(rows, edges, cfg)
    got = {r.id: r.prediction for r in boosting.predicted(table, nodes).collect()}
    assert np.allclose(losses, slow_losses, atol=1e-9)
    assert all(abs(got[i] - v) < 1e-8 for i, v in enumerate(want))
    assert (noise < 1) == (len(losses) == cfg.n_estimators)  # noise is stopped early
    odd = spark.createDataFrame([([None, 1.0, 1.0], 1.0, True), (None, 1.0, True), ([1.0, 1.0, 1.0], None, True)], "features array<double>, y double, train boolean")
    assert boosting.fit(odd.where("y IS NULL"), cfg)[0].count() == 0
    assert {r.value for r in boosting.fit(odd, cfg)[0].where("feature IS NULL AND tree = 0").collect()} == {1.0}


def test_model_versions(spark, tmp_path):
    root = f"{tmp_path}/models"
    table = spark.createDataFrame([("m", 0, 0, None, None, None, None, 0.1 + 0.2), ("m", 1, 0, 2, 1e-300, 1, 2, None), ("m", 1, 1, None, None, None, None, -0.0), ("m", 1, 2, None, None, None, None, 5e-324)], trees.NODES)
    with pytest.raises(FileNotFoundError):
        models.load(spark, root, "m")
    assert models.save(table, root, "m") == 1 and models.save(table.limit(1), root, "m") == 2
    assert models.versions(spark, root, "m") == [1, 2] and models.load(spark, root, "m").count() == 1
    back = models.load(spark, root, "m", 1)
    bits = lambda df: sorted((r.tree, r.node, r.feature or 0, *(np.float64(v if v is not None else 7.0).tobytes() for v in (r.threshold, r.value))) for r in df.collect())
    assert bits(back) == bits(table)
    with pytest.raises(Exception, match="broken"):
        models.save(table.withColumn("value", F.raise_error(F.lit("broken")).cast("double")), root, "m")
    assert models.versions(spark, root, "m") == [1, 2] and models.load(spark, root, "m").count() == 1
    with pytest.raises(FileNotFoundError):
        models.load(spark, root, "m", 9)
