"""Plans of the learned models: what a row costs does not multiply."""

from pyspark.sql import functions as F

from weekloom.operators import boosting, forest


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gradients_are_made_before_rows_are_multiplied(spark):
    rows = spark.createDataFrame([([1, 2], 1.0, True, 0.5), ([0, 2], 2.0, True, 0.25), ([1, 1], 3.0, False, 0.0)], "bins array<int>, y double, train boolean, sum double")
    node = F.when(F.get("bins", F.lit(0)) <= 0, F.lit(None)).otherwise(F.lit(3)).cast("int")
    each = boosting._each(rows, node)
    assert sorted((r.node, float(r.g), r.f, r.b) for r in each.collect()) == [(3, -0.5, 0, 1), (3, -0.5, 1, 2)]
    plan = _plan(each)
    assert plan.index("Generate") < plan.index(" AS g#")  # the generator stands above


def test_trees_are_drawn_by_compiled_steps(spark):
    rows = spark.range(3000).select("id", F.array(F.col("id").cast("double")).alias("features"))
    cfg = forest.ForestConfig(trees=5, sample=40)
    found = forest.subsamples(rows, 3000, cfg, ("id",))
    assert "lambda" not in _plan(found)
    got = {}
    for r in found.collect():
        got.setdefault(r.tree, []).append((r.place, r.features[0]))
    hashed = rows.select("id", *(F.pmod(F.xxhash64("id", F.lit(cfg.seed), F.lit(t)), F.lit(1 << 40)).alias(f"t{t}") for t in range(5))).collect()
    for t in range(5):
        want = [float(r.id) for r in sorted(hashed, key=lambda r: (r[f"t{t}"], r.id))[:40]]
        assert [x for _, x in sorted(got[t])] == want
