"""Water-filling by the round-by-round procedure, and the sample's totals."""

import random

from pyspark.sql import functions as F

from weekloom.llm import mixing


def slow_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, capped, left = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return target | share
        for s in over:
            capped.add(s)
            target[s] = float(cap * sizes[s])
            left -= cap * sizes[s]


def test_targets_and_totals(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "b", "c", "hot", "hot", "hot", "é", None])) for i in range(400)]
    rows += [(1000, None, "b"), (None, "x y z", "c"), (5, rows[5][1], rows[5][2]), (1001, "big " * 50_000, "hot"), (1002, "", "empty")]
    rows += [(7, "w " * (i % 9 + 1), "hot") for i in range(60)] + [(None, "v " * (i % 11 + 1), "hot") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("order", F.lit(1))
    got = mixing.mix(docs).collect()
    sizes, taken, biggest = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        biggest[r.source] = max(biggest.get(r.source, 0), r["size"])
    want = slow_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and r.taken <= 3 * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s] / 2 + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_mixed_rows(spark):
    docs = spark.createDataFrame([(i, "one two three", f"s{i % 3}", i) for i in range(60)], "doc_id long, text string, source string, n long")
    want = {r.id: r.times for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in want.items() if v}
    assert mixing.mix(docs.limit(0)).count() == 0
