"""News labels whose logits tie, and news without an id, against the query's SQL."""

import numpy as np
import pytest

from weekloom import model_queries as M
from weekloom.operators import inference

# Counts of e, n, i, u, é and characters in all, at which a class's own model gives two sub-categories all but the same value.
TIED = [
    (30, 4, 24, 22, 2, 132), (9, 33, 25, 19, 5, 213), (3, 17, 27, 15, 7, 93), (6, 29, 26, 13, 12, 129), (37, 6, 31, 22, 4, 216), (38, 27, 26, 19, 15, 129), (34, 13, 12, 21, 2, 171), (21, 37, 26, 29, 2, 156),
    (11, 39, 30, 26, 5, 120), (34, 33, 3, 0, 39, 180), (26, 10, 22, 6, 27, 135), (23, 5, 10, 3, 15, 210), (26, 19, 9, 14, 16, 150), (4, 30, 4, 2, 19, 120), (22, 39, 5, 5, 31, 195), (37, 19, 14, 4, 35, 180),
    (31, 24, 12, 1, 11, 222), (25, 37, 2, 6, 13, 180), (32, 37, 8, 6, 15, 237), (26, 8, 4, 2, 2, 240), (12, 35, 10, 2, 13, 81), (39, 38, 10, 10, 22, 153), (36, 35, 0, 15, 18, 174), (11, 33, 5, 6, 9, 165),
]


def test_ties_and_null_ids_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    text = lambda n: "\n" + "".join(c * k for c, k in zip("eniué", n)) + "x" * (n[5] - sum(n[:5]))
    rows = [(i, text((*n[:5], n[5] - 1)), "en", "s") for i, n in enumerate(TIED, 1) if i % 11] + [(None, text(TIED[0]), "en", "s"), (11, "none", "en", "s"), (12, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = M.news_labels(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(M.query.__globals__["ORACLES"]["news_labels"])
    names = [d[0] for d in cur.description]
    want = [tuple(r[names.index(c)] for c in got[0].asDict()) for r in cur.fetchall()]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_linear_rows_add_in_order():
    rng = np.random.default_rng(3)
    w, b = (rng.integers(-6, 7, (4, 6)) / 10).tolist(), [0.1, -0.2, 0.3, 0.0]
    x = rng.integers(0, 300, (500, 6)) / 10
    want = []
    for row in x.tolist():
        out = []
        for o, c in zip(w, b):
            total = 0.0
            for p, q in zip(o, row):
                total += p * q
            out.append(total + c)
        want.append(out)
    assert inference.linear_rows(w, b, x).tolist() == want
    assert np.concatenate([inference.linear_rows(w, b, x[i : i + 1]) for i in range(500)]).tolist() == want
