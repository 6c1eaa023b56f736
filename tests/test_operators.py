"""Rules of the analytics operators on small tables, with the answers worked out by hand or by a
plain loop."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weekloom import config, schemas
from weekloom.functions import exprs as X
from weekloom.functions import text as T
from weekloom.operators import calendar, features, labeling, metrics, portfolio, retrieval, returns, risk, scoring, sentiment, splits, taxonomy
from weekloom.plans import backtest
from weekloom.sources import files

D = dt.date


def test_clip_keeps_null_and_nan(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (5.0,), (-5.0,), (0.25,)], "x double").select(X.clip(F.col("x"), -1, 1).alias("y")).collect()
    assert rows[0].y is None and rows[1].y != rows[1].y
    assert [r.y for r in rows[2:]] == [1.0, -1.0, 0.25]


def test_change_expressions(spark):
    r = spark.range(1).select(
        X.momentum(F.lit(0.3), F.lit(0.2)).alias("m"), X.heat(F.lit(9), F.lit(4)).alias("h"), X.direction(F.lit(0.11)).alias("up"), X.direction(F.lit(-0.1)).alias("flat"),
        X.status(F.lit(0.0)).alias("s"), X.date_key(F.lit("2024-03-01").cast("date")).alias("k"), X.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("a"), X.iterations(F.lit(900), 20).alias("n"),
    ).first()
    assert abs(r.m - 0.5) < 1e-6 and r.h == 1.0 and (r.up, r.flat, r.s, r.k, r.a, r.n) == (1, 0, "LOSS", 20240301, 1, 10)


def test_strict_map_raises_on_unknown(spark):
    df = spark.createDataFrame([("positive",), ("odd",)], "sentiment string")
    assert [r.score for r in sentiment.scored(df, strict=False).collect()] == [1.0, None]
    with pytest.raises(Exception, match="unknown value"):
        sentiment.scored(df).collect()


def test_texts(spark):
    rows = spark.createDataFrame([("t", "c" * 300), (None, "body"), ("only", None), ("", ""), (None, None)], "title string, content string")
    got = rows.select(T.model_text(F.col("title"), F.col("content")).alias("m"), T.training_text(F.col("title"), F.col("content")).alias("t"), T.trimmed_text(F.col("title"), F.col("content")).alias("o")).collect()
    assert [r.m for r in got] == ["t [SEP] " + "c" * 256, "body", "", "", ""]
    assert [r.t for r in got] == ["t[SEP]" + "c" * 256, "[SEP]body", "only", "", ""]
    assert [r.o for r in got] == ["t [SEP] " + "c" * 256, "body", "only", "", ""]
    words = spark.createDataFrame([("上涨 大涨 风险",), ("none",), ("亏损",)], "x string").select(T.keyword_sentiment(F.col("x")).alias("s")).collect()
    assert [round(r.s, 6) for r in words] == [round(1 / 3, 6), 0.0, -1.0]


def test_weighted_sentiment_skips_null_terms(spark):
    rows = [(dt.datetime(2024, 1, 3), "a", "positive", 0.5), (dt.datetime(2024, 1, 4), "a", "negative", None), (dt.datetime(2024, 1, 7), "a", "negative", 0.25), (dt.datetime(2024, 1, 8), "b", "neutral", None)]
    news = spark.createDataFrame(rows, schemas.NEWS_LABELED)
    got = {(r.period, r.industry): (round(r.sentiment_mean, 6), r.news_count) for r in sentiment.build(news).collect()}
    assert got == {(D(2024, 1, 1), "a"): (round(0.25 / 0.75, 6), 3), (D(2024, 1, 8), "b"): (0.0, 1)}
    cells = sentiment.grid(sentiment.build(news))
    assert cells.count() == 4 and cells.where("news_count = 0").count() == 2
    wide = sentiment.pivoted(sentiment.build(news), ["a", "b"])
    assert sentiment.unpivoted(wide).count() == 4


def prices(spark):
    days = [D(2024, 1, 4), D(2024, 1, 5), D(2024, 1, 10), D(2024, 1, 12), D(2024, 1, 19)]
    close = {"x": [10.0, 20.0, 22.0, 24.0, 12.0], "y": [1.0, 2.0, 2.0, 1.0, 3.0]}
    rows = [("tech" if c == "x" else "food", c, d, p) for c, ps in close.items() for d, p in zip(days, ps, strict=True)]
    return spark.createDataFrame(rows, schemas.PRICES)


def test_weekly_returns_in_both_modes(spark):
    week = {(r.ws, r.industry): round(r.r, 6) for r in returns.weekly_industry_returns(prices(spark)).collect()}
    assert week == {(D(2024, 1, 8), "tech"): 0.2, (D(2024, 1, 8), "food"): -0.5, (D(2024, 1, 15), "tech"): -0.5, (D(2024, 1, 15), "food"): 2.0}
    end = {(r.ws, r.industry): round(r.r, 6) for r in returns.weekly_industry_returns(prices(spark), "end_of_data").collect()}
    assert end[D(2024, 1, 8), "tech"] == round(12 / 20 - 1, 6)
    with pytest.raises(ValueError, match="horizon"):
        calendar.snapshots(prices(spark), "month")


def slow_backtest(weeks, decisions, rets, capital=1e6, fee=0.0008):
    nav, held, out = capital, {}, []
    for ws in weeks:
        r = sum(w * rets.get((ws, i), 0.0) for i, w in held.items())
        nav *= 1 + r
        out.append((ws, round(nav, 4), round(sum(held.values()), 6)))
        if rows := decisions.get(ws):
            target = {i: w if a in ("buy", "hold") and w > 0 else 0.0 for i, a, w in rows}
            total = sum(target.values())
            target = {i: w / total if total > 1 else w for i, w in target.items()}
            nav *= 1 - fee * sum(abs(target.get(i, 0.0) - held.get(i, 0.0)) for i in {*target, *held})
            held = {i: w for i, w in target.items() if w > 0.001}
    return out


def test_backtest_against_a_loop(spark):
    made = {D(2024, 1, 1): [("tech", "buy", 0.9), ("food", "buy", 0.6)], D(2024, 1, 8): [("food", "hold", 0.4), ("tech", "sell", 0.5)]}
    decisions = spark.createDataFrame([(ws, *r) for ws, rows in made.items() for r in rows], schemas.DECISIONS)
    got = [(r.ws, round(r.nav, 4), round(r.invested_weight, 6)) for r in backtest.run(prices(spark), decisions).orderBy("ws").collect()]
    rets = {(r.ws, r.industry): r.r for r in returns.weekly_industry_returns(prices(spark)).collect()}
    assert got == slow_backtest([D(2024, 1, 1), D(2024, 1, 8), D(2024, 1, 15)], made, rets)
    m = metrics.performance(backtest.run(prices(spark), decisions)).first()
    assert m["weeks"] == 3 and m["max_drawdown"] <= 0


def test_rules(spark):
    ws = D(2024, 1, 8)
    decided = spark.createDataFrame([(ws, "a", "buy", 0.5), (ws, "b", "buy", 0.2), (ws, "c", "buy", 0.4), (ws, "d", "sell", 0.9)], schemas.DECISIONS)
    tax = spark.createDataFrame([("L", "a", "i", "very_high", "k"), ("L", "b", "j", "low", "k"), ("L", "c", "m", "low", "unknown")], schemas.TAXONOMY)
    held = spark.createDataFrame([(ws, "b")], "ws date, industry string")
    pnl = spark.createDataFrame([(ws, -0.01)], "ws date, r double")
    broken = risk.violations(decided, tax, held, pnl)
    assert {(r.rule, r.subject) for r in broken.collect()} == {("max_weight", "a"), ("max_weight", "c"), ("max_total", "all"), ("beta", "a"), ("mirror", "k")}
    text = risk.error_text(broken).first().last_error
    assert text.startswith("[a] weight 0.500") and "Total weight 1.100" in text
    steps = spark.range(1).select(risk.route(F.lit(False), F.lit("[Beta Penalty] no")).alias("r"), risk.route(F.lit(True), F.lit("")).alias("e"), risk.next_step(F.lit(6), F.lit(True)).alias("n"), risk.accepted(F.lit(False), F.lit(3)).alias("a")).first()
    assert (steps.r, steps.e, steps.n, steps.a) == ("researcher", "end", "finalize", True)


def test_sequences_have_no_look_ahead(spark):
    rows = [(D(2024, 1, 1) + dt.timedelta(i), "a", float(i), 10 + i) for i in range(9)]
    series = spark.createDataFrame(rows, schemas.SENTIMENT)
    got = {r.period: r.sequence for r in features.sequences(series).collect()}
    assert got and all(list(seq) == [float((p - D(2024, 1, 1)).days - k) for k in range(5, 0, -1)] for p, seq in got.items())
    changed = features.changes(series).orderBy("period").collect()
    assert changed[0].momentum is None and round(changed[1].news_heat, 6) == round(1 / 11, 6)
    scored = {r.industry: r for r in scoring.scores(features.changes(series), spark.createDataFrame([("a",), ("z",)], "industry string")).collect()}
    assert scored["a"].momentum_score == 1.0 and scored["z"].composite_score == 0.0


def test_taxonomy_and_funds(spark):
    doc = '{"L": {"s": {"indices": ["i", "j"], "beta": "high"}, "u": {"indices": ["k"], "correlation_cluster": "c"}}}'
    tax = files.taxonomy_from_json(spark.createDataFrame([(doc,)], "value string"))
    assert {(r.small_cat, r.index_name, r.beta, r.correlation_cluster) for r in tax.collect()} == {("s", "i", "high", "s"), ("s", "j", "high", "s"), ("u", "k", "medium", "c")}
    info = spark.createDataFrame([(1, "f", "i", 5.0), (2, "g", "i", 5.0), (3, "h", "i", None), (4, "n", "k", None)], schemas.ETF_INFO)
    assert {(r.tracking_index, r.code) for r in taxonomy.best_etf(info).collect()} == {("i", 1), ("k", 4)}
    names = spark.createDataFrame([(0, "i"), (1, "j"), (2, "nowhere")], "pos int, index_name string")
    assert [(r.first, r.second) for r in taxonomy.cluster_conflicts(names, tax).collect()] == [("i", "j")]
    assert taxonomy.index_info(names, tax).where("beta = 'medium'").count() == 1


def test_similar_texts_against_plain_python(spark):
    import math
    import re
    from collections import Counter

    texts = {1: "oil price up again", 2: "price of oil", 3: "weather is fine", 4: ""}
    query = "oil price"
    docs = {i: Counter(re.findall(r"\w{2,}", t)) for i, t in texts.items()}
    df = Counter(w for c in docs.values() for w in c)
    idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items()}
    vec = lambda c: {w: n * idf[w] for w, n in c.items() if w in idf}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    q = vec(Counter(query.split()))
    want = {i: round(sum(x * q.get(w, 0) for w, x in vec(c).items()) / norm(vec(c)) / norm(q), 6) if c else 0.0 for i, c in docs.items()}
    got = {r.id: round(r.similarity, 6) for r in retrieval.similar(spark.createDataFrame(list(texts.items()), "doc_id long, t string"), query, 4, "doc_id", "t").collect()}
    assert got == want


def test_labels_and_splits(spark):
    rows = spark.createDataFrame([("m", "b", i) for i in range(10)] + [("m", "a", i) for i in range(10, 30)] + [("solo", "x", 40)], "major string, sub string, id long")
    assert {(r.major, r["sub"], r.idx) for r in labeling.label_index(rows, "major", "sub").select("major", "sub", "idx").collect()} == {("m", "a", 0), ("m", "b", 1), ("solo", "x", 0)}
    assert [r.major for r in labeling.trainable(rows, "major", "sub").collect()] == ["m"]
    part = {(r["sub"], r.part): r["count"] for r in splits.stratified(rows, "sub", "id", 0.2).groupBy("sub", "part").count().collect()}
    assert part[("a", "val")] == 4 and part[("b", "val")] == 2
    assert splits.by_time(rows, ("id",)).where("part = 'test'").count() == 31 - int(31 * 0.8)


def test_metrics(spark):
    rows = spark.createDataFrame([("a", float(i), float(2 * i)) for i in range(5)] + [("b", 1.0, 3.0)] * 4 + [("c", 1.0, 2.0)], "g string, y_true double, y_pred double")
    ic = {r.g: r.ic for r in metrics.group_ic(rows, "g").collect()}
    assert abs(ic["a"] - 1) < 1e-9 and ic["b"] is None and ic["c"] is None


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.csv").write_text("a,b\n1,x\n2,y\n")
    got = files.csv_to_parquet(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert [(r.name, r["rows"]) for r in got] == [("one", 2)]
    assert files.read_parquet(spark, str(tmp_path / "none"), schemas.DECISIONS, missing="empty").count() == 0
    with pytest.raises(Exception):
        files.read_parquet(spark, str(tmp_path / "none"))
    built = []
    build = lambda: built.append(1) or spark.range(3).toDF("x")
    assert files.cached_table(spark, str(tmp_path / "c"), build).count() == 3 and files.cached_table(spark, str(tmp_path / "c"), build).count() == 3 and len(built) == 1
    one = spark.createDataFrame([(D(2024, 1, 1), "a", 0.1)], schemas.WEEKLY_RETURNS)
    files.append_weekly_returns(one, str(tmp_path / "w"))
    files.append_weekly_returns(one, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 2
    stats = files.label_statistics(spark.createDataFrame([('{"major_category": {"m": 3}, "sub_category_by_major": {"m": {"s": 2}}}',)], "value string"))
    assert {(r.major, r["sub"], r.n) for r in stats.collect()} == {("m", None, 3), ("m", "s", 2)}


def test_schema_checks_and_settings(spark, tmp_path):
    df = spark.range(1)
    with pytest.raises(ValueError, match="missing columns: nope"):
        schemas.require_columns(df, "id", "nope")
    assert schemas.with_defaults(df, id=5, extra=1.5).first().extra == 1.5
    assert schemas.column_like(df, "i") == "id"
    (tmp_path / "c.toml").write_text('[b]\nslippage = 0.1\n')
    assert config.load(str(tmp_path / "c.toml"), "b", config.BacktestConfig()).slippage == 0.1
    (tmp_path / "d.toml").write_text("[b]\nodd = 1\n")
    with pytest.raises(ValueError, match="odd"):
        config.load(str(tmp_path / "d.toml"), "b", config.BacktestConfig())
    assert portfolio.turnover and labeling.selected  # the public names stay


def test_stratified_counts_null_labels_and_bears_empty_tables(spark):
    rows = spark.createDataFrame([(None, i) for i in range(20)] + [("a", i) for i in range(20, 60)], "sub string, id long")
    part = {(r["sub"], r.part): r["count"] for r in splits.stratified(rows, "sub", "id", 0.2).groupBy("sub", "part").count().collect()}
    assert part == {(None, "val"): 4, (None, "train"): 16, ("a", "val"): 8, ("a", "train"): 32}
    assert splits.stratified(rows.limit(0), "sub", "id").count() == 0


def test_rendered_news_is_a_row_an_article(spark):
    rows = spark.createDataFrame([(1, D(2024, 1, 9), "t1", "s"), (2, D(2024, 1, 10), None, None), (3, D(2024, 1, 9), "t3", "s")], "doc_id long, d date, title string, source string")
    got = [(r.rank, r.doc_id, r.text, r.n) for r in retrieval.rendered(rows).orderBy("rank").collect()]
    assert got == [(1, 2, "2024-01-10 |  | ", 3), (2, 3, "2024-01-09 | s | t3", 3), (3, 1, "2024-01-09 | s | t1", 3)]
    assert retrieval.rendered(rows.limit(0)).count() == 0
