"""Strict casts, percent texts, calendars, pivots and the streaming form."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weekloom.functions import exprs
from weekloom.operators import calendar, labeling, retrieval, sentiment, taxonomy
from weekloom.streaming import sentiment as stream


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_strict_casts_and_percent(spark):
    assert [one(spark, v, "string", exprs.strict_double) for v in ("1.5", "-2e3", " 7 ", None)] == [1.5, -2000.0, 7.0, None]
    assert one(spark, "2024-01-02 03:04:05", "string", exprs.strict_timestamp) == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, "02/01/2024", "string", lambda x: exprs.strict_timestamp(x, "dd/MM/yyyy")) == dt.datetime(2024, 1, 2)
    assert one(spark, None, "string", exprs.strict_timestamp) is None
    assert [one(spark, v, "double", exprs.percent) for v in (0.12345, -1.0, 0.0, None)] == ["12.35%", "-100.00%", "0.00%", None]
    for bad, f in (("1,5", exprs.strict_double), ("", exprs.strict_double), ("soon", exprs.strict_timestamp), ("2024-13-01", exprs.strict_timestamp)):
        with pytest.raises(Exception, match="not a"):
            one(spark, bad, "string", f)


def test_weeks_of(spark):
    rows = spark.createDataFrame([(dt.date(2024, 1, 3),), (None,), (dt.date(2024, 1, 22),)], "d date")
    assert [r.ws for r in calendar.weeks_of(rows, "d").orderBy("ws").collect()] == [dt.date(2024, 1, d) for d in (1, 8, 15, 22)]
    assert calendar.weeks_of(rows.where("false"), "d").count() == 0


def test_pivot_by_data(spark):
    day = dt.date(2024, 1, 1)
    rows = spark.createDataFrame([(day, "b", 1.0), (day, "a", None), (day, None, 3.0), (dt.date(2024, 1, 2), "c", 2.0)], "period date, industry string, sentiment_mean double")
    wide = sentiment.pivoted(rows)
    assert wide.columns == ["period", "a", "b", "c"] and sentiment.unpivoted(wide).count() == 6
    was, sentiment.PIVOT_COLUMNS = sentiment.PIVOT_COLUMNS, 2
    with pytest.raises(ValueError, match="industries"):
        sentiment.pivoted(rows)
    sentiment.PIVOT_COLUMNS = was


def test_similar_edges(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, None), (3, ""), (4, "fox fox Fox"), (5, "x")], "id long, text string").repartition(3)
    got = [(r.id, round(r.similarity, 6)) for r in retrieval.similar(docs, "FOX", 9).collect()]
    assert [i for i, _ in got] == [4, 1, 2, 3, 5] and got[0][1] == 1.0 and got[2][1] == 0.0
    assert retrieval.similar(docs, " ", 9).count() == 0 and retrieval.similar(docs.where("false"), "fox", 9).count() == 0
    assert {s for _, s in ((r.id, r.similarity) for r in retrieval.similar(docs, "nothing known", 9).collect())} == {0.0}


def test_streaming_weeks(spark, tmp_path):
    monday = dt.datetime(2024, 1, 1)
    rows = [(monday + dt.timedelta(days=d, hours=1), "a" if d % 2 else "b", ["negative", "neutral", "positive"][d % 3], d / 20) for d in range(20)]
    schema = "datetime timestamp, major_category string, sentiment string, sentiment_confidence double"
    source = str(tmp_path / "news")
    for part in (rows[:8], rows[8:14], rows[14:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    # a row weeks later moves the watermark past all others; one far too late is left out
    spark.createDataFrame([(monday + dt.timedelta(days=90), "a", "neutral", 0.5)], schema).coalesce(1).write.mode("append").parquet(source)
    found = stream.weekly(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    q = found.writeStream.format("memory").queryName("weeks").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.period, r.industry, round(r.sentiment_mean, 9), r.news_count) for r in spark.table("weeks").collect())
    want = sorted((r.period, r.industry, round(r.sentiment_mean, 9), r.news_count) for r in sentiment.build(spark.createDataFrame(rows, schema), "week").collect())
    assert got == want


def test_attached_by_place(spark):
    rows = spark.createDataFrame([(i * 7 % 100, f"r{i}") for i in range(100)], "k long, name string").repartition(5)
    values = spark.createDataFrame([(i, i / 2) for i in range(100)], "place int, v double").repartition(3)
    got = labeling.attached(rows, ("k",), values, ("place",)).collect()
    assert len(got) == 100 and all(r.v == r.k / 2 for r in got)
    with pytest.raises(ValueError, match="go together"):
        labeling.attached(rows, ("k",), values.limit(9), ("place",))


def test_best_etf_cache(spark, tmp_path):
    funds = spark.createDataFrame([(1, "a", "i", 5.0), (2, "b", "i", 7.0), (3, "c", "j", None)], "code long, name string, tracking_index string, aum double")
    path = str(tmp_path / "best.parquet")
    codes = lambda df: sorted(r.code for r in df.collect())
    assert codes(taxonomy.best_etf_cached(spark, path, funds)) == [2, 3]
    assert codes(taxonomy.best_etf_cached(spark, path, funds.where("code = 1"))) == [2, 3]  # as it is there
    assert codes(taxonomy.best_etf_cached(spark, path, funds.where("code = 1"), force=True)) == [1]
