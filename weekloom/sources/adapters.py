"""The driver's tables in the roles of news, prices, funds, taxonomy, decisions and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weekloom.operators import returns
from weekloom.sources.files import read_parquet
from weekloom.sources.shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def news_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    sentiment = F.when(v < 20, "negative").when(v < 54, "neutral").otherwise("positive")
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").alias("datetime"), F.col("event_type").alias("major_category"), sentiment.alias("sentiment"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("sentiment_confidence"))


def news_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    return d.select("doc_id", day.alias("d"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.when(F.col("doc_id") % 11 == 0, None).otherwise(F.col("text")).alias("content"), "source")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("r_name").alias("industry"), F.col("n_name").alias("code"), F.col("l_shipdate").cast("date").alias("d")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prices``, rolled up once for plans that read them several times."""
    return written(prices(spark, sf_dir), "closes")


def etf_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_type").alias("tracking_index"), F.when(F.col("p_partkey") % 97 != 0, F.col("p_retailprice")).alias("aum"))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    beta = F.when(k % 4 == 0, "very_high").when(k % 4 == 1, "high").when(k % 4 == 2, "medium").otherwise("low")
    cluster = F.when(k % 7 == 6, "unknown").otherwise(F.concat(F.lit("c"), (k % 7).cast("string")))
    return n.select(F.col("r_name").alias("large_cat"), F.col("n_name").alias("small_cat"), F.col("n_name").alias("index_name"), beta.alias("beta"), cluster.alias("correlation_cluster"))


def industry_returns(daily: DataFrame) -> DataFrame:
    """(ws, industry, r) of daily closes, a few rows a week, for plans that read them several times."""
    return written(returns.weekly_industry_returns(daily).select("ws", "industry", "r"), "returns")


def weekly_returns(daily: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(ws, industry, r), scaled so that 1 + r stays positive."""
    r = returns.weekly_industry_returns(daily) if found is None else found
    return r.select("ws", "industry", (F.col("r") / 100).alias("r"))


def decisions(daily: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """From daily closes (or from their industry returns). Sums of buys above one, a zero-weight hold, a sell, and weeks without rows."""
    ranked = weekly_returns(daily, found).withColumn("k", F.row_number().over(W.partitionBy("ws").orderBy(F.desc("r"), "industry")))
    k = F.col("k")
    action = F.when(k <= 3, "buy").when(k == 4, "hold").otherwise("sell")
    weight = F.when(k == 1, 0.5).when(k == 2, 0.4).when(k == 3, 0.3).when(k == 4, 0.0).otherwise(0.2)
    # read many times over by the backtest and the rules
    return written(ranked.where(F.dayofmonth("ws") % 5 != 0).select("ws", "industry", action.alias("action"), weight.alias("weight")), "decisions")


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id").select("doc_id", "lang", (F.col("doc_id") % 100).cast("int").alias("day_no"), F.col("quality").cast("double").alias("y_true"), (F.length("source") + F.col("n_chars") % 10).cast("double").alias("y_pred"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("z", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", "label", F.slice("z", 1, 8).alias("l1_logits"), F.slice("z", 9, 3).alias("sent_logits"))
