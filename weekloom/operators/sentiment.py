"""Sentiment and volume by period and industry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.functions.exprs import EPS, period_start, strict_map

# Fixed values.
SCORES = {"negative": -1.0, "neutral": 0.0, "positive": 1.0}


def scored(news: DataFrame, strict: bool = True) -> DataFrame:
    """``news`` with the number of its sentiment; an unknown word raises, or is null."""
    return news.withColumn("score", strict_map(F.col("sentiment"), SCORES, strict))


def build(news: DataFrame, freq: str = "week", industry_col: str = "major_category") -> DataFrame:
    """(period, industry, sentiment_mean, news_count): the confidence-weighted mean, null terms left
    out of numerator and denominator each, and the number of rows; one aggregation."""
    rows = scored(news)
    weighted = F.coalesce(F.sum(F.col("score") * F.col("sentiment_confidence")), F.lit(0.0))
    weight = F.coalesce(F.sum("sentiment_confidence"), F.lit(0.0))
    return rows.groupBy(period_start(F.col("datetime"), freq).alias("period"), F.col(industry_col).alias("industry")).agg((weighted / (weight + EPS)).alias("sentiment_mean"), F.count(F.lit(1)).alias("news_count"))


def grid(series: DataFrame) -> DataFrame:
    """Every period that occurs with every industry: no news is a null mean and a count of 0."""
    cells = series.select("period").distinct().join(F.broadcast(series.select("industry").distinct()))  # periods x industries is the result's size
    rows = cells.join(series, ["period", "industry"], "left")
    return rows.select("period", "industry", "sentiment_mean", F.coalesce("news_count", F.lit(0)).cast("long").alias("news_count"))


#: Columns that a pivot makes at most.
PIVOT_COLUMNS = 5000


def pivoted(series: DataFrame, values: list[str] | None = None, col: str = "sentiment_mean") -> DataFrame:
    """Wide: a column for each of ``values``, or for each industry in order. Over ``PIVOT_COLUMNS`` industries raise; a
    null industry has no column."""
    if values is None:
        values = [r[0] for r in series.where("industry IS NOT NULL").select("industry").distinct().orderBy("industry").limit(PIVOT_COLUMNS + 1).collect()]
        if len(values) > PIVOT_COLUMNS:
            raise ValueError(f"over {PIVOT_COLUMNS} industries: name those to pivot")
    return series.groupBy("period").pivot("industry", values).agg(F.first(col))


def unpivoted(wide: DataFrame, value: str = "sentiment_mean") -> DataFrame:
    """Long again; empty cells stay as null rows."""
    return wide.unpivot("period", [c for c in wide.columns if c != "period"], "industry", value)


def summary(series: DataFrame) -> DataFrame:
    """One row: cells, periods, industries, first and last period."""
    return series.agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("period").alias("periods"), F.countDistinct("industry").alias("industries"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))
