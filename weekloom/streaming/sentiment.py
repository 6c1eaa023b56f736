"""Weekly sentiment over a stream of labelled news; an extension of the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.functions.exprs import EPS
from weekloom.operators.sentiment import scored


def weekly(news: DataFrame, delay: str = "7 days") -> DataFrame:
    """(period, industry, sentiment_mean, news_count) of a streaming ``news`` whose datetime is a
    timestamp. Windows begin on Mondays (epoch weeks begin on Thursdays: four days' offset); rows later
    than ``delay`` after the watermark are left out."""
    rows = scored(news).withWatermark("datetime", delay)
    weeks = F.window("datetime", "7 days", "7 days", "4 days")
    weighted = F.coalesce(F.sum(F.col("score") * F.col("sentiment_confidence")), F.lit(0.0))
    weight = F.coalesce(F.sum("sentiment_confidence"), F.lit(0.0))
    agg = rows.groupBy(weeks.alias("w"), F.col("major_category").alias("industry")).agg((weighted / (weight + EPS)).alias("sentiment_mean"), F.count(F.lit(1)).alias("news_count"))
    return agg.select(F.col("w.start").cast("date").alias("period"), "industry", "sentiment_mean", "news_count")
