"""Price momentum and weekly returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.functions.exprs import week_start, z_safe
from weekloom.operators.calendar import snapshots


def price_momentum(prices: DataFrame, window: int = 5) -> DataFrame:
    """Close less the close ``window`` rows earlier, for each code."""
    return prices.withColumn("momentum", F.col("close") - F.lag("close", window).over(W.partitionBy("code").orderBy("d")))


def etf_weekly_return(prices: DataFrame) -> DataFrame:
    """(code, ws, week_open, week_close, weekly_return) from the first and last close of a week."""
    rows = prices.groupBy("code", week_start(F.col("d")).alias("ws")).agg(F.min_by("close", "d").alias("week_open"), F.max_by("close", "d").alias("week_close"))
    return rows.withColumn("weekly_return", z_safe(F.col("week_close") - F.col("week_open"), F.col("week_open")))


def weekly_code_returns(prices: DataFrame, horizon: str = "week") -> DataFrame:
    """(ws, industry, code, r) between the market's two snapshot dates of a week; a code without a
    price on either date drops out."""
    s = F.broadcast(snapshots(prices, horizon))  # a row a week
    last = prices.join(s, F.col("d") == F.col("l")).select("ws", "industry", "code", F.col("close").alias("close_curr"))
    first = prices.join(s, F.col("d") == F.col("p")).select("ws", "code", F.col("close").alias("close_prev")).distinct()
    return last.join(first, ["ws", "code"]).select("ws", "industry", "code", z_safe(F.col("close_curr") - F.col("close_prev"), F.col("close_prev")).alias("r"))


def weekly_industry_returns(prices: DataFrame, horizon: str = "week") -> DataFrame:
    """(ws, industry, r, n): equal-weight mean over the industry's codes."""
    return weekly_code_returns(prices, horizon).groupBy("ws", "industry").agg(F.avg("r").alias("r"), F.count(F.lit(1)).alias("n"))


def weekly_industry_grid(prices: DataFrame, industries: DataFrame, horizon: str = "week") -> DataFrame:
    """The same for every week and listed industry; without a code the return is 0."""
    weeks = prices.select(week_start(F.col("d")).alias("ws")).distinct()
    grid = weeks.join(F.broadcast(industries.select("industry").distinct()))  # the listed industries
    return grid.join(weekly_industry_returns(prices, horizon), ["ws", "industry"], "left").select("ws", "industry", F.coalesce("r", F.lit(0.0)).alias("r"))


def portfolio_returns(holdings: DataFrame, industry_returns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(weekly, contributions) of holdings (ws, industry, w) held in the week ``ws``: industries
    without a return are left out, cash earns nothing."""
    parts = holdings.join(industry_returns.select("ws", "industry", "r"), ["ws", "industry"]).select("ws", "industry", (F.col("w") * F.col("r")).alias("contribution"))
    return parts.groupBy("ws").agg(F.sum("contribution").alias("r")), parts
