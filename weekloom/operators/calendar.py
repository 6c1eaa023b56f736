"""Weeks, ranges and snapshot dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.functions.exprs import week_start


def mondays(spark: SparkSession, start: str, end: str) -> DataFrame:
    """``ws`` for every Monday from the week of ``start`` to ``end``, both included."""
    one = spark.range(1)
    first, last = week_start(F.lit(start).cast("date")), F.lit(end).cast("date")
    return one.select(F.explode(F.sequence(first, last, F.expr("interval 7 days"))).alias("ws"))


def weeks_of(df: DataFrame, col: str) -> DataFrame:
    """``ws`` for every Monday from the week of the earliest date to the latest date, with or without rows; none for an
    empty table."""
    ends = df.agg(week_start(F.min(col)).alias("a"), F.max(col).cast("date").alias("b")).where("a IS NOT NULL")
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("ws"))


def in_week(df: DataFrame, col: str, monday: str) -> DataFrame:
    """Rows dated from a Monday to the Sunday after it; a range filter that reaches the scan."""
    ws = F.lit(monday).cast("date")
    return df.where(F.col(col).cast("date").between(ws, F.date_add(ws, 6)))


def first_weeks(df: DataFrame, col: str, weeks: int = 100) -> DataFrame:
    """Rows in [earliest, earliest + weeks): one row of aggregate joins all."""
    least = df.agg(F.min(col).alias("__least"))
    return df.join(F.broadcast(least), (F.col(col) >= F.col("__least")) & (F.col(col) < F.date_add(F.col("__least").cast("date"), 7 * weeks))).drop("__least")


def snapshots(prices: DataFrame, horizon: str = "week") -> DataFrame:
    """(ws, p, l): for each week with prices, the last date before it and its closing date over the
    whole market: the week's own last date, or with ``end_of_data`` the table's last date.

    A week's last earlier date is the last date of the week with prices before it, so one
    aggregation and a lag over the weeks do; no week meets all dates."""
    if horizon not in ("week", "end_of_data"):
        raise ValueError(f"horizon is week or end_of_data, not {horizon}")
    weeks = prices.groupBy(week_start(F.col("d")).alias("ws")).agg(F.max("d").alias("last"))
    order = W.orderBy("ws")  # one row a week
    own = F.col("last") if horizon == "week" else F.max("last").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return weeks.select("ws", F.lag("last").over(order).alias("p"), own.alias("l"))


def previous_decisions(weeks: DataFrame, decided: DataFrame) -> DataFrame:
    """(ws, has, previous): whether a week has decisions, and the last earlier week that has."""
    there = decided.select("ws").distinct().withColumn("__has", F.lit(1))
    rows = weeks.select("ws").distinct().join(there, "ws", "left").withColumn("has", F.coalesce("__has", F.lit(0)))
    past = W.orderBy("ws").rowsBetween(W.unboundedPreceding, -1)  # one row a week
    return rows.select("ws", "has", F.max(F.when(F.col("has") == 1, F.col("ws"))).over(past).alias("previous"))
