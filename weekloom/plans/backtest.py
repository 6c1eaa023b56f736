"""The walk-forward backtest as one plan: holdings do not drift, so a week's result depends on the
decisions table only through the last week that has any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.config import BacktestConfig
from weekloom.functions.exprs import week_start
from weekloom.operators import portfolio, returns


def run(prices: DataFrame, decisions: DataFrame, cfg: BacktestConfig = BacktestConfig(), horizon: str = "week", scale: float = 1.0, final_flush: bool = False, run_id: str = "run", industry_returns: DataFrame | None = None) -> DataFrame:
    """A record for each week with prices: run_id, ws, nav, weekly_return, invested_weight,
    cash_weight, status, cumulative_return, cost, holdings, contributions.

    The recorded week earns on what was held into it; its own decisions cost from the next week on.
    ``final_flush``: the last record's nav also bears its own cost and a further return if prices
    after it exist (only its nav and weekly_return are changed). ``scale`` multiplies returns.
    ``industry_returns`` (ws, industry, r), if they are there already, spare their computation."""
    weeks = prices.select(week_start(F.col("d")).alias("ws")).distinct()
    found = returns.weekly_industry_returns(prices, horizon) if industry_returns is None else industry_returns
    by_industry = found.withColumn("r", F.col("r") * scale)
    held = portfolio.held_into(weeks, decisions, cfg)
    weekly, parts = returns.portfolio_returns(held, by_industry)
    costs = portfolio.turnover(weeks, decisions, cfg).select("ws", "cost")
    rows = weeks.join(weekly, "ws", "left").join(costs, "ws", "left").select("ws", F.coalesce("r", F.lit(0.0)).alias("r"), F.coalesce("cost", F.lit(0.0)).alias("cost"))
    rows = portfolio.nav_curve(rows, cfg.initial_capital)
    if final_flush:
        rows = _flushed(rows)
    sums = held.groupBy("ws").agg(F.sum("w").alias("invested_weight"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("industry", "w")))).alias("holdings"))
    maps = parts.groupBy("ws").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("industry", "contribution")))).alias("contributions"))
    out = rows.join(sums, "ws", "left").join(maps, "ws", "left").withColumn("invested_weight", F.coalesce("invested_weight", F.lit(0.0))).withColumnRenamed("r", "weekly_return")
    out = out.withColumns(portfolio.record_columns(cfg.initial_capital)).withColumn("run_id", F.lit(run_id))
    return out.select("run_id", "ws", "nav", "weekly_return", "invested_weight", "cash_weight", "status", "cumulative_return", "cost", "holdings", "contributions")


def _flushed(rows: DataFrame) -> DataFrame:
    """The week before the last takes the last week's return and its own cost, and ends the run: the
    last week of prices is what lies beyond the last record."""
    order = W.orderBy("ws")
    nxt = rows.withColumn("__r", F.lead("r").over(order)).withColumn("__after", F.lead("ws", 2).over(order))
    ended = nxt.where("__r IS NOT NULL")
    last = F.col("__after").isNull()
    nav = F.when(last, F.col("nav") * (1 - F.col("cost")) * (1 + F.col("__r"))).otherwise(F.col("nav"))
    return ended.withColumn("nav", nav).withColumn("r", F.when(last, F.col("__r")).otherwise(F.col("r"))).drop("__r", "__after")


def with_previous(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each record with the decisions of the week before it, as an array."""
    lists = decisions.groupBy("ws").agg(F.sort_array(F.collect_list(F.struct("industry", "action", "weight"))).alias("__d"))
    rows = records.join(lists, "ws", "left")
    return rows.withColumn("agent_decisions", F.lag("__d").over(W.partitionBy("run_id").orderBy("ws"))).drop("__d")


def last_record(records: DataFrame) -> DataFrame:
    """The latest record as JSON."""
    return records.groupBy("run_id").agg(F.to_json(F.max_by(F.struct("ws", "nav", "weekly_return", "status"), "ws")).alias("record"))
