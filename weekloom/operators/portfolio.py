"""Rebalancing, net asset value and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.config import BacktestConfig
from weekloom.functions.exprs import status
from weekloom.operators.calendar import previous_decisions


def targets(decisions: DataFrame, order: str | None = None) -> DataFrame:
    """(ws, industry, w): positive weights of buys and holds, divided by their sum where it is above
    one. Of an industry's repeated rows the last (by ``order``) is its target, while all count in
    the sum."""
    w = F.when(F.col("action").isin("buy", "hold") & (F.col("weight") > 0), F.col("weight")).otherwise(0.0)
    rows = decisions.withColumn("w", w)
    total = F.sum("w").over(W.partitionBy("ws"))
    rows = rows.withColumn("total", total).where("w > 0")
    if order is not None:
        back = W.partitionBy("ws", "industry").orderBy(F.desc(order))
        rows = rows.withColumn("__r", F.row_number().over(back)).where("__r = 1")
    return rows.select("ws", "industry", (F.col("w") / F.greatest(F.col("total"), F.lit(1.0))).alias("w"))


def holdings(target: DataFrame, least: float = BacktestConfig.least_weight) -> DataFrame:
    """What is held after a week's decisions: targets above a least weight."""
    return target.where(F.col("w") > least)


def held_into(weeks: DataFrame, decisions: DataFrame, cfg: BacktestConfig = BacktestConfig()) -> DataFrame:
    """(ws, industry, w): what is held when a week begins. A week without decisions keeps what there
    was; one with only sells ends with nothing."""
    before = previous_decisions(weeks, decisions).where("previous IS NOT NULL").select(F.col("ws").alias("__ws"), F.col("previous").alias("ws"))
    return holdings(targets(decisions), cfg.least_weight).join(before, "ws").select(F.col("__ws").alias("ws"), "industry", "w")


def turnover(weeks: DataFrame, decisions: DataFrame, cfg: BacktestConfig = BacktestConfig()) -> DataFrame:
    """(ws, turnover, cost) of every week with a change: the new targets against what was held."""
    has = previous_decisions(weeks, decisions).where("has = 1").select("ws")
    old = held_into(weeks, decisions, cfg).join(has, "ws", "left_semi").select("ws", "industry", (-F.col("w")).alias("w"))
    moves = targets(decisions).unionByName(old).groupBy("ws", "industry").agg(F.sum("w").alias("dw"))
    return moves.groupBy("ws").agg(F.sum(F.abs("dw")).alias("turnover")).withColumn("cost", F.col("turnover") * (cfg.transaction_fee + cfg.slippage))


def nav_curve(rows: DataFrame, capital: float = BacktestConfig.initial_capital, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (ws, r, cost) with ``nav``: growth by all returns so far and costs of earlier weeks.
    ``by``: columns that tell runs apart; without any, the weeks of the one run are one window."""
    w = W.partitionBy(*by).orderBy("ws")
    grown = F.product(1 + F.col("r")).over(w.rowsBetween(W.unboundedPreceding, 0))
    paid = F.coalesce(F.product(1 - F.col("cost")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(1.0))
    return rows.withColumn("nav", F.lit(float(capital)) * grown * paid)


def drawdown(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (ws, nav) with the running maximum and the fall from it."""
    top = F.max("nav").over(W.partitionBy(*by).orderBy("ws").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("peak", top).withColumn("drawdown", (F.col("nav") - F.col("peak")) / F.col("peak"))


def record_columns(capital: float) -> dict[str, Column]:
    """A record's derived fields, from nav, r and invested_weight."""
    return {"cash_weight": 1 - F.col("invested_weight"), "status": status(F.col("weekly_return")), "cumulative_return": F.col("nav") / F.lit(float(capital)) - 1}


def losing_runs(weekly: DataFrame) -> DataFrame:
    """(ws, losing): how many weeks in a row, up to the week before, had a negative return. ``weekly`` (ws, r) has a
    row a week; runs are numbered by the weeks between them."""
    order = W.orderBy("ws")  # a row a week
    rows = weekly.withColumn("__run", F.sum((F.coalesce("r", F.lit(0.0)) >= 0).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    length = F.when(F.col("r") < 0, F.sum((F.col("r") < 0).cast("int")).over(W.partitionBy("__run").orderBy("ws"))).otherwise(0)
    return rows.withColumn("__n", length).select("ws", F.coalesce(F.lag("__n").over(order), F.lit(0)).cast("int").alias("losing"))


def cut_after_losses(decisions: DataFrame, weekly: DataFrame, weeks: int = 2, cut: float = 0.2) -> DataFrame:
    """``decisions`` with targets reduced by ``cut`` in weeks that follow ``weeks`` losing ones or more; off unless called.

    ``weekly`` (ws, r) are the returns of the decisions as they are: all that a week holds comes from one week's
    decisions, so scaling those keeps the sign of every return, and runs of losses can be found beforehand. (A target
    that falls below the least weight by the cut is no longer held.) In reduced weeks a buy's or hold's weight is its
    reduced target, repeated rows of an industry being scaled alike; other actions stay."""
    w = F.when(F.col("action").isin("buy", "hold") & (F.col("weight") > 0), F.col("weight"))
    total = F.greatest(F.coalesce(F.sum(w).over(W.partitionBy("ws")), F.lit(0.0)), F.lit(1.0))
    rows = decisions.withColumn("__w", w / total).join(losing_runs(weekly), "ws", "left")
    reduced = (F.coalesce("losing", F.lit(0)) >= weeks) & F.col("__w").isNotNull()
    return rows.withColumn("weight", F.when(reduced, F.col("__w") * (1 - cut)).otherwise(F.col("weight"))).select(*decisions.columns)
