"""Position limits, cluster and beta rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.config import BacktestConfig


def violations(decisions: DataFrame, taxonomy: DataFrame, held: DataFrame, pnl: DataFrame, cfg: BacktestConfig = BacktestConfig()) -> DataFrame:
    """(ws, rule, subject, value) for every broken rule of a week's decisions.

    max_weight: a buy above the limit; max_total: the sum of buys above its limit; beta: after a
    losing week, a new buy of very high beta; mirror: two or more large buys in one cluster.
    ``held`` (ws, industry) and ``pnl`` (ws, r) are what the week began with. Decisions may name large
    or small categories; an industry that the taxonomy lacks is its own cluster, of medium beta."""
    buys = decisions.where(F.col("action") == "buy")
    heavy = buys.where(F.col("weight") > cfg.max_weight_per_industry).select("ws", F.lit("max_weight").alias("rule"), F.col("industry").alias("subject"), F.col("weight").alias("value"))
    total = buys.groupBy("ws").agg(F.sum("weight").alias("value")).where(F.col("value") > cfg.max_total_weight).select("ws", F.lit("max_total").alias("rule"), F.lit("all").alias("subject"), "value")
    small = taxonomy.groupBy(F.col("small_cat").alias("industry")).agg(F.max("beta").alias("beta"), F.max("correlation_cluster").alias("cluster"))
    known = buys.join(small, "industry", "left").withColumn("beta", F.coalesce("beta", F.lit("medium"))).withColumn("cluster", F.coalesce("cluster", "industry"))
    losing = pnl.where("r < 0").select("ws", F.col("r").alias("value"))
    new = known.where((F.col("weight") != 0) & (F.col("beta") == "very_high")).join(held.select("ws", "industry"), ["ws", "industry"], "left_anti")
    beta = new.join(losing, "ws").select("ws", F.lit("beta").alias("rule"), F.col("industry").alias("subject"), "value")
    large = known.where((F.col("weight") >= cfg.mirror_weight) & (F.col("cluster") != "unknown"))
    mirror = large.groupBy("ws", "cluster").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("ws", F.lit("mirror").alias("rule"), F.col("cluster").alias("subject"), F.col("n").cast("double").alias("value"))
    return heavy.unionByName(total).unionByName(beta).unionByName(mirror)


def error_text(broken: DataFrame) -> DataFrame:
    """(ws, last_error): a week's violations as one text, in the order of rules and subjects."""
    says = F.when(F.col("rule") == "max_weight", F.format_string("[%s] weight %.3f > max", "subject", "value")).when(F.col("rule") == "max_total", F.format_string("Total weight %.3f > max", "value"))
    says = says.when(F.col("rule") == "beta", F.format_string("[Beta Penalty] cannot ADD '%s'", "subject")).otherwise(F.format_string("[Mirror Conflict] '%s': reduce one to a lower weight", "subject"))
    rank = F.when(F.col("rule") == "max_weight", 0).when(F.col("rule") == "max_total", 1).when(F.col("rule") == "beta", 2).otherwise(3)
    lines = broken.groupBy("ws").agg(F.sort_array(F.collect_list(F.struct(rank.alias("o"), "subject", says.alias("t")))).alias("a"))
    return lines.select("ws", F.array_join(F.transform("a", lambda x: x["t"]), "; ").alias("last_error"))


def route(passed: Column, error: Column) -> Column:
    """Where a checked decision goes next: end, the trader (weights) or the researcher."""
    about_weight = F.contains(error, F.lit("weight")) | F.contains(error, F.lit("total")) | F.contains(error, F.lit("max"))
    return F.when(passed, "end").when(about_weight, "trader").otherwise("researcher")


def accepted(passed: Column, attempt: Column, limit: int = 3) -> Column:
    """A third attempt is taken as it is."""
    return passed | (attempt >= limit)


def next_step(loop_step: Column, has_calls: Column, limit: int = 6) -> Column:
    return F.when(loop_step >= limit, "finalize").when(has_calls, "tools").otherwise("finalize")
