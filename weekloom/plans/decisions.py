"""Decisions of all weeks at once, checked and revised within a limit.

A ``DecisionProvider`` proposes decisions and revises those of rejected weeks; whatever stands behind it (rules, a
model, a service) sees tables, not weeks one by one. Every check is one plan over all open weeks, and what it
leaves is written, so that the next check reads rows instead of the history that made them.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.config import BacktestConfig
from weekloom.operators import portfolio, returns, risk
from weekloom.sources.shared import forget, written

DECISION = ("ws", "industry", "action", "weight")
LOG = "ws date, attempts int, forced boolean, route string, last_error string"


class DecisionProvider(Protocol):
    def propose(self, weeks: DataFrame) -> DataFrame:
        """(ws, industry, action, weight) for the weeks (ws) that have decisions at all."""

    def revise(self, rejected: DataFrame, broken: DataFrame, routes: DataFrame) -> DataFrame:
        """New decisions for the weeks of ``rejected``, given (ws, rule, subject, value) and (ws, route, last_error): a route
        is trader (weights) or researcher."""


@dataclass
class RuleProvider:
    """Decisions of a table, revised by rule, one kind of violation an attempt: weights above the limit are
    capped; else a total above its limit is scaled to just under it; else of mirrors all but the largest buy
    (ties by name) are reduced; else new buys of very high beta become holds."""

    table: DataFrame
    taxonomy: DataFrame
    cfg: BacktestConfig = BacktestConfig()
    margin: float = 0.99
    reduced: float = 0.1

    def propose(self, weeks: DataFrame) -> DataFrame:
        return self.table.join(weeks.select("ws").distinct(), "ws", "left_semi").select(*DECISION)

    def revise(self, rejected: DataFrame, broken: DataFrame, routes: DataFrame) -> DataFrame:
        has = lambda rule: F.max(F.col("rule") == rule).alias(rule)
        flags = broken.groupBy("ws").agg(*map(has, ("max_weight", "max_total", "mirror", "beta")), F.max(F.when(F.col("rule") == "max_total", F.col("value"))).alias("total"))
        named = broken.where("rule = 'beta'").select("ws", F.col("subject").alias("industry"), F.lit(True).alias("beta_buy"))
        clusters = self.taxonomy.groupBy(F.col("small_cat").alias("industry")).agg(F.max("correlation_cluster").alias("cluster"))
        mirrors = broken.where("rule = 'mirror'").select("ws", F.col("subject").alias("cluster"), F.lit(True).alias("mirrored"))
        rows = rejected.join(flags, "ws").join(clusters, "industry", "left").withColumn("cluster", F.coalesce("cluster", "industry"))
        rows = rows.join(named, ["ws", "industry"], "left").join(mirrors, ["ws", "cluster"], "left")
        buy, w = F.col("action") == "buy", F.col("weight")
        heavy = buy & (w >= self.cfg.mirror_weight) & F.col("mirrored").isNotNull()
        first = F.row_number().over(W.partitionBy("ws", "cluster", heavy).orderBy(F.desc("weight"), "industry")) == 1
        weight = F.when(F.col("max_weight"), F.when(buy, F.least(w, F.lit(self.cfg.max_weight_per_industry))).otherwise(w))
        weight = weight.when(F.col("max_total"), F.when(buy, w * self.cfg.max_total_weight * self.margin / F.col("total")).otherwise(w))
        weight = weight.when(F.col("mirror"), F.when(heavy & ~first, F.lit(self.reduced)).otherwise(w))
        out = buy & F.col("beta_buy").isNotNull() & ~F.col("max_weight") & ~F.col("max_total") & ~F.col("mirror")
        return rows.select("ws", "industry", F.when(out, "hold").otherwise(F.col("action")).alias("action"), F.when(out, 0.0).otherwise(weight.otherwise(w)).alias("weight"))


def checked(proposed: DataFrame, provider: DecisionProvider, taxonomy: DataFrame, held: DataFrame, pnl: DataFrame, cfg: BacktestConfig = BacktestConfig(), limit: int = 3) -> tuple[DataFrame, DataFrame]:
    """(decisions, log) after at most ``limit`` checks of every week, for what each week begins with: ``held`` (ws, industry)
    and ``pnl`` (ws, r), as in ``risk.violations``.

    A week that breaks no rule is done; one that does is revised and checked again, and taken as it is at the
    last check (forced). The log has a row for each week with decisions: attempts, forced, and the route and
    text of the last violations (route end and null without any). A revision that leaves a week without
    decisions passes, with none."""
    open_ = written(proposed.select(*DECISION), "decisions")
    weeks = written(open_.select("ws").distinct(), "weeks")
    done: list[DataFrame] = []
    logs: list[DataFrame] = []
    for attempt in range(1, limit + 1):
        broken = written(risk.violations(open_, taxonomy, held, pnl, cfg), "violations")
        texts = risk.error_text(broken)
        routes = written(texts.select("ws", risk.route(F.lit(False), F.col("last_error")).alias("route"), "last_error"), "routes")
        failed = routes.select("ws")
        passed = weeks.join(failed, "ws", "left_anti")
        if attempt == 1:
            nothing = F.lit(None).cast("string")
            logs.append(passed.select("ws", F.lit(1).alias("attempts"), F.lit(False).alias("forced"), F.lit("end").alias("route"), nothing.alias("last_error")))
        else:
            logs.append(passed.join(before, "ws").select("ws", F.lit(attempt).alias("attempts"), F.lit(False).alias("forced"), "route", "last_error"))
        if attempt == limit:
            logs.append(routes.select("ws", F.lit(attempt).alias("attempts"), F.lit(True).alias("forced"), "route", "last_error"))
            done.append(open_)
            break
        done.append(open_.join(failed, "ws", "left_anti"))
        rejected = open_.join(failed, "ws", "left_semi")
        open_, weeks, before = written(provider.revise(rejected, broken, routes).select(*DECISION), "decisions"), routes.select("ws"), routes
    decisions, log = done[0], logs[0]
    for d in done[1:]:
        decisions = decisions.unionByName(d)
    for x in logs[1:]:
        log = log.unionByName(x)
    return decisions, log


def walked(prices: DataFrame, provider: DecisionProvider, taxonomy: DataFrame, cfg: BacktestConfig = BacktestConfig(), scale: float = 1.0, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(decisions, log) where every week begins with what the accepted decisions of the weeks before it left, and with
    the return of the week before.

    Weeks depend on one another only through accepted decisions, so all are checked at once against the decisions of
    the last sweep until a sweep changes none. A sweep settles one more week at least, in order; in practice as many as the
    longest run of weeks whose holdings hang on each other. ``most`` sweeps without an end raise."""
    weeks = written(prices.select(F.date_trunc("week", "d").cast("date").alias("ws")).distinct(), "weeks")
    industry = written(returns.weekly_industry_returns(prices).withColumn("r", F.col("r") * scale), "returns")
    proposed = written(provider.propose(weeks), "proposed")
    now, seen = proposed, None
    for _ in range(most):
        held = written(portfolio.held_into(weeks, now, cfg), "held")
        weekly = weeks.join(returns.portfolio_returns(held, industry)[0], "ws", "left").select("ws", F.coalesce("r", F.lit(0.0)).alias("r"))
        pnl = written(weekly.select("ws", F.lag("r", 1, 0.0).over(W.orderBy("ws")).alias("r")), "pnl")  # a row a week
        decisions, log = checked(proposed, provider, taxonomy, held, pnl, cfg)
        last, now = now, written(decisions, "accepted")
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*DECISION)), F.sum(F.xxhash64(*DECISION) % 1_000_003)).first()
        if last is not proposed:
            forget(last)
        if state == seen:
            return now, log
        seen = state
    raise RuntimeError(f"decisions did not settle in {most} sweeps")
