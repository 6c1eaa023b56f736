"""Performance and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.functions.exprs import z_safe
from weekloom.functions.normal import polynomial, quantile, upper_tail
from weekloom.operators.portfolio import drawdown
from weekloom.sources.shared import written


def performance(records: DataFrame, risk_free_rate: float = 0.03) -> DataFrame:
    """One row of ten figures from (ws, nav, weekly_return); zeros for no records.

    Total return is from the first record's nav. Sharpe and Sortino are 0 without deviation, Calmar
    without drawdown."""
    rows = drawdown(records)
    r = F.col("weekly_return")
    a = rows.agg(
        F.min_by("nav", "ws").alias("first"), F.max_by("nav", "ws").alias("last"), F.count(F.lit(1)).alias("n"), F.min("drawdown").alias("mdd"), F.avg(r - risk_free_rate / 52).alias("mean"),
        F.stddev_pop(r).alias("sd"), F.stddev_pop(F.when(r < 0, r)).alias("down"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win"),
    )
    total = z_safe(F.col("last") - F.col("first"), F.col("first"))
    annual = F.pow(1 + F.col("total"), z_safe(F.lit(52.0), F.col("n"))) - 1
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    over = lambda num, den: F.when(F.coalesce(den, F.lit(0.0)) > 0, num / den).otherwise(0.0)
    a = a.withColumn("total", total).withColumn("annual", annual)
    root = F.sqrt(F.lit(52.0))
    return a.select(
        zero(F.col("total")).alias("total_return"), zero(F.col("annual")).alias("annual_return"), zero(F.col("mdd")).alias("max_drawdown"), over(root * F.col("mean"), F.col("sd")).alias("sharpe_ratio"),
        over(root * F.col("mean"), F.col("down")).alias("sortino_ratio"), over(F.col("annual"), F.abs("mdd")).alias("calmar_ratio"), zero(F.col("win")).alias("win_rate"), F.col("n").alias("weeks"),
        zero(F.col("last")).alias("final_nav"), zero(F.col("first")).alias("initial_capital"),
    )


def group_ic(rows: DataFrame, by: str, least: int = 3) -> DataFrame:
    """Pearson correlation of truth and prediction in each group; null below ``least`` rows or
    without variation (plain ``corr`` would raise there)."""
    a = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("y_true", "y_pred").alias("c"), F.stddev_pop("y_true").alias("st"), F.stddev_pop("y_pred").alias("sp"))
    return a.select(by, "n", F.when(F.col("n") >= least, z_safe(F.col("c"), F.col("st") * F.col("sp"))).alias("ic"))


def residual_moments(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Mean, deviation, biased skew and excess kurtosis of y_true - y_pred, and mean and deviation of
    the earlier and later half by ``order`` (which must settle ties). Rows are ranked by a range
    shuffle: ranks within ranges and the ranges' sizes, so no task sorts the whole table."""
    e = ranked(rows.withColumn("e", F.col("y_true") - F.col("y_pred")), order)
    n = F.broadcast(e.agg(F.count(F.lit(1)).alias("__n")))
    early = F.col("rank") <= F.floor(F.col("__n") / 2)
    half = lambda f, cond: f(F.when(cond, F.col("e")))
    return e.join(n).agg(
        F.avg("e").alias("mean"), F.stddev_pop("e").alias("std"), F.skewness("e").alias("skew"), F.kurtosis("e").alias("kurt"), half(F.avg, early).alias("early_mean"), half(F.avg, ~early).alias("late_mean"),
        half(F.stddev_pop, early).alias("early_std"), half(F.stddev_pop, ~early).alias("late_std"),
    )


def ranked(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``rank``, their place (from 1) in a total order, without one task that holds all:
    rows are dealt into ranges, numbered there, and offset by the sizes of the ranges before. The
    numbered rows are written, since ranges that are drawn twice need not have the same edges."""
    dealt = rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("__p", F.spark_partition_id())
    dealt = dealt.withColumn("__r", F.row_number().over(W.partitionBy("__p").orderBy(*order)))
    dealt = written(dealt, "ranked")
    sizes = dealt.groupBy("__p").agg(F.max("__r").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return dealt.join(F.broadcast(before.select("__p", "__before")), "__p").withColumn("rank", F.col("__r") + F.col("__before")).drop("__p", "__r", "__before")


def r2(rows: DataFrame) -> DataFrame:
    """1 - residual over total sum of squares; null without variation. One pass: the total is the
    population variance times n."""
    a = rows.agg(F.sum(F.pow(F.col("y_true") - F.col("y_pred"), F.lit(2))).alias("res"), (F.var_pop("y_true") * F.count("y_true")).alias("tot"))
    return a.select((1 - z_safe(F.col("res"), F.col("tot"))).alias("r2"))


def accuracy(rows: DataFrame, hit: Column, loss: Column, weight: Column) -> DataFrame:
    """Share of hits and the weighted mean loss."""
    return rows.agg(F.avg(hit.cast("int")).alias("accuracy"), z_safe(F.sum(loss * weight), F.sum(weight)).alias("loss"), F.count(F.lit(1)).alias("n"))


# The coefficients of Royston (1995), algorithm AS R94, highest power first.
_LAST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157)
_LAST_BUT_ONE = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981)
_SMALL_MEAN = (-6.714e-4, 0.025054, -0.39978, 0.544)
_SMALL_SCALE = (-0.0020322, 0.062767, -0.77857, 1.3822)
_LARGE_MEAN = (0.0038915, -0.083751, -0.31082, -1.5861)
_LARGE_SCALE = (0.0030302, -0.082676, -0.4803)
_GAMMA = (0.459, -2.273)


def shapiro_wilk(rows: DataFrame, value: str, order: tuple[str, ...], most: int = 5000) -> DataFrame:
    """(n, w, p): the test of normality on the first ``most`` values by ``order`` (which must settle ties).

    One row always. Null and NaN values count as absent before the first are taken; w and p are null for fewer than three values
    or without variation. The first rows are bounded, so they are ordered and weighted in one task."""
    first = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(value).cast("double").alias("x"), *order).orderBy(*order).limit(most).select("x")
    n, i, m = F.col("n"), F.col("i"), F.col("m")
    x = first.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))).withColumn("i", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("x")))
    # order statistics' expectations are symmetric: the upper half's carry the weights
    x = x.withColumn("m", quantile((i - 0.375) / (n + 0.25)))
    s = x.agg(F.max("n").alias("n"), F.sum(m * m).alias("mm"), F.max("m").alias("m1"), F.max(F.when(i == n - 1, m)).alias("m2"), F.avg("x").alias("mean"))
    u = 1 / F.sqrt(n)
    a1 = F.when(n == 3, F.sqrt(F.lit(0.5))).otherwise(polynomial(u, (*_LAST, 0.0)) + F.col("m1") / F.sqrt("mm"))
    a2 = F.when(n > 5, polynomial(u, (*_LAST_BUT_ONE, 0.0)) + F.col("m2") / F.sqrt("mm"))
    s = s.withColumn("a1", a1).withColumn("a2", a2)
    square = lambda c: F.col(c) * F.col(c)
    phi = F.when(n > 5, (F.col("mm") - 2 * square("m1") - 2 * square("m2")) / (1 - 2 * square("a1") - 2 * square("a2"))).otherwise((F.col("mm") - 2 * square("m1")) / (1 - 2 * square("a1")))
    s = s.withColumn("phi", F.when(n > 3, phi))
    place = F.least(i - 1, F.col("n") - i)  # from the nearer end
    sign = F.signum(m)
    weight = F.when(place == 0, sign * F.col("a1")).when((place == 1) & (n > 5), sign * F.col("a2")).when(n == 3, 0.0).otherwise(m / F.sqrt("phi"))
    both = x.drop("n").join(F.broadcast(s), F.lit(True))  # one row
    d = F.col("x") - F.col("mean")
    a = both.groupBy("n").agg(F.sum(weight * F.col("x")).alias("top"), F.sum(d * d).alias("all"), F.max(F.abs("x")).alias("size"))
    w = F.when((n >= 3) & (F.col("all") > 1e-24 * F.greatest(square("size") * n, F.lit(1e-280))), F.least(F.lit(1.0), square("top") / F.col("all")))
    a = a.withColumn("w", w)
    y, k, ln = F.log(1 - F.col("w")), n.cast("double"), F.log(n)
    gamma = polynomial(k, _GAMMA)
    small = upper_tail((-F.log(gamma - y) - polynomial(k, _SMALL_MEAN)) / F.exp(polynomial(k, _SMALL_SCALE)))
    large = upper_tail((y - polynomial(ln, _LARGE_MEAN)) / F.exp(polynomial(ln, _LARGE_SCALE)))
    three = F.greatest(F.lit(0.0), 1.9098593171027440 * (F.asin(F.sqrt("w")) - 1.0471975511965976))
    p = F.when(F.col("w").isNull(), None).when(n == 3, three).when(F.col("w") >= 1, 1.0).when(n <= 11, F.when(y >= gamma, 1e-99).otherwise(small)).otherwise(large)
    none = rows.sparkSession.range(1).select(F.lit(0).alias("__none"))
    found = a.select(n.cast("long").alias("n"), "w", p.alias("p"))
    return none.join(F.broadcast(found), F.lit(True), "left").select(F.coalesce("n", F.lit(0)).alias("n"), "w", "p")
