"""Features of sentiment and volume series. Rows are (period, industry, sentiment_mean, news_count),
dense or not; every operator is a window over one industry's rows in order of period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from weekloom.functions.exprs import heat, momentum
from weekloom.schemas import with_defaults

S, V = "sentiment_mean", "news_count"


def _all() -> WindowSpec:
    return W.partitionBy("industry")


def _by() -> WindowSpec:
    return _all().orderBy("period")


def _numbered(series: DataFrame) -> DataFrame:
    """With the row number ``rn`` (from 0) and the number of rows ``n`` of the industry."""
    return series.withColumn("rn", F.row_number().over(_by()) - 1).withColumn("n", F.count(F.lit(1)).over(_all()))


def _past(col: str | Column, n: int, upto: int = -1) -> Column:
    """The ``n`` values that end ``upto`` rows from here, in order; nulls keep their places."""
    x = F.col(col) if isinstance(col, str) else col
    return F.transform(F.collect_list(F.struct(x.alias("x"))).over(_by().rowsBetween(upto - n + 1, upto)), lambda s: s["x"])


def changes(series: DataFrame) -> DataFrame:
    """Sentiment momentum and volume heat against the row before; null on the first."""
    return series.withColumn("momentum", momentum(F.col(S), F.lag(S).over(_by()))).withColumn("news_heat", heat(F.col(V), F.lag(V).over(_by())))


def isolation_features(series: DataFrame) -> DataFrame:
    """Volume ratio (the first row's own volume), sentiment difference (0 on the first), sentiment."""
    first = F.row_number().over(_by()) == 1
    ratio = F.when(first, F.col(V).cast("double")).otherwise(F.col(V) / (F.lag(V).over(_by()) + 1))
    diff = F.when(first, F.col(S) - F.col(S)).otherwise(F.col(S) - F.lag(S).over(_by()))
    return series.select("period", "industry", ratio.alias("vol_norm"), diff.alias("sent_diff"), F.col(S).alias("sent_cur"))


def sequences(series: DataFrame, lookback: int = 5, threshold: float = 0.03) -> DataFrame:
    """(period, industry, sequence, momentum, anomaly): the ``lookback`` values before a row, its
    momentum as the label and whether its return is large. The last row is never a label, and an
    industry with fewer than lookback + 2 rows has none."""
    rows = with_defaults(series, **{"return": 0.0})
    rows = _numbered(rows).withColumn("sequence", _past(S, lookback)).withColumn("momentum", momentum(F.col(S), F.lag(S).over(_by())))
    rows = rows.where((F.col("n") >= lookback + 2) & F.col("rn").between(F.lit(lookback), F.col("n") - 2))
    return rows.select("period", "industry", "sequence", "momentum", F.when(F.abs("return") > threshold, 1).otherwise(0).alias("anomaly"))


def industry_sequences(series: DataFrame, lookback: int = 5) -> DataFrame:
    """(period, industry, sequence, deltas, momentum) for every row with ``lookback`` before it."""
    delta = heat(F.col(V), F.lag(V).over(_by()))
    rows = _numbered(series).withColumn("momentum", momentum(F.col(S), F.lag(S).over(_by()))).withColumn("delta", delta).withColumn("sequence", _past(S, lookback))
    return rows.where(F.col("rn") >= lookback).select("period", "industry", "sequence", F.array_repeat("delta", lookback).alias("deltas"), "momentum")


def cross_sequences(series: DataFrame, lookback: int = 8) -> DataFrame:
    """(period, features, labels) over all industries at once: for each of the ``lookback`` periods
    before, every industry's sentiment and then every industry's present volume change; labels are
    the industries' momenta. Industries are in order of name, and the series must be dense."""
    rows = changes(series)
    wide = rows.groupBy("period").agg(F.sort_array(F.collect_list(F.struct("industry", F.col(S).alias("s"), "news_heat", "momentum"))).alias("a"))
    by = W.orderBy("period")  # one row a period
    past = F.collect_list(F.struct(F.col("a.s").alias("s"))).over(by.rowsBetween(-lookback, -1))
    wide = wide.withColumn("past", past).withColumn("rn", F.row_number().over(by) - 1).where(F.col("rn") >= lookback)
    return wide.select("period", F.transform("past", lambda p: F.concat(p["s"], F.col("a.news_heat"))).alias("features"), F.col("a.momentum").alias("labels"))


def rolling_flatten(series: DataFrame, lookback: int = 4) -> DataFrame:
    """(period, industry, momenta, heats, label): the ``lookback`` momenta and heats before a row (0
    on an industry's first), and the sign of the next change; keyed rows rather than a flat array."""
    rows = _numbered(changes(series))
    first = F.col("rn") == 0
    rows = rows.withColumn("m", F.when(first, 0.0).otherwise(F.col("momentum"))).withColumn("h", F.when(first, 0.0).otherwise(F.col("news_heat")))
    rows = rows.withColumn("momenta", _past("m", lookback)).withColumn("heats", _past("h", lookback)).withColumn("label", F.signum(F.lead(S).over(_by()) - F.col(S)).cast("int"))
    return rows.where((F.col("rn") >= lookback) & (F.col("rn") <= F.col("n") - 2)).select("period", "industry", "momenta", "heats", "label")


def stacking_features(series: DataFrame, lookback: int = 5, model_reg: str | None = None, model_cls: str | None = None) -> DataFrame:
    """Ten features for rows lookback + 1 to n - 2: changes over one and two rows, volume and heat,
    deviations over five rows, and the sequence model's outputs if their columns are given; the label
    is the direction of the next change (0 if it is unknown)."""
    rows = _numbered(with_defaults(series, news_heat=0.0))
    five = _by().rowsBetween(-4, 0)
    reg = F.col(model_reg) if model_reg else F.lit(None).cast("double")
    cls = F.col(model_cls) if model_cls else F.lit(None).cast("double")
    nxt = F.lead(S).over(_by())
    rows = rows.withColumns(
        {
            "delta_1": F.col(S) - F.lag(S, 1).over(_by()),
            "delta_2": F.col(S) - F.lag(S, 2).over(_by()),
            "model_reg": reg,
            "model_cls": cls,
            "model_delta": reg - F.lag(reg).over(_by()),
            "count_std": F.stddev_pop(V).over(five),
            "sentiment_std": F.stddev_pop(S).over(five),
            "model_heat": reg * F.col("news_heat"),
            "label": F.when(nxt > F.col(S), 1).when(nxt < F.col(S), -1).otherwise(0),
        }
    )
    keep = (F.col("n") >= lookback + 2) & F.col("rn").between(F.lit(lookback + 1), F.col("n") - 2)
    return rows.where(keep).select("period", "industry", "delta_1", "delta_2", V, "news_heat", "model_reg", "model_cls", "model_delta", "count_std", "sentiment_std", "model_heat", "label")


def isolation_windows(series: DataFrame, lookback: int = 5) -> DataFrame:
    """(period, industry, features): ``lookback`` counts and heats from a row on, for the rows that
    have 2 * lookback after them."""
    rows = _numbered(with_defaults(series, news_heat=0.0))
    rows = rows.withColumn("features", F.concat(F.transform(_past(V, lookback, lookback - 1), lambda x: x.cast("double")), _past("news_heat", lookback, lookback - 1)))
    return rows.where(F.col("rn") < F.col("n") - 2 * lookback).select("period", "industry", "features")


def last_rows(series: DataFrame, n: int = 5, as_of: str | None = None) -> DataFrame:
    """Each industry's last ``n`` rows up to a date."""
    rows = series if as_of is None else series.where(F.col("period") <= F.lit(as_of).cast("date"))
    back = W.partitionBy("industry").orderBy(F.desc("period"))
    return rows.withColumn("__r", F.row_number().over(back)).where(F.col("__r") <= n).drop("__r")


def period_split(rows: DataFrame, train_end: str) -> DataFrame:
    """With ``part``: train before a date, test from it on."""
    return rows.withColumn("part", F.when(F.col("period") < F.lit(train_end).cast("date"), "train").otherwise("test"))
