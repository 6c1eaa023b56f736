"""Industry scores by rule and by stored models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.functions.exprs import clip, direction
from weekloom.operators import forest, trees
from weekloom.operators.features import last_rows
from weekloom.schemas import with_defaults


def scores(series: DataFrame, industries: DataFrame, as_of: str | None = None, rows: int = 5) -> DataFrame:
    """(industry, momentum_score, heat_anomaly, composite_score, trend_direction) for every listed
    industry: clipped means of its last rows; all 0 without any. Missing heat counts as 1."""
    last = last_rows(with_defaults(series, news_heat=1.0), rows, as_of)
    agg = last.groupBy("industry").agg(clip(F.avg("sentiment_mean"), -1, 1).alias("m"), clip(F.avg("news_heat") / 5.0, 0, 1).alias("h"), F.count(F.lit(1)).alias("n"))
    out = industries.select("industry").distinct().join(agg, "industry", "left")
    m, h = F.when(F.col("n").isNull(), 0.0).otherwise(F.col("m")), F.when(F.col("n").isNull(), 0.0).otherwise(F.col("h"))
    return out.select("industry", m.alias("momentum_score"), h.alias("heat_anomaly"), (m * h).alias("composite_score"), direction(m).alias("trend_direction"))


def _model(rows: DataFrame, packed: DataFrame, kind: str) -> DataFrame:
    """With the trees of a kind of model: the industry's own (``kind:industry``), else the common one, else null."""
    own = packed.select(F.col("model").alias("__own"), F.col("trees").alias("__o"))
    common = packed.where(F.col("model") == kind).select(F.lit(True).alias("__c"), F.col("trees").alias("__t"))
    rows = rows.withColumn("__own", F.concat(F.lit(f"{kind}:"), "industry")).withColumn("__c", F.lit(True))
    rows = rows.join(F.broadcast(own), "__own", "left").join(F.broadcast(common), "__c", "left")
    return rows.withColumn(kind, F.coalesce("__o", "__t")).drop("__own", "__o", "__c", "__t")


def learned_scores(series: DataFrame, industries: DataFrame, nodes: DataFrame, as_of: str | None = None, lookback: int = 5, heat_from: str = "one_row", sample: int = 256) -> DataFrame:
    """Like ``scores``, by the models of a node table (see ``trees``): ``momentum`` over an industry's last ``lookback``
    sentiments, ``isolation`` over as many counts and then heats, and ``composite`` over the change of sentiment in
    ``lookback`` rows, the heat anomaly, the trend and the last count. A name followed by ``:industry`` is that industry's own model.

    An industry with fewer than ``lookback`` rows, or without a momentum model, is scored by rule. Heat is 0.5
    without a forest or with fewer than 2 * lookback rows. With ``heat_from="one_row"`` it is otherwise 0: scaling a single
    row by itself leaves nothing, which is what the literal procedure gives; ``"score"`` takes the forest's score of
    trees grown on ``sample`` rows. The composite score is the momentum without its model or with lookback rows only.
    Missing heat counts as 1, a missing column ``sentiment_trend`` as 0."""
    if heat_from not in ("one_row", "score"):
        raise ValueError(f"heat_from is one_row or score, not {heat_from}")
    if (size := nodes.count()) > trees.MODEL_NODES:
        raise ValueError(f"{size} nodes are too many to broadcast")
    packed = trees.packed(nodes)
    x = lambda name: F.transform("a", lambda r: r[name].cast("double"))
    last = last_rows(with_defaults(series, news_heat=1.0, sentiment_trend=0.0), 2 * lookback, as_of)
    rows = last.groupBy("industry").agg(F.sort_array(F.collect_list(F.struct("period", "sentiment_mean", "news_count", "news_heat", "sentiment_trend"))).alias("a"))
    rows = rows.select("industry", F.size("a").alias("n"), *(x(c).alias(c) for c in ("sentiment_mean", "news_count", "news_heat", "sentiment_trend")))
    for kind in ("momentum", "isolation", "composite"):
        rows = _model(rows, packed, kind)
    end = lambda c, back=1: F.get(F.col(c), F.size(c) - back)
    tail = lambda c: F.slice(c, F.greatest(F.size(c) - lookback + 1, F.lit(1)), F.lit(lookback))
    m = trees.total(F.col("momentum"), tail("sentiment_mean"))
    seen: Column = F.lit(0.0) if heat_from == "one_row" else forest.score(F.col("isolation"), F.concat(tail("news_count"), tail("news_heat")), sample)
    rows = rows.where((F.col("n") >= lookback) & F.col("momentum").isNotNull()).withColumn("m", m)
    rows = rows.withColumn("h", F.when(F.col("isolation").isNotNull() & (F.col("n") >= 2 * lookback), seen).otherwise(0.5))
    inputs = F.array(end("sentiment_mean") - end("sentiment_mean", lookback + 1), F.col("h"), end("sentiment_trend"), end("news_count"))
    rows = rows.withColumn("c", F.when(F.col("composite").isNotNull() & (F.col("n") >= lookback + 1), clip(trees.total(F.col("composite"), inputs), -1, 1)).otherwise(F.col("m")))
    ruled = scores(series, industries, as_of)
    found = ruled.join(rows.select("industry", "m", "h", "c"), "industry", "left")
    pick = lambda learned, ruled_: F.when(F.col("m").isNotNull(), learned).otherwise(F.col(ruled_)).alias(ruled_)
    return found.select("industry", pick(F.col("m"), "momentum_score"), pick(F.col("h"), "heat_anomaly"), pick(F.col("c"), "composite_score"), pick(direction(F.col("m")), "trend_direction"))


def rendered(scored: DataFrame) -> DataFrame:
    """One text: a line for each industry, by composite score."""
    line = F.format_string("%s: momentum=%.3f heat=%.3f composite=%.3f trend=%d", "industry", "momentum_score", "heat_anomaly", "composite_score", "trend_direction")
    rows = scored.select(F.struct((-F.col("composite_score")).alias("s"), "industry", line.alias("line")).alias("x"))
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))  # the listed industries only
