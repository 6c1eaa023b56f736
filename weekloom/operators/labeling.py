"""Batch labelling: text selection, classes from logits, label encoders, model inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.functions.exprs import argmax, confidence, label_at, strict_map
from weekloom.functions.text import both_null, model_text, safe_name
from weekloom.operators.metrics import ranked

# First-level classes and sentiments in the models' order.
L1_CATEGORIES = ("主题策略", "医药健康", "基础设施/公共", "消费文娱", "科技信息", "资源材料", "金融地产", "高端制造")
SENTIMENTS = ("negative", "neutral", "positive")
SENTIMENT_CODES = {"negative": 0, "bearish": 0, "0": 0, "neutral": 1, "1": 1, "positive": 2, "bullish": 2, "2": 2}
FALLBACK = "其他"


def selected(news: DataFrame, limit: int | None = None, order: tuple[str, ...] = ("datetime",)) -> DataFrame:
    """Rows with a title or content, with the model's text; the first ``limit`` in order if given."""
    rows = news.where(~both_null(F.col("title"), F.col("content"))).withColumn("model_text", model_text(F.col("title"), F.col("content")))
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def classified(rows: DataFrame, logits: str, labels: Sequence[str], name: str, places: int | None = None) -> DataFrame:
    """With the class of the largest logit and its probability."""
    names, z = F.array(*map(F.lit, labels)), F.col(logits)
    p = confidence(z) if places is None else F.bround(confidence(z), places)
    return rows.withColumn(name, label_at(names, argmax(z))).withColumn(f"{name}_confidence", p)


def inferred(rows: DataFrame, predict: Callable[[], Callable[[list[str]], list[list[float]]]], text_col: str = "model_text", logits_col: str = "logits") -> DataFrame:
    """With the logits of a model: ``predict()`` makes a function from texts to logits once in every
    Python worker (an ONNX session, say); batches go through it by Arrow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = predict()
        for b in batches:
            yield b.assign(**{logits_col: model(b[text_col].tolist())})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, `{logits_col}` array<double>")


def sub_labels(training: DataFrame, major: str = "major", sub: str = "sub") -> DataFrame:
    """(major, subs): each major's sub-labels in order."""
    return training.groupBy(major).agg(F.sort_array(F.collect_set(sub)).alias("subs"))


def sub_classified(rows: DataFrame, subs: DataFrame, logits: str = "sub_logits", major: str = "major") -> DataFrame:
    """With the sub-category by the major's own labels: a position beyond the labels is the last one;
    a major without a model (no logits) has its last label and confidence 0, one without labels the
    fallback."""
    z = F.col(logits)
    found = rows.join(subs, major, "left").withColumn("model", safe_name(F.col(major)))
    label = F.when(F.col("subs").isNull() | (F.size("subs") == 0), FALLBACK).when(z.isNull(), F.element_at("subs", -1)).otherwise(label_at(F.col("subs"), argmax(z)))
    return found.withColumn("sub_category", label).withColumn("sub_category_confidence", F.when(z.isNull(), 0.0).otherwise(F.coalesce(confidence(z), F.lit(0.0))))


def sentiment_code(x: Column, strict: bool = True) -> Column:
    """0, 1 or 2 of a sentiment's word or number."""
    return strict_map(x.cast("string"), SENTIMENT_CODES, strict)


def class_index(x: Column, labels: Sequence[str] = L1_CATEGORIES) -> Column:
    return F.when(F.array_contains(F.array(*map(F.lit, labels)), x), F.array_position(F.array(*map(F.lit, labels)), x) - 1).cast("int")


def label_index(rows: DataFrame, major: str, sub: str) -> DataFrame:
    """(major, sub, idx, n): a number from 0 for each sub-label of a major, in order; rows without a
    sub-label are left out. Labels are counted before they are numbered."""
    kinds = rows.dropna(subset=[sub]).groupBy(major, sub).agg(F.count(F.lit(1)).alias("n"))
    return kinds.withColumn("idx", (F.row_number().over(W.partitionBy(major).orderBy(sub)) - 1).cast("int"))


def trainable(rows: DataFrame, major: str, sub: str) -> DataFrame:
    """(major, labels, n) of the majors with two labels or more."""
    return label_index(rows, major, sub).groupBy(major).agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n")).where("labels >= 2")


def attached(rows: DataFrame, order: tuple[str, ...], values: DataFrame, value_order: tuple[str, ...]) -> DataFrame:
    """``rows`` with the columns of ``values`` at the same place, both in a total order; the order columns of ``values`` are
    dropped. Both are ranked over ranges, so no task holds either; different numbers of rows raise."""
    left, right = ranked(rows, order).withColumnRenamed("rank", "__at"), ranked(values, value_order).drop(*value_order).withColumnRenamed("rank", "__at")
    if (a := left.count()) != (b := right.count()):
        raise ValueError(f"{a} rows and {b} values do not go together")
    return left.join(right, "__at").drop("__at")
