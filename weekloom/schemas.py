"""Table schemas and column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_S, _D, _L, _I, _DATE = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.DateType()


def _schema(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


NEWS_RAW = _schema(datetime=_S, title=_S, content=_S, source=_S)
NEWS_LABELED = _schema(datetime=T.TimestampNTZType(), major_category=_S, sentiment=_S, sentiment_confidence=_D)
PRICES = _schema(industry=_S, code=_S, d=_DATE, close=_D)
ETF_INFO = _schema(code=_L, name=_S, tracking_index=_S, aum=_D)
TAXONOMY = _schema(large_cat=_S, small_cat=_S, index_name=_S, beta=_S, correlation_cluster=_S)
SENTIMENT = _schema(period=_DATE, industry=_S, sentiment_mean=_D, news_count=_L)
DECISIONS = _schema(ws=_DATE, industry=_S, action=_S, weight=_D)
WEEKLY_RETURNS = _schema(ws=_DATE, industry=_S, r=_D)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df``, or ValueError naming what is missing, before any plan is made."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df


def with_defaults(df: DataFrame, **defaults) -> DataFrame:
    """``df`` with each optional column that it lacks, as a literal."""
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in defaults.items() if k not in df.columns})


def column_like(df: DataFrame, part: str) -> str:
    """The first column whose name contains ``part``."""
    for c in df.columns:
        if part in c:
            return c
    raise ValueError(f"no column name contains {part!r}")
