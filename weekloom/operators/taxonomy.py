"""Industry taxonomy and fund dimensions: (large_cat, small_cat, index_name, beta,
correlation_cluster)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.sources.files import cached_table

# What an unknown index is.
UNKNOWN = {"large_cat": "未知", "small_cat": "未知", "beta": "medium", "correlation_cluster": "unknown"}


def best_etf(info: DataFrame, nulls_first: bool = False) -> DataFrame:
    """The fund of largest assets for each tracking index, ties to the smaller code; funds of unknown
    assets come last (or first)."""
    aum = F.col("aum").desc_nulls_first() if nulls_first else F.col("aum").desc_nulls_last()
    return info.withColumn("__r", F.row_number().over(W.partitionBy("tracking_index").orderBy(aum, "code"))).where("__r = 1").drop("__r")


def best_etf_cached(spark: SparkSession, path: str, funds: DataFrame, force: bool = False) -> DataFrame:
    """``best_etf`` from the table at ``path``, which is made first if it is not there or ``force`` is set."""
    return cached_table(spark, path, lambda: best_etf(funds), force)


def industry_codes(taxonomy: DataFrame, best: DataFrame) -> DataFrame:
    """(industry, level, code): the best funds of an industry's indices, by large or small category;
    indices without a fund are left out, a code counts once."""
    rows = taxonomy.join(best.select(F.col("tracking_index").alias("index_name"), "code"), "index_name")
    large = rows.select(F.col("large_cat").alias("industry"), F.lit("large").alias("level"), "code")
    return large.unionByName(rows.select(F.col("small_cat").alias("industry"), F.lit("small").alias("level"), "code")).distinct()


def index_info(names: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``names`` (index_name) with their categories, beta and cluster, or those of the unknown."""
    rows = names.join(taxonomy, "index_name", "left")
    return rows.select("index_name", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in UNKNOWN.items()])


def cluster_conflicts(names: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(first, second, cluster) of the pairs of ``names`` (pos, index_name) in one known cluster, in
    order of position."""
    rows = names.join(taxonomy.select("index_name", "correlation_cluster"), "index_name").where(F.col("correlation_cluster") != "unknown")
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.correlation_cluster") == F.col("b.correlation_cluster")) & (F.col("a.pos") < F.col("b.pos")))
    return met.select(F.col("a.index_name").alias("first"), F.col("b.index_name").alias("second"), F.col("a.correlation_cluster").alias("cluster"))


def categories(taxonomy: DataFrame) -> DataFrame:
    """(large_cat, small_cats, indices): counts of each large category."""
    return taxonomy.groupBy("large_cat").agg(F.countDistinct("small_cat").alias("small_cats"), F.countDistinct("index_name").alias("indices"))
