"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.sources import workbooks

_INDUSTRY = "map<string,map<string,struct<indices:array<string>,beta:string,correlation_cluster:string>>>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None, missing: str = "raise") -> DataFrame:
    """A Parquet table. If it is not there: an error, or with ``missing="empty"`` an empty table of
    ``schema``."""
    if missing == "empty" and schema is not None and not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", by: tuple[str, ...] = ()) -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """With a header; types are inferred unless given."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def csv_to_parquet(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Every CSV file of a folder as a Parquet table of its name; rows (name, rows)."""
    paths = [r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").collect()]  # file names only
    counts = [_to_parquet(read_csv(spark, path), out, path.rsplit("/", 1)[-1].removesuffix(".csv")) for path in sorted(paths)]
    return spark.createDataFrame(counts, "name string, rows long")


def _to_parquet(rows: DataFrame, out: str, name: str) -> tuple[str, int]:
    path = f"{out}/{name}.parquet"
    write_parquet(rows, path)
    return name, rows.sparkSession.read.schema(rows.schema).parquet(path).count()


def sheet_table(sheet: str) -> str:
    """A sheet's name as part of a file's."""
    return sheet.replace("/", "_").replace("\\", "_")


def xlsx_to_parquet(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Every sheet of every workbook of a folder (or of one file) as a Parquet table workbook_sheet; rows (name, rows)."""
    counts = []
    for r in sorted(workbooks.sheets(spark, folder).collect(), key=lambda r: (r.path, r.place)):  # names and types
        stem = r.path.rsplit("/", 1)[-1].removesuffix(".xlsx")
        counts.append(_to_parquet(workbooks.read_sheet(spark, r.path, r.sheet, r.columns, r.types), out, f"{stem}_{sheet_table(r.sheet)}"))
    return spark.createDataFrame(counts, "name string, rows long")


def to_parquet(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Every CSV file and every sheet of every workbook of a folder as Parquet tables; rows (name, rows)."""
    return csv_to_parquet(spark, folder, out).unionByName(xlsx_to_parquet(spark, folder, out))


def taxonomy_from_json(text: DataFrame, col: str = "value") -> DataFrame:
    """The nested industry document, one JSON text a row, as one row for each index. A missing beta
    is medium, a missing cluster the small category's name; an index listed again wins later."""
    large = text.select(F.explode(F.from_json(col, _INDUSTRY)).alias("large_cat", "small"))
    small = large.select("large_cat", F.explode("small").alias("small_cat", "v"))
    rows = small.select("large_cat", "small_cat", F.posexplode("v.indices").alias("pos", "index_name"), F.coalesce("v.beta", F.lit("medium")).alias("beta"), F.coalesce("v.correlation_cluster", "small_cat").alias("correlation_cluster"))
    return rows.drop("pos")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return taxonomy_from_json(spark.read.text(path, wholetext=True))


def label_statistics(text: DataFrame, col: str = "value") -> DataFrame:
    """(major, sub, n) from a label statistics document; sub is null for a major's own count."""
    doc = text.select(F.from_json(col, "major_category map<string,long>, sub_category_by_major map<string,map<string,long>>").alias("j"))
    major = doc.select(F.explode("j.major_category").alias("major", "n")).select("major", F.lit(None).cast("string").alias("sub"), "n")
    sub = doc.select(F.explode("j.sub_category_by_major").alias("major", "subs")).select("major", F.explode("subs").alias("sub", "n"))
    return major.unionByName(sub)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_weekly_returns(returns: DataFrame, path: str) -> None:
    """Adds (ws, industry, r) rows; the long form needs no rewrite of what is there."""
    returns.select("ws", "industry", "r").write.mode("append").parquet(path)


def cached_table(spark: SparkSession, path: str, build, force: bool = False) -> DataFrame:
    """The table at ``path``; built and written first if it is not there or ``force`` is set."""
    if force or not exists(spark, path):
        write_parquet(build(), path)
    return spark.read.parquet(path)
