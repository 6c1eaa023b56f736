"""Models as versioned Parquet tables. A version is written aside and published by one rename, so that readers see
whole versions only and a failed write leaves the last one as it was."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "version="


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """Published versions of a model in order; none if there is no such model."""
    fs, path = _store(spark, root)
    at = path(f"{root}/{name}")
    if not fs.exists(at):
        return []
    found = (s.getPath().getName() for s in fs.listStatus(at))
    return sorted(int(n.removeprefix(_PREFIX)) for n in found if n.startswith(_PREFIX))


def save(table: DataFrame, root: str, name: str) -> int:
    """Writes the next version and returns its number. If another writer published that number first, the next one is
    tried; what a failed write left aside is deleted."""
    spark = table.sparkSession
    fs, path = _store(spark, root)
    aside = f"{root}/_aside/{uuid.uuid4().hex}"
    try:
        table.write.parquet(aside)
        fs.mkdirs(path(f"{root}/{name}"))
        number = (versions(spark, root, name) or [0])[-1]
        for number in range(number + 1, number + 1000):  # beyond the last one, however many publish at once
            at = path(f"{root}/{name}/{_PREFIX}{number}")
            # a rename into an existing folder would put the table inside it: publish only where nothing is
            if not fs.exists(at) and fs.rename(path(aside), at):
                return number
        raise OSError(f"could not publish {name} in {root}")
    finally:
        fs.delete(path(aside), True)


def load(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A version of a model, the latest unless given; FileNotFoundError without one."""
    there = versions(spark, root, name)
    if not there or (version is not None and version not in there):
        raise FileNotFoundError(f"no version {version or ''} of {name} in {root}")
    return spark.read.parquet(f"{root}/{name}/{_PREFIX}{version or there[-1]}")
