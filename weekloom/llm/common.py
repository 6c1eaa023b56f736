"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: runs of anything but ASCII white space.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary folder is set; on
    a cluster that raises, since its machines would not see the folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="weekloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def counted(df: DataFrame, **more: Column) -> DataFrame:
    """``df``, whose number of ``rows`` and aggregates ``more`` are observed while it is ``written``
    and are then known as ``measured``: a count of its own would be another query, with its plan,
    stages and broadcasts on the driver."""
    seen = Observation()
    found = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in more.items()])
    found.observed_by = seen
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage is cut, and a lost
    executor costs a re-read instead of a recomputation. What is not deleted before is deleted
    when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weekloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    if "observed_by" in vars(df):
        found.measured = df.observed_by.get
    if _open:
        _open[-1].append(found)
    return found


#: Tables written in each scope of ``scratch`` that is open.
_open: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope at whose end the tables written in it are deleted, but for those (of ``written``)
    that were given to the function it yields."""
    _open.append([])
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        forget(*(t for t in _open.pop() if all(t is not k for k in kept)))
        if _open:
            _open[-1].extend(kept)


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` once what was made of them is written itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, n: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``rows`` rows; otherwise as it is, to be
    joined by a shuffle. It has ``n`` rows; if that is not given, as many as were ``counted`` when it
    was written, or else as are counted now, which must be cheap."""
    if n is None:
        n = vars(df).get("measured", {}).get("rows")
    return F.broadcast(df) if (df.count() if n is None else n) <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text):
    """Number of words of a text column, 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
