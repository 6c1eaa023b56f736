"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

All sources rise with a common level, each by its weight, and stop at ``max_epochs`` times their
size; the level is where the targets add up to the size of the whole corpus. So what a capped
source leaves over goes to the others by weight. A source is read whole as many times as its
target allows; the fraction left is a prefix of its documents in a seeded order.

That order is never sorted as a whole: sums over two-digit prefixes of the documents' hashes find
the prefix in which the fraction ends, three times over, and only the documents behind the last
prefix (one in sixteen million of the source's) are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.llm.common import n_words, small, written

#: Sources up to which their one-row-each table is broadcast.
BROADCAST_SOURCES = 20_000
LEVELS = 3


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size), one for each source.

    Sources in code point order, null last, have the weights in turn. Sources of size zero get
    target zero. One row a source is all that the unpartitioned windows see."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(int(w)) for w in weights])
    s = sizes.withColumn("w", F.element_at(kinds, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * max_epochs)
    full = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest, every = full.rowsBetween(W.unboundedPreceding, -1), full.rowsBetween(0, W.unboundedFollowing), W.partitionBy(F.lit(1))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    s = s.withColumn("capped", left * F.col("w") >= F.col("cap") * F.sum("w").over(rest))
    free = F.sum(F.when(~F.col("capped"), F.col("w"))).over(every)
    over = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    level = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * over.cast("double") / free.cast("double"))
    return s.select("source", "source_size", level.alias("target"))


def _goal() -> Column:
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return F.col("target") - whole * F.col("source_size")


def plan(sized: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """One row a source: size, target, the hash prefix in which its fraction ends and what of the
    fraction is left there. ``sized`` has source, size and order; it is read four times."""
    per = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs), "targets")
    edges = per.select("source", F.lit("").alias("edge"), _goal().alias("rest"))
    for k in range(1, LEVELS + 1):
        behind = _with(sized.select("source", "size", "order"), edges).where(F.col("order").startswith(F.col("edge")))
        cells = behind.groupBy("source", F.substring("order", 1, 2 * k).alias("cell")).agg(F.sum("size").alias("s"), F.first("rest").alias("rest"))
        # 256 cells a source at most
        run = F.coalesce(F.sum("s").over(W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        found = cells.withColumn("run", run).where("run <= rest and run + s > rest")
        edges = written(found.select("source", F.col("cell").alias("edge"), (F.col("rest") - F.col("run")).alias("rest")), "edges")
    e = edges.withColumnRenamed("source", "__s")
    return written(per.join(e, per["source"].eqNullSafe(e["__s"]), "left").drop("__s"), "plan")


def _with(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    other = small(per_source, BROADCAST_SOURCES).withColumnRenamed("source", "__s")
    return rows.join(other, rows["source"].eqNullSafe(other["__s"])).drop("__s")


def prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """``docs`` packed under ``row``, with id, source, size and order: an MD5 of seed, id and text, so
    that only rows alike in both have equal places, and either may go first."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("|"), F.coalesce(F.col(text_col), F.lit(""))))
    return docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), order.alias("order"))


def decided(rows: DataFrame, per_source: DataFrame, max_epochs: int) -> DataFrame:
    """``rows`` with target, source_size and ``times``: how often the mix takes each of them."""
    all_rows = _with(rows, per_source).withColumn("__p", F.substring("order", 1, 2 * LEVELS))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    at_edge = F.coalesce(F.col("__p") == F.col("edge"), F.lit(False))
    sure = all_rows.where(~at_edge).withColumn("__more", F.coalesce((F.col("__p") < F.col("edge")).cast("int"), F.lit(0)))
    before = F.coalesce(F.sum("size").over(W.partitionBy("source", "__p").orderBy("order", "id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    close = all_rows.where(at_edge).withColumn("__more", (2 * before + F.col("size") <= 2 * F.col("rest")).cast("int"))
    return sure.unionByName(close).withColumn("times", F.least(whole + F.col("__more"), F.lit(max_epochs)).cast("long")).drop("__p", "__more", "edge", "rest")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """(id, source, size, source_size, target, times, taken) for every row of ``docs``.

    A null text has size zero; a null source is a source of its own, last in order; repeated rows
    have one place in the order after another; so have rows of null or equal id, by their texts. Each source's sum of
    ``taken`` is within half a document of its target. An empty table gives an empty result."""
    sized = written(prepared(docs, id_col, text_col, source_col, seed).select("id", "source", "size", "order"), "sized")
    return decided(sized, plan(sized, weights, max_epochs), max_epochs).withColumn("taken", F.col("times") * F.col("size")).drop("order")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as ``times`` says, in the same columns."""
    rows = prepared(docs, id_col, text_col, source_col, seed)
    per = plan(written(rows.select("id", "source", "size", "order"), "sized"), weights, max_epochs)
    taken = decided(rows, per, max_epochs).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")
