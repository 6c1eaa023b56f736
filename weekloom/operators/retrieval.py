"""Similar cases by TF-IDF: statistics by aggregation, products where a document is read."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.functions.text import joined, tokens
from weekloom.operators.metrics import ranked
from weekloom.sources.shared import forget, written


def vocabulary_of(docs: DataFrame, text_col: str, size: int = 5000) -> tuple[list[tuple[str, float]], int]:
    """The commonest terms (ties by term) with their smoothed inverse document frequencies, and the number of
    documents, in one pass: occurrences and documents of a term are summed up before they are shuffled."""
    said = F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>"))
    kind = lambda n, d: lambda t: F.struct(t.alias("term"), F.lit(n).alias("cf"), F.lit(d).alias("df"))
    every = F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("cf"), F.lit(1).alias("df"))  # a document
    rows = docs.select(said.alias("said")).select(F.explode(F.concat(F.array(every), F.transform("said", kind(1, 0)), F.transform(F.array_distinct("said"), kind(0, 1)))).alias("t"))
    terms = rows.groupBy("t.term").agg(F.sum("t.cf").alias("cf"), F.sum("t.df").alias("df"))
    terms = written(terms, "terms")
    n = terms.where("term IS NULL").select("df").first()
    vocab = terms.where("term IS NOT NULL").orderBy(F.desc("cf"), "term").limit(size)  # the feature: a bounded vocabulary
    found = [] if n is None else [(r.term, r.idf) for r in vocab.select("term", (F.log((F.lit(1.0) + n.df) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf")).collect()]
    forget(terms)
    return found, 0 if n is None else n.df


def similarities(docs: DataFrame, vocab: list[tuple[str, float]], asked: dict[str, int], id_col: str, text_col: str) -> DataFrame:
    """(id, similarity) of every document: the cosine of its weighted terms and the query's, without a shuffle. A
    document's terms are counted where it is read; 0 without a common term."""
    terms = pa.array([t for t, _ in vocab], pa.string())
    idf = np.array([w for _, w in vocab])
    q = np.array([asked.get(t, 0) for t, _ in vocab]) * idf if vocab else np.zeros(0)
    length = float(np.sqrt((q * q).sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            at = pc.index_in(lists.flatten(), value_set=terms)
            doc = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            known = at.is_valid().to_numpy(zero_copy_only=False)
            pair, tf = np.unique(doc[known] * max(len(idf), 1) + at.drop_null().to_numpy(), return_counts=True)
            x = tf * idf[pair % max(len(idf), 1)]
            of = pair // max(len(idf), 1)
            dot = np.bincount(of, weights=x * q[pair % max(len(idf), 1)], minlength=b.num_rows)
            norm = np.sqrt(np.bincount(of, weights=x * x, minlength=b.num_rows))
            s = np.divide(dot, norm * length, out=np.zeros(b.num_rows), where=norm * length > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["id", "similarity"])

    kind = docs.schema[id_col].dataType.simpleString()
    said = F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>"))
    return docs.select(F.col(id_col).alias("id"), said.alias("said")).mapInArrow(run, f"id {kind}, similarity double")


def similar(docs: DataFrame, query: str, k: int = 5, id_col: str = "id", text_col: str = "text", vocabulary: int = 5000, as_of: tuple[str, str] | None = None) -> DataFrame:
    """(id, similarity): the ``k`` documents closest to a query by cosine, ties to the smaller id;
    those without a common term count as 0. An empty query finds nothing. ``as_of``: (date column,
    date) leaves out later documents, from the statistics too. Null text is an empty document: it
    counts, and can be found with similarity 0."""
    if as_of is not None:
        docs = docs.where(F.col(as_of[0]) <= F.lit(as_of[1]).cast("date"))
    if not query.strip():
        return docs.limit(0).select(F.col(id_col).alias("id"), F.lit(0.0).alias("similarity"))
    vocab, _ = vocabulary_of(docs, text_col, vocabulary)
    asked = Counter(docs.sparkSession.range(1).select(tokens(F.lit(query)).alias("t")).first().t)
    return similarities(docs, vocab, asked, id_col, text_col).orderBy(F.desc("similarity"), "id").limit(k)


def history(news: DataFrame, query: str, k: int = 5, as_of: tuple[str, str] | None = None) -> DataFrame:
    """Similar articles of a news table by title and content."""
    return similar(news.withColumn("__text", joined(F.col("title"), F.col("content"))), query, k, "doc_id", "__text", as_of=as_of)


def rendered(news: DataFrame, chars: int = 200, order: str = "d") -> DataFrame:
    """(rank, doc_id, text, n): the line of each article, its place (latest first, then by greater
    id) and how many there are. No articles give no rows."""
    line = F.concat_ws(" | ", F.col(order).cast("string"), F.coalesce("source", F.lit("")), F.substring(F.coalesce("title", F.lit("")), 1, chars))
    placed = ranked(news.select("doc_id", line.alias("text"), (-F.unix_date(order)).alias("__o"), (-F.col("doc_id")).alias("__i")), ("__o", "__i"))
    return placed.join(F.broadcast(placed.agg(F.count(F.lit(1)).alias("n")))).select("rank", "doc_id", "text", "n")
