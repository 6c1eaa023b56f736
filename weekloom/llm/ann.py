"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin
first.

The tree's centres are fitted on a bounded sample (``FIT_BYTES``; fewer leaves, if they would have
under four sampled rows each); every row is then put into its leaf. A query
walks the tree with a priority queue (the most promising node next, by the inner product with its
centre plus the length of the query times the node's radius) and visits leaves until their number
is what calibration asks for. Calibration takes a bounded number of the queries, finds their true
neighbours among all rows, and widens the visits until the wanted share of them lies in visited
leaves. Queries and leaves meet in a shuffle, in blocks of bounded size, several small leaves in one
and the best of each query from there; equal vectors are one candidate with its smallest ids, so a
vector that fills a third of the table is one row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.llm.common import written

#: Rows of a leaf on average, most leaves, children of a node, and sampled rows for each leaf.
LEAF_ROWS, MAX_LEAVES, BRANCH, FIT_PER_LEAF = 256, 16_384, 16, 16
#: Most bytes of the sample that the tree is fitted on at the driver; a documented bound.
FIT_BYTES = 64_000_000
#: Queries used for calibration, and the share of their true neighbours to be reached.
CALIBRATION, RECALL = 256, 0.97
#: Vectors and queries that meet in one task at most (in one block).
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 2_048
SALTS = 64


class Tree:
    """Centres, radii and children; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.centres, self.radii, self.children, self.leaf = [sample.mean(0)], [0.0], [[]], [-1]
        n_leaves, queue = 1, [(-len(sample), 0, np.arange(len(sample)))]
        while queue and n_leaves < leaves:  # the largest node is split next
            _, node, rows = heapq.heappop(queue)
            k = min(BRANCH, leaves - n_leaves + 1)
            own = self._kmeans(sample[rows], k, rng) if len(rows) > 1 else np.zeros(len(rows), int)
            kinds = np.unique(own)
            if len(kinds) < 2:
                continue
            n_leaves += len(kinds) - 1
            for kind in kinds:
                part = rows[own == kind]
                x = sample[part]
                self.children[node].append(len(self.centres))
                self.centres.append(x.mean(0))
                self.radii.append(float(np.sqrt(np.square(x - x.mean(0)).sum(1).mean())))
                self.children.append([])
                self.leaf.append(-1)
                heapq.heappush(queue, (-len(part), len(self.centres) - 1, part))
        self.n_leaves = 0
        for i, c in enumerate(self.children):
            if not c:
                self.leaf[i], self.n_leaves = self.n_leaves, self.n_leaves + 1
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)
        self.norms = np.square(self.centres).sum(1)

    @staticmethod
    def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
        centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        own = np.zeros(len(x), int)
        for _ in range(rounds):
            own = (np.square(centres).sum(1) - 2 * x @ centres.T).argmin(1)
            for j in range(len(centres)):
                if (own == j).any():
                    centres[j] = x[own == j].mean(0)
        return own

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child, level by level."""
        node = np.zeros(len(x), int)
        open_ = np.arange(len(x)) if self.children[0] else np.array([], int)
        while len(open_):
            for parent in np.unique(node[open_]):
                rows = open_[node[open_] == parent]
                kids = np.array(self.children[parent])
                node[rows] = kids[(self.norms[kids] - 2 * x[rows] @ self.centres[kids].T).argmin(1)]
            open_ = open_[[bool(self.children[i]) for i in node[open_]]]
        return np.array(self.leaf)[node]

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, most promising first."""
        heap, length = [(0.0, 0)], float(np.sqrt(q @ q))
        while heap:
            _, node = heapq.heappop(heap)
            if kids := self.children[node]:
                for s, kid in zip(self.centres[kids] @ q + length * self.radii[kids], kids, strict=True):
                    heapq.heappush(heap, (-s, kid))
            else:
                yield self.leaf[node]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that take part: an id, and a vector that is not null, zero, or holding
    null or non-finite components, of the table's commonest length (ties: the longer)."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull())
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def _top(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their ranks, ties to the smaller id."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(x: np.ndarray, members: list, q_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, vector id, score) of each query's best ``k`` ids in one block."""
    if not len(x) or not len(q):
        return
    keep = min(len(x), k + 1)  # one may be the query
    scores = q @ x.T
    # all that come up to the last of these, less what the block product can be off by
    least = np.partition(scores, len(x) - keep, axis=1)[:, len(x) - keep] - 1e-10 * np.sqrt(np.square(q).sum(1) * np.square(x).sum(1).max())
    for i in range(len(q)):
        own = np.flatnonzero(scores[i] >= least[i])
        exact = [float(s) for s in (x[own] * q[i]).cumsum(axis=1)[:, -1]]  # summed in order of the components
        found = sorted((-s, m) for s, j in zip(exact, own, strict=True) for m in members[j] if m != q_ids[i])
        for s, m in found[:k]:
            yield int(q_ids[i]), int(m), -s


def exact(candidates: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score, leaf) of the true neighbours of a bounded array of queries, by one
    pass over all candidates (id list ``ids``, vector ``v``, ``leaf``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b.v.tolist()) if len(b) else np.zeros((0, queries.shape[1]))
            leaf = {int(m): int(l) for ms, l in zip(b.ids, b.leaf, strict=True) for m in ms}
            rows = [(*r, leaf[r[1]]) for r in _best(x, list(b.ids), query_ids, queries, k)]
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score", "leaf"])

    return _top(candidates.select("ids", "v", "leaf").mapInPandas(run, "query_id long, vec_id long, score double, leaf int"), k)


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, seed: int = 42) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row for which the column
    ``is_query`` (of ``id``) holds, the row itself left out; all of them if there are fewer.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do those of
    another length than most have (ties: the longer), which have no inner product with the rest. Repeated ids
    are one candidate each time. An empty table gives an empty result; other columns are ignored."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = written(usable(vectors, id_col, vec_col), "vectors")
    n = rows.count()
    if n < 2:
        return spark.createDataFrame([], schema)
    most = max(4, FIT_BYTES // (8 * rows.select(F.size("v")).first()[0]))
    leaves = int(min(MAX_LEAVES, most // 4, max(1, n // LEAF_ROWS)))
    want = min(most, leaves * FIT_PER_LEAF * 2)
    part = rows if n <= want else rows.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < int(1e6 * want / n))
    sample = part.select("v").limit(want).toArrow().column(0).combine_chunks()  # the limit only bounds it
    tree = Tree(sample.flatten().to_numpy(zero_copy_only=False).reshape(len(sample), -1).copy(), leaves, seed)
    shared = spark.sparkContext.broadcast(tree)  # MAX_LEAVES centres and their parents at most

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(leaf=shared.value.assign(np.array(b.v.tolist())) if len(b) else [])

    # equal vectors: their smallest ids are all that k neighbours and the query itself can need
    salted = W.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("id")
    some = rows.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    few = some.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    distinct = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    put = written(distinct.mapInPandas(assign, "v array<double>, ids array<long>, leaf int"), "leaves")
    count = {r["leaf"]: (r["n"], r["m"]) for r in put.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("m")).collect()}  # a row a leaf
    queries = rows.where(is_query(F.col("id")))

    order = queries.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(CALIBRATION).toPandas()
    needed = 1
    if len(order):
        q = np.array(order.v.tolist())
        true = exact(put, q, order.id.to_numpy(), k).toPandas()  # CALIBRATION * k rows at most
        places = {int(i): {leaf: at for at, leaf in enumerate(tree.visits(x), 1)} for i, x in zip(order.id, q, strict=True)}
        reached = sorted(places[int(i)][int(leaf)] for i, leaf in zip(true.query_id, true.leaf, strict=True))
        if reached:
            needed = reached[min(len(reached) - 1, int(np.ceil(recall * len(reached))) - 1)]

    # leaves that follow each other in the tree share a bin while they are small; a large one is a
    # bin of several parts
    bins, filled = {}, BLOCK_ROWS
    for leaf in sorted(count):
        size = count[leaf][0]
        if filled + size > BLOCK_ROWS:
            bins[leaf], filled = leaf, size
        else:
            bins[leaf], filled = last, filled + size
        last = bins[leaf]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        for b in batches:
            out = []
            for i, v in zip(b.id, b.v, strict=True):
                met, seen = 0, {}
                for at, leaf in enumerate(t.visits(np.asarray(v)), 1):
                    met += count.get(leaf, (0, 0))[1]
                    if leaf in bins:
                        seen.setdefault(bins[leaf], []).append(leaf)
                    if at >= needed and met > k:
                        break
                out += [(i, v, bin_, leaves, part) for bin_, leaves in seen.items() for part in range(-(-count[bin_][0] // BLOCK_ROWS))]
            yield pd.DataFrame(out, columns=["query_id", "q", "bin", "leaves", "part"])

    visits = written(queries.mapInPandas(walk, "query_id long, q array<double>, bin int, leaves array<int>, part int"), "visits")
    asked = F.broadcast(visits.where("part = 0").groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("shares")))  # a row a leaf at most
    sizes = F.broadcast(spark.createDataFrame([(a, bins[a], max(1, -(-b[0] // BLOCK_ROWS))) for a, b in count.items()], "leaf int, bin int, parts int"))
    block = lambda c, by: F.pmod(F.xxhash64(c), F.col(by)).cast("int")
    left = visits.join(asked, "bin").select("query_id", "q", "leaves", "bin", "part", block("query_id", "shares").alias("share"))
    right = put.join(sizes, "leaf").withColumn("part", block("v", "parts")).join(asked, "bin").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("ids", "v", "leaf", "bin", "part", "share")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, list] = {}
        if len(a) and len(b):
            x, q, ids, leaf, members = np.array(b.v.tolist()), np.array(a.q.tolist()), a.query_id.to_numpy(), b.leaf.to_numpy(), list(b.ids)
            askers: dict[int, list[int]] = {}
            for row, leaves in enumerate(a.leaves):
                for one in leaves:
                    askers.setdefault(int(one), []).append(row)
            for one, rows in askers.items():
                own = np.flatnonzero(leaf == one)
                for i, m, score in _best(x[own], [members[j] for j in own], ids[rows], q[rows], k):
                    best.setdefault(i, []).append((-score, m))
                for i in set(ids[rows]):  # k of each query so far
                    if len(best.get(i, ())) > k:
                        best[i] = sorted(best[i])[:k]
        out = [(i, m, -s) for i, found in best.items() for s, m in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["bin", "part", "share"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
