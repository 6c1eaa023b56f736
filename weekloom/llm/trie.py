"""Prefix trie of conversations by Patricia construction.

A conversation is a path of turn digests. Distinct paths are sorted over ranges, and in sorted order
only three kinds of points are made: where neighbours part, where a path ends, and leaves; an edge
keeps the sizes of the turns between its points. Aggregates are sums over a point's interval of paths,
so what neighbouring ranges share is summed up afterwards: each range makes the points of the prefixes
that it shares with the range before or after (one for every turn), and those alone are merged. In
the end the unary nodes of an edge follow from its lower point and the edge's suffix sums.

A conversation is one row of 36 bytes a turn, which bounds its length by memory; any number of them may share a
prefix or be equal. Ids of equal conversations are never in one row: sorted blocks of them are hashed as
a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.llm.common import scratch, small, written

#: Hex characters of a turn's digest.
WIDTH = 32
#: Ids in a block of equal conversations.
BLOCK = 4096
#: Points shared by ranges that may be broadcast (some 40 bytes each).
SHARED_ROWS = 200_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with the turns (digest, size) of every conversation, by turn, null first; equal turns by
    digest. Null role and text are empty. Rows without a conv_id belong to none and are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, WIDTH)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.length(text).alias("size")).alias("t"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuilt(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, path, sizes): the first h turns of the conversation that begins the id's hundred, then the own turns
    after the first h; h = crc32(id) mod ``most``."""
    own = written(own_turns(conversations), "turns")
    none = F.slice("turns", 1, 0)
    base = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    rows = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    rows = rows.join(base, "base", "left").withColumn("all", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))))
    return rows.select("conv_id", F.array_join(F.col("all.digest"), "").alias("path"), F.col("all.size").alias("sizes"))


def _stream(rows: DataFrame, run, schema: str) -> DataFrame:
    """``run`` turns an iterator of dicts (the rows of a partition) into one of tuples."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    types = [kinds[c.strip().split(" ")[1]] for c in schema.split(",")]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> Iterator[dict]:
            for b in found:
                for i in range(0, b.num_rows, 1000):
                    yield from b.slice(i, 1000).to_pylist()

        held: list[tuple] = []
        for row in run(given()):
            held.append(row)
            if len(held) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    return rows.mapInArrow(batches, schema)


def _blocks(rows: Iterator[dict]) -> Iterator[tuple]:
    """Runs of equal paths, sorted by id, as blocks of at most BLOCK ids."""
    head, ids = None, []
    for r in rows:
        if head is not None and (head["key"] != r["key"] or len(ids) == BLOCK):
            yield head["key"], ids[0], len(ids), ",".join(map(str, ids)), head["path"], head["sizes"]
            head, ids = None, []
        head = head or r
        ids.append(r["conv_id"])
    if head is not None:
        yield head["key"], ids[0], len(ids), ",".join(map(str, ids)), head["path"], head["sizes"]


def _hashed(rows: Iterator[dict]) -> Iterator[tuple]:
    """Blocks of a path, in order, as its number of ids, the least and their digest."""
    head, n, sha = None, 0, None
    for r in rows:
        if head is not None and head["key"] != r["key"]:
            yield head["path"], head["sizes"], n, head["first"], sha.hexdigest()
            head = None
        if head is None:
            head, n, sha = r, 0, hashlib.sha256()
        else:
            sha.update(b",")
        sha.update(r["ids"].encode())
        n += r["n"]
    if head is not None:
        yield head["path"], head["sizes"], n, head["first"], sha.hexdigest()


def distinct_paths(convs: DataFrame) -> DataFrame:
    """(path, sizes, n, least, ends): distinct conversations with their ids' number, least and digest. Equal
    conversations are dealt over ranges by id, whatever their number."""
    keyed = convs.withColumn("key", F.md5("path"))
    blocks = _stream(keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id"), _blocks, "key string, first long, n long, ids string, path string, sizes array<int>")
    return _stream(blocks.repartition("key").sortWithinPartitions("key", "first"), _hashed, "path string, sizes array<int>, n long, least long, ends string")


def shared_turns(a: str | None, b: str | None) -> int:
    """Leading turns that two paths share."""
    if a is None or b is None:
        return 0
    n = min(len(a), len(b)) // WIDTH
    low, high = 0, n
    while low < high:  # the longest equal prefix by bisection: each comparison is one of memory
        mid = (low + high + 1) // 2
        if a[: mid * WIDTH] == b[: mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


@dataclass
class _Point:
    depth: int
    forced: bool = False  # shared with a range beside
    seen: bool = False  # made by the range before already
    n: int = 0
    least: int | None = None
    kids: int = 0
    leaves: int = 0
    below: int = 0  # sizes of the nodes below, each times its members
    once: int = 0  # the same sizes, each once
    ends: str | None = None


@dataclass
class _Range:
    """Points of one range of sorted paths."""

    before: int  # turns shared with the range before
    after: int  # and with the range after
    stack: list[_Point] = field(default_factory=list)
    path: str | None = None
    sizes: list[int] = field(default_factory=list)
    keys: list[bytes] = field(default_factory=list)
    made: list[tuple] = field(default_factory=list)

    def _close(self, upto: int) -> None:
        """Closes the points deeper than ``upto``, where a point is made if there is none."""
        while self.stack[-1].depth > upto:
            v = self.stack.pop()
            if self.stack[-1].depth < upto:
                self.stack.append(_Point(upto))
            p = self.stack[-1]
            edge = self.sizes[p.depth : v.depth]
            p.n += v.n
            p.least = v.least if p.least is None else min(p.least, v.least)
            p.leaves += v.leaves
            p.below += v.below + v.n * sum(edge)
            p.once += v.once + (0 if v.seen else sum(edge))
            p.kids += not v.seen
            self._emit(v, p.depth, edge)

    def _emit(self, v: _Point, parent: int, edge: list[int]) -> None:
        rest, suffix = [0] * max(1, len(edge)), 0
        for i in range(len(edge) - 2, -1, -1):
            suffix += edge[i]
            rest[i] = suffix
        last = edge[-1] if edge else 0
        spans = v.forced or v.depth == 0
        self.made.append((self.keys[v.depth].hex(), self.keys[parent].hex() if v.depth else None, parent if v.depth else -1, v.depth, rest, last, v.n, v.least, v.kids, v.leaves, v.below, v.once, v.ends, spans))

    def add(self, path: str, sizes: list[int], n: int, least: int, ends: str) -> None:
        length, common = len(path) // WIDTH, shared_turns(self.path, path)
        if self.path is None:
            self.stack = [_Point(d, forced=True, seen=True) for d in range(self.before + 1)]
            self.keys = [b""]
        else:
            self._close(common)
            if self.stack[-1].depth < common:
                self.stack.append(_Point(common))
            del self.keys[common + 1 :]
        for d in range(len(self.keys) - 1, length):
            self.keys.append(hashlib.blake2b(self.keys[-1] + path[d * WIDTH : (d + 1) * WIDTH].encode(), digest_size=16).digest())
        self.path, self.sizes = path, sizes
        if self.stack[-1].depth < length:
            self.stack.append(_Point(length))
        end = self.stack[-1]
        # a leaf until a longer path comes: the next one in this range, or the first of the range after
        end.n, end.least, end.ends, end.leaves = n, least, ends, 1

    def extend(self) -> None:
        """The path before turns out to be the beginning of the next: no leaf."""
        self.stack[-1].leaves = 0

    def finish(self) -> None:
        if self.after == len(self.path) // WIDTH:
            self.stack[-1].leaves = 0
        full: list[_Point] = []
        for p in self.stack:
            have = full[-1].depth if full else -1
            full += [_Point(d, forced=True) for d in range(have + 1, min(p.depth, self.after + 1))]
            p.forced = p.forced or p.depth <= self.after
            full.append(p)
        self.stack = full
        self._close(0)
        self._emit(self.stack[0], 0, [])


def _points(rows: Iterator[dict]) -> Iterator[tuple]:
    part, at = None, None
    for r in rows:
        if at is None or part != r["part"]:
            if at is not None:
                at.finish()
                yield from at.made
            part, at = r["part"], _Range(r["before"], r["after"])
        elif r["path"].startswith(at.path):
            at.extend()
        at.add(r["path"], r["sizes"], r["n"], r["least"], r["ends"])
        if len(at.made) > 1000:
            yield from at.made
            at.made = []
    if at is not None:
        at.finish()
        yield from at.made


POINT = "key string, parent string, above int, depth int, rest array<long>, last long, n long, least long, kids long, leaves long, below long, once long, ends string, spans boolean"


def points(paths: DataFrame) -> DataFrame:
    """The compressed tree of distinct paths, points shared by ranges merged."""
    ranged = written(paths.repartitionByRange("path").withColumn("part", F.spark_partition_id()), "paths")

    @F.pandas_udf("int")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([shared_turns(x, y) for x, y in zip(a, b)], dtype="int32")

    order = W.orderBy("part")  # one row a range
    bounds = ranged.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("final"))
    bounds = bounds.select("part", "first", "final", F.lag("final").over(order).alias("x"), F.lead("first").over(order).alias("y"))
    bounds = written(bounds.select("part", shared("x", "first").alias("before"), shared("final", "y").alias("after")), "bounds")
    rows = ranged.join(F.broadcast(bounds), "part").repartitionByRange("part").sortWithinPartitions("part", "path")
    found = written(_stream(rows, _points, POINT), "points")
    sums = [F.sum(c).alias(c) for c in ("n", "kids", "leaves", "below", "once")]
    same = [F.first(c).alias(c) for c in ("parent", "above", "depth", "rest", "last")]
    merged = found.where("spans").groupBy("key").agg(*same, *sums, F.min("least").alias("least"), F.max("ends").alias("ends"), F.lit(True).alias("spans"))
    return found.where("NOT spans").unionByName(merged)


def nodes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for every node of the
    trie of rebuilt conversations. An empty table has no nodes, not even a root."""
    with scratch() as keep:
        found = keep(written(points(distinct_paths(rebuilt(conversations))), "tree"))
    up = found.select(F.col("key").alias("parent"), F.col("least").alias("up"), "spans")
    shared = small(up.where("spans").select("parent", "up"), SHARED_ROWS)
    local = up.where("NOT spans").select("parent", F.col("up").alias("near"))
    # a parent that ranges share may have any number of children; another has those of one range at most
    rows = found.join(shared, "parent", "left")
    rows = rows.where("up IS NOT NULL OR parent IS NULL").select(*found.columns, "up").unionByName(rows.where("up IS NULL AND parent IS NOT NULL").join(local, "parent").select(*found.columns, F.col("near").alias("up")))
    saved = F.col("below") - F.col("once") + (F.col("n") - 1) * F.col("last")
    rows = rows.select("*", saved.alias("saved"), F.size("rest").alias("k")).select("*", F.posexplode("rest").alias("j", "suffix"))
    lowest = F.col("j") == F.col("k") - 1
    return rows.select(
        F.col("least").alias("conv_id"), (F.col("above") + 1 + F.col("j")).cast("long").alias("depth"), F.when(F.col("j") == 0, F.col("up")).otherwise(F.col("least")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(lowest, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * F.col("suffix")).alias("saved_tokens"),
        F.when(lowest, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )
