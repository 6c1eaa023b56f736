"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its UTF-8 bytes and a terminator, a byte that UTF-8 never has, so that the probabilities of all
texts sum to one. A byte is eight binary decisions. For each, a predictor of every order (0 to 5 bytes of
context) has counts of both outcomes in a slot found by hashing the context and the bits read; the
stretched probabilities are added up with weights that a gate selects (the longest context seen, and the
bit's position), learned online by gradient steps; a table of outcomes by gate and mixed probability, learned
along the way, refines the result.

All depends on a position through its window of six bytes only. So the corpus is gathered as the counts
of its distinct windows, by Spark, and what is learned is learned from that table, which grows with the input:

* predictors' slots are grouped into regions; a region's windows meet in one task, which streams them into
  a dense block. Slots double with the windows up to 4 million an order (50 MB in all: what is broadcast).
* weights learn online in shards of windows, an occurrence always being predicted without itself, and are
  averaged; a second round begins with the average. Sums are of decimals, so their order is of no account.

Scoring takes each chunk's distinct windows and adds their logarithms by text. The model is fixed then: a
text's score depends on no other text scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import scratch, written

ORDERS = 6
PAD = b"\xff" * (ORDERS - 1)
END = b"\xff"
#: Windows that a worker looks at together, and grams of a step of the learner.
CHUNK, STEP = 8_000_000, 4096
#: Regions of an order's slots; slots of an order at least and at most (as powers of two).
REGIONS, LEAST_SLOTS, MOST_SLOTS = 256, 18, 22
#: Windows of a shard that learns in order.
SHARD = 1 << 18
GATES = ORDERS * 8
BUCKETS = 33
#: Tokens whose counts are broadcast at most (64 bytes each at most); the rest are joined.
FREQUENT = 1 << 18
_MULT, _ADD = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03  # fixed values: odd 64-bit constants that mix well


def pieces(texts: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of texts in chunks, and the text of each: a window is six bytes, the last is the one predicted."""
    held, owner, size = [], [], 0
    for k, text in enumerate(texts):
        padded = PAD + text + END
        for i in range(0, len(text) + 1, CHUNK):
            part = padded[i : i + CHUNK + ORDERS - 1]
            held.append(part)
            owner.append(k)
            size += len(part)
            if size >= CHUNK:
                yield _windows(held, owner)
                held, owner, size = [], [], 0
    if held:
        yield _windows(held, owner)


def _windows(parts: list[bytes], owner: list[int]) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(b"".join(parts), np.uint8)
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    grams = np.zeros(len(a) - ORDERS + 1, np.uint64)
    for j in range(ORDERS):
        grams <<= np.uint64(8)
        grams |= a[j : j + len(grams)]
    across = np.ones(len(a), bool)
    across[(np.cumsum(n)[:, None] - np.arange(1, ORDERS)).ravel()] = False
    return grams[across[: len(grams)]], np.repeat(np.array(owner), n - ORDERS + 1)


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A to Z in lower case."""
    return text.lower().split()


def _training_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, gram, c) rows: tokens with their counts, an empty one for each text's end, and windows."""
    said: Counter[bytes] = Counter()

    def texts() -> Iterator[bytes]:
        for b in batches:
            for t in b.column(0):
                text = (t.as_py() or "").encode()
                said.update(tokens(text))
                said[b""] += 1
                yield text

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(said.keys(), pa.binary()), pa.nulls(len(said), pa.int64()), pa.array(said.values(), pa.int64())], names=["token", "gram", "c"])
        said.clear()
        return out

    for grams, _ in pieces(texts()):
        code, kinds = pd.factorize(grams)
        c = np.bincount(code, minlength=len(kinds))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(kinds), pa.binary()), pa.array(kinds.astype(np.int64)), pa.array(c.astype(np.int64))], names=["token", "gram", "c"])
        if len(said) > 500_000:
            yield flushed()
    yield flushed()


def training_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, gram, c) of all texts: counts of distinct tokens (gram null) and of distinct windows (token null)."""
    return docs.select(text_col).mapInArrow(_training_counts, "token binary, gram long, c long").groupBy("token", "gram").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """``pairs``: for every order and slot the counts of both outcomes, a byte each; ``weights`` by gate and order, the
    last for the bias; ``refined``: by gate and bucket the stretched share of ones."""

    bits: int
    pairs: np.ndarray
    weights: np.ndarray
    refined: np.ndarray


def slots_of(context: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Region and first slot of contexts; the bits read so far (1 to 255) are then added by exclusive or."""
    h = (context + np.uint64((order + 1) * _ADD & (1 << 63) - 1)) * np.uint64(_MULT)
    h ^= h >> np.uint64(32)
    h *= np.uint64(_MULT)
    return (h >> np.uint64(56)).astype(np.int64), ((h >> np.uint64(20)) & np.uint64((1 << bits) // REGIONS - 1)).astype(np.int64)


def context_of(grams: np.ndarray, order: int) -> np.ndarray:
    return (grams >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1)


def _levels(bits: int):
    """Windows cut to every order's length, with the region of their context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, c = b.column(0).to_numpy().astype(np.uint64), b.column(1).to_numpy()
            for k in range(ORDERS):
                code, kinds = pd.factorize(grams & np.uint64((1 << 8 * (k + 1)) - 1))
                region, _ = slots_of(context_of(kinds, k), k, bits)
                sums = np.bincount(code, weights=c, minlength=len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), k, np.int32)), pa.array(region.astype(np.int32)), pa.array(kinds.astype(np.int64)), pa.array(sums)], names=["k", "region", "gram", "c"])

    return run


def packed(n: np.ndarray) -> np.ndarray:
    """Pairs of counts as bytes; larger ones are scaled down together and stay above zero."""
    most = n.max(axis=1, keepdims=True)
    return np.ceil(np.where(most > 255, n * (255 / np.maximum(most, 1)), n)).astype(np.uint8)


def _regions(bits: int):
    """Dense blocks of counts from windows that come sorted by order and region."""
    size = (1 << bits) // REGIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, np.zeros((size, 2))

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at // REGIONS], pa.int32()), pa.array([at % REGIONS], pa.int32()), pa.array([packed(n).tobytes()], pa.binary())], names=["k", "region", "block"])

        for b in batches:
            key = b.column(0).to_numpy().astype(np.int64) * REGIONS + b.column(1).to_numpy()
            grams, c = b.column(2).to_numpy().astype(np.uint64), b.column(3).to_numpy().astype(float)
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1), len(key)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if at is not None and key[i] != at:
                    yield block()
                    n[:] = 0
                at = int(key[i])
                _, first = slots_of(context_of(grams[i:j], at // REGIONS), at // REGIONS, bits)
                byte = (grams[i:j] & np.uint64(255)).astype(np.int64)
                for bit in range(8):
                    where = 2 * (first ^ (1 << bit | byte >> (8 - bit))) + (byte >> (7 - bit) & 1)
                    n += np.bincount(where, weights=c[i:j], minlength=2 * size).reshape(size, 2)
        if at is not None:
            yield block()

    return run


def stretch_table() -> np.ndarray:
    """Stretched probability of a one for every pair of counts (zeros in the low byte)."""
    zeros, ones = np.arange(65536) & 255, np.arange(65536) >> 8
    return np.log((ones + 0.4) / (zeros + 0.4)).astype(np.float32)


def _without_one(pair: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The pair as it was before one occurrence of ``bit``; a full count stays as it is."""
    count = np.where(bit, pair >> 8, pair & 255)
    return pair - np.where((count > 0) & (count < 255), np.where(bit, 256, 1), 0)


class Mixer:
    def __init__(self, model: Model):
        self.model, self.table = model, stretch_table()

    def decisions(self, grams: np.ndarray, without: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each bit of the windows' last bytes: the bit, the gate and the inputs (the last is 1)."""
        m = self.model
        first = []
        for k in range(ORDERS):
            region, local = slots_of(context_of(grams, k), k, m.bits)
            first.append(region * ((1 << m.bits) // REGIONS) + local)
        byte = (grams & np.uint64(255)).astype(np.int64)
        for i in range(8):
            node, bit = 1 << i | byte >> (8 - i), byte >> (7 - i) & 1
            x = np.ones((len(grams), ORDERS + 1), np.float32)
            seen = np.zeros(len(grams), np.int64)
            for k in range(ORDERS):
                pair = m.pairs[k][first[k] ^ node].astype(np.int64)
                if without:
                    pair = _without_one(pair, bit)
                x[:, k] = self.table[pair]
                seen[pair != 0] = k
            yield bit, seen * 8 + i, x

    def mixed(self, gate: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", self.model.weights[gate], x), -12, 12)

    def refined(self, gate: np.ndarray, st: np.ndarray) -> np.ndarray:
        at, part = buckets(st)
        r = self.model.refined
        return np.clip((st + r[gate, at] * (1 - part) + r[gate, at + 1] * part) / 2, -12, 12)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """Log10 probability of the windows' last bytes in their contexts."""
        out = np.zeros(len(grams))
        for i in range(0, len(grams), 1 << 15):
            part = slice(i, i + (1 << 15))
            for bit, gate, x in self.decisions(grams[part]):
                st = self.refined(gate, self.mixed(gate, x))
                out[part] -= np.logaddexp(0.0, np.where(bit == 1, -st, st))
        return out / np.log(10)


def buckets(st: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of a stretched probability (two a unit from -8 to 8) and the share of the next one."""
    place = (np.clip(st, -7.999, 7.999) + 8) * 2
    at = place.astype(np.int64)
    return at, place - at


def start(bits: int, pairs: np.ndarray) -> Model:
    weights = np.full((GATES, ORDERS + 1), 0.25)
    weights[:, ORDERS] = 0
    return Model(bits, pairs, weights, np.tile(np.linspace(-8, 8, BUCKETS), (GATES, 1)))


def learn(model: Model, grams: np.ndarray, c: np.ndarray, squares: np.ndarray, mass: np.ndarray, outcomes: np.ndarray) -> None:
    """One online step of the weights: each gate's mean gradient, scaled by the squares so far; outcomes are counted
    with the weights as they were before."""
    mixer = Mixer(model)
    push, seen = np.zeros_like(model.weights), np.zeros(GATES)
    for bit, gate, x in mixer.decisions(grams, without=True):
        st = mixer.mixed(gate, x)
        error = c * (bit - 1 / (1 + np.exp(-st)))
        for j in range(ORDERS + 1):
            push[:, j] += np.bincount(gate, weights=error * x[:, j], minlength=GATES)
        seen += np.bincount(gate, weights=c, minlength=GATES)
        at, part = buckets(st)
        for to, share in ((at, 1 - part), (at + 1, part)):
            outcomes += np.bincount((gate * BUCKETS + to) * 2 + bit, weights=c * share, minlength=outcomes.size).reshape(outcomes.shape)
    push /= np.maximum(seen, 1)[:, None]
    squares += push**2
    model.weights += 0.05 * push / np.sqrt(squares + 1e-8)
    mass += seen


def _learned(model):
    """Each shard of windows, in a fixed order, through the learner: rows (what, at, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_from: Model = model.value
        shard, grams, c = None, [], []

        def result() -> pa.RecordBatch:
            m = Model(start_from.bits, start_from.pairs, start_from.weights.copy(), start_from.refined)
            g, n = np.concatenate(grams).astype(np.uint64), np.concatenate(c).astype(float)
            squares, mass, outcomes = np.zeros_like(m.weights), np.zeros(GATES), np.zeros((GATES, BUCKETS, 2))
            for i in range(0, len(g), STEP):
                learn(m, g[i : i + STEP], n[i : i + STEP], squares, mass, outcomes)
            weights = m.weights * mass[:, None]
            what = np.repeat([0, 1, 2], [weights.size, GATES, outcomes.size])
            at = np.concatenate([np.arange(weights.size), np.arange(GATES), np.arange(outcomes.size)])
            value = np.concatenate([weights.ravel(), mass, outcomes.ravel()])
            return pa.RecordBatch.from_arrays([pa.array(what.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(value)], names=["what", "at", "value"])

        for b in batches:
            key = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1), len(key)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if shard is not None and key[i] != shard:
                    yield result()
                    grams, c = [], []
                shard = key[i]
                grams.append(b.column(1).to_numpy()[i:j])
                c.append(b.column(2).to_numpy()[i:j])
        if shard is not None:
            yield result()

    return run


def fit(counts: DataFrame) -> Model:
    """The model of a written table of ``training_counts``. Without windows every bit is even."""
    spark = counts.sparkSession
    grams = counts.where("gram IS NOT NULL").select("gram", "c")
    n = grams.count()
    bits = min(MOST_SLOTS, max(LEAST_SLOTS, ceil(log2(2 * n + 2))))
    levels = grams.mapInArrow(_levels(bits), "k int, region int, gram long, c long").groupBy("k", "region", "gram").agg(F.sum("c").alias("c"))
    blocks = levels.repartition("k", "region").sortWithinPartitions("k", "region").mapInArrow(_regions(bits), "k int, region int, block binary")
    size = (1 << bits) // REGIONS
    pairs = np.zeros((ORDERS, 1 << bits), "<u2")
    for r in blocks.toLocalIterator():  # REGIONS blocks an order, 50 MB in all at most
        pairs[r.k, r.region * size : (r.region + 1) * size] = np.frombuffer(r.block, "<u2")
    model = start(bits, pairs)
    mix = F.xxhash64("gram")
    dealt = grams.select(F.pmod(mix, F.lit(max(4, ceil(n / SHARD)))).cast("int").alias("shard"), "gram", "c", mix.alias("mix"))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "mix", "gram").select("shard", "gram", "c")
    for _ in range(2):
        shared = spark.sparkContext.broadcast(model)
        sums = dealt.mapInArrow(_learned(shared), "what int, at int, value double").groupBy("what", "at").agg(F.sum(F.col("value").cast("decimal(38,9)")).cast("double").alias("value")).collect()
        shared.destroy()
        found = [np.zeros(GATES * (ORDERS + 1)), np.zeros(GATES), np.zeros(GATES * BUCKETS * 2)]
        for r in sums:
            found[r.what][r.at] = r.value
        weights, mass, outcomes = found[0].reshape(GATES, -1), found[1], found[2].reshape(GATES, BUCKETS, 2)
        model.weights = np.where(mass[:, None] > 0, weights / np.maximum(mass, 1e-9)[:, None], model.weights)
    # buckets begin as what they stand for, worth four outcomes
    prior = 1 / (1 + np.exp(-np.linspace(-8, 8, BUCKETS)))
    share = (outcomes[:, :, 1] + 4 * prior) / (outcomes.sum(axis=2) + 4)
    model.refined = np.log(share / (1 - share))
    return model


def _scored(model, frequent, rows_of: int):
    """Scores of texts, their tokens' sums over frequent tokens and the counts of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, often = Mixer(model.value), frequent.value
        for whole in batches:
            for i in range(0, whole.num_rows, rows_of):
                b = whole.slice(i, rows_of)
                texts = [(t.as_py() or "").encode() for t in b.column(2)]
                score = np.zeros(len(texts))
                for grams, owner in pieces(iter(texts)):
                    code, kinds = pd.factorize(grams)
                    score += np.bincount(owner, weights=mixer.log10(kinds)[code], minlength=len(texts))
                n, known, sums, rare = [], [], [], []
                for t in texts:
                    words = tokens(t)
                    n.append(len(words) + 1)
                    said = Counter(words)
                    said[b""] = 1
                    k, s, rest = 0, 0.0, []
                    for w, m in said.items():
                        f = often.get(w)
                        if f is None:
                            rest.append({"token": w, "m": m})
                        else:
                            k += m
                            s += m * f
                    known.append(k)
                    sums.append(s)
                    rare.append(rest)
                kind = pa.list_(pa.struct([("token", pa.binary()), ("m", pa.int32())]))
                made = [pa.array(list(map(len, texts)), pa.int64()), pa.array(score), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(rare, kind)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["id", "held_out", "n_bytes", "score", "n_tokens", "known", "sums", "rare"])

    return run


def frequent_tokens(said: DataFrame) -> dict[bytes, float]:
    """log10(c + 0.5) of the most frequent tokens, FREQUENT at most, all above some power of two; and of the end."""
    level = F.floor(F.log2("c")).cast("int")
    fit_in = said.where(F.octet_length("token") <= 64)
    counted = {r.level: r["count"] for r in fit_in.groupBy(level.alias("level")).count().collect()}  # 63 rows at most
    least, room = 64, FREQUENT
    while least and counted.get(least - 1, 0) <= room:
        least -= 1
        room -= counted.get(least, 0)
    rows = fit_in.where((level >= least) | (F.octet_length("token") == 0)).select("token", F.log10(F.col("c") + 0.5).alias("f"))
    return {bytes(r.token): r.f for r in rows.collect()}


def scores(docs: DataFrame, remainder: int = 1, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every whole text.

    Texts whose crc32(id) mod ``folds`` is ``remainder`` are held out; the others train the model and the token
    counts. Null text is empty: one token, the end, and no bytes (bits_per_byte then null). A null id counts as the
    empty string. Repeated rows are repeated. An empty table has no rows; without training texts every count is
    zero and every bit even."""
    rows = docs.select(F.col(id_col).alias("id"), (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == remainder).alias("held_out"), F.col(text_col).alias("text"))
    sc = docs.sparkSession.sparkContext
    with scratch() as keep:
        counts = keep(written(training_counts(rows.where("NOT held_out")), "lm-counts"))
        said = counts.where("token IS NOT NULL").select("token", "c")
        total = said.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        model, often = sc.broadcast(fit(counts)), sc.broadcast(frequent_tokens(said))
        kind = docs.schema[id_col].dataType.simpleString()
        found = rows.mapInArrow(_scored(model, often, 2000), f"id {kind}, held_out boolean, n_bytes long, score double, n_tokens long, known long, sums double, rare array<struct<token:binary,m:int>>")
        found = keep(written(found.withColumn("row", F.monotonically_increasing_id()), "lm-scored"))
        model.destroy()
        often.destroy()
    rare = found.select("row", F.explode("rare").alias("t")).select("row", "t.token", "t.m").join(said, "token", "left")
    more = rare.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("m")).otherwise(0)).alias("more_known"), F.sum(F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"))
    base = F.col("sums") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(total.n + 0.5 * (total.v + 1)))
    out = found.drop("rare").join(more, "row", "left")
    return out.select("id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total.n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes",
        F.when(F.col("n_bytes") > 0, -F.col("score") * F.lit(log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
