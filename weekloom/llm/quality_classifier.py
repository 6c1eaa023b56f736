"""Quality classifier by positive-unlabelled learning.

Trusted positives are training rows labelled 1; everything else is unlabelled web text (labels of 0
are not used as negatives). A small network over text statistics minimises the non-negative
unbiased risk (Kiryo et al., "Positive-Unlabeled Learning with Non-Negative Risk Estimator", 2017)

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the logistic loss, so its sigmoid is a probability under the class prior. The prior is estimated
first, from how much of the unlabelled text scores as high as positives do (the smallest ratio of
upper tails, Garg et al., "Mixture Proportion Estimation and PU Learning", 2021): a first classifier,
fitted on one half of the ids, scores all training rows of the other.

Gradients use bounded samples, ``FIT_ROWS`` of each kind, drawn by a hash of the id and put in order.
Every document is scored, from its whole text and nothing else; its features are made once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import written
from weekloom.llm.quality_rules import base_statistics

#: Most rows of each kind that the fit begins with; a documented bound. From there all training rows refine it.
FIT_ROWS = 8_000
#: Passes over all training rows, and the fixed point of a row's part in their sums (so that their order is of no account).
PASSES, FIXED = 12, float(1 << 32)
#: Bins of scores for the prior.
BINS = 2_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 16, 40, 512, 5e-3, 1e-4, 42
THRESHOLD = 0.3
#: Rows with this remainder of crc32(id) modulo FOLDS are held out.
FOLDS, HELD = 5, 0
_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"


def features(text: bytes | None) -> list[float]:
    """Statistics of a whole UTF-8 text; an empty one has those of no evidence."""
    t = text or b""
    words = t.split()
    n, chars, symbols, same, repeat = base_statistics(t)
    size = len(t)
    lines = [x for x in t.split(b"\n") if x.strip()]

    def share(k: float, of: float, smooth: float) -> float:
        return math.log((k + smooth) / (of + 10 * smooth))

    twins = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lone = sum(not w.isalnum() and not any(48 <= c <= 57 or 65 <= c <= 90 or c >= 97 for c in w) for w in words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    kinds = len(set(words))
    stops = sum(map(t.count, (b".", b",", b";", b":", b"?")))
    return [
        math.log1p(n), math.log((chars + 10) / (n + 2)), share(symbols, chars, 1), share(t.count(b"!"), n, 0.5), share(t.count(b"!!"), n, 0.5),
        share(size - len(t.translate(None, _UPPER)), chars, 1), share(size - len(t.translate(None, _DIGIT)), chars, 1), share(stops, n, 0.5), share(twins, n, 0.5),
        share(lone, n, 0.5), share(repeat, n, 1), share(same, len(lines), 0.5), share(max(0, n - 1 - pairs), n, 1), math.log((kinds + 2) / (n + 2)) / math.log(n + 3),
        math.log((n + 5) / (len(lines) + 1)), share(t.count(b"|"), n, 0.5), share(sum(w[-1:] in b".!?" for w in words), n, 0.5),
    ]


class Model:
    """Standardised features, one hidden layer, a logit."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, rng: np.random.Generator):
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def copy(self, p: list[np.ndarray]) -> Model:
        other = object.__new__(Model)
        other.mean, other.scale, other.p = self.mean, self.scale, p
        return other

    def z(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logit(self, z: np.ndarray) -> np.ndarray:
        w, b, v, c = self.p
        return np.tanh(z @ w + b) @ v + c[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.z(x)), -30, 30)))

    def gradient(self, z: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        """Of the sum of g * logit."""
        w, b, v, _ = self.p
        h = np.tanh(z @ w + b)
        dh = g[:, None] * v * (1 - h * h)
        return [z.T @ dh, dh.sum(0), h.T @ g, np.array([g.sum()])]


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = SEED) -> Model:
    """Minimises the non-negative risk; with no prior, separates positives from unlabelled text (a
    plain logistic fit, for the prior's estimate)."""
    rng = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled])
    m = Model(both.mean(0), both.std(0) + 1e-3, rng)
    zp, zu = m.z(positive), m.z(unlabelled)
    first, second, step = [np.zeros_like(p) for p in m.p], [np.zeros_like(p) for p in m.p], 0
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(zu)), max(1, len(zu) // BATCH)):
            u, p = zu[rows], zp[rng.integers(0, len(zp), min(BATCH, len(zp)))]
            fu, fp = m.logit(u), m.logit(p)
            if prior is None:
                parts = [(p, (sig(fp) - 1) / len(p) / 2), (u, sig(fu) / len(u) / 2)]
            else:
                negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
                gp_plus, gp_minus, gu = prior * (sig(fp) - 1) / len(p), -prior * sig(fp) / len(p), sig(fu) / len(u)
                # below zero the negative part is overfitted: step back from it
                parts = [(p, gp_plus + gp_minus), (u, gu)] if negative >= 0 else [(p, -gp_minus), (u, -gu)]
            grads = [sum(x) for x in zip(*(m.gradient(z, g) for z, g in parts), strict=True)]
            step += 1
            for i, g in enumerate(grads):
                g = g + DECAY * m.p[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                m.p[i] = m.p[i] - RATE * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return m


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among unlabelled scores, both given as counts by bin of the score: the
    least upper-tail ratio, with the confidence margin deciding where the tail is cut."""
    n, m = positive.sum(), unlabelled.sum()
    qp, qu = (x[::-1].cumsum() / x.sum() for x in (positive, unlabelled))
    there = qp >= 0.02
    margin = math.sqrt(math.log(4 / delta) / 2 / n) + math.sqrt(math.log(4 / delta) / 2 / m)
    best = int(np.argmin(((qu + margin) / np.maximum(qp, 1e-9))[there]))
    return float(min(0.98, max(0.02, qu[there][best] / qp[there][best])))


def vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) of every row of ``docs``, written; null texts count as empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(1).cast(pa.binary())]
            xs = np.array([features(t) for t in texts], np.float32).reshape(len(texts), -1)
            ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * xs.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(xs.ravel()))], names=["id", "x"])

    return written(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<float>"), "features")


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def _drawn(rows: DataFrame) -> np.ndarray:
    """Features of a bounded table, in an order that doesn't depend on its partitions."""
    t = rows.select("id", "x").toArrow()
    if not t.num_rows:
        return np.zeros((0, 0))
    x = _matrix(t.column("x").combine_chunks(), t.num_rows)
    return x[np.lexsort((*x.T, np.array(t.column("id").to_pylist())))]


def _sampled(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """About ``n`` of the rows, by a hash of the id, and ``n`` at most."""
    total = rows.count()
    part = rows if total <= n else rows.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < math.ceil(1e6 * 1.1 * n / total))
    return part.orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id").limit(n)


def held_out(id_col: Column) -> Column:
    """Whether a row is in the held-out fold."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS)) == HELD


def _histogram(found: DataFrame, model: Model) -> np.ndarray:
    """Counts of the scores of rows (id, x) by bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(np.minimum((model.score(_matrix(b.column(0), b.num_rows)) * BINS).astype(int), BINS - 1), minlength=BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bin", "n"])

    out = np.zeros(BINS, np.int64)
    for r in found.select("x").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # BINS rows at most
        out[r["bin"]] = r["n"]
    return out


def fit(found: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model | None:
    """The model from rows of ``vectors`` and labels; None where there is no positive or no other
    row to learn from."""
    rows = found.where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    liked = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).where(F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
    chosen = F.broadcast(_sampled(liked, fit_rows, SEED))  # fit_rows at most
    unlabelled = F.broadcast(_sampled(rows.select("id"), fit_rows, SEED + 7))
    positive, other = (rows.join(ids, "id", "left_semi") for ids in (chosen, unlabelled))
    first = F.pmod(F.xxhash64(F.lit(SEED + 3), "id"), F.lit(2)) == 0
    p, u = _drawn(positive), _drawn(other)
    if not len(p) or not len(u):
        return None
    # the prior's classifier is fitted on one half and read on the other
    half = [_drawn(x.where(first)) for x in (positive, other)]
    prior = 0.5
    if all(map(len, half)):
        apart = train(*half, None)
        seen = [_histogram(x.where(~first), apart) for x in (positive, rows)]
        prior = class_prior(*seen) if all(x.any() for x in seen) else prior
    # all that is labelled good is trusted, and every training row is unlabelled
    named = liked.select(F.col("id").alias("__i"), F.lit(True).alias("__l"))
    marked = written(rows.join(named, F.col("id") == F.col("__i"), "left").select("x", F.coalesce("__l", F.lit(False)).alias("liked")), "marked")
    return refine(train(p, u, prior), marked, prior)


def _parts(model: Model, x: np.ndarray, liked: np.ndarray) -> np.ndarray:
    """Sums over rows in fixed point: rows, loss as negatives and gradient of that loss for all of them, then rows, both
    losses' difference and the gradients of the losses as positives and as negatives for trusted ones."""
    w, b, v, _ = model.p
    z = model.z(x)
    h = np.tanh(z @ w + b)
    f = np.clip(h @ v + model.p[3][0], -30, 30)
    sig = 1 / (1 + np.exp(-f))
    dh = v * (1 - h * h)
    each = np.concatenate([np.einsum("ni,nj->nij", z, dh).reshape(len(z), -1), dh, h, np.ones((len(z), 1))], axis=1)
    fixed = lambda a: np.rint(a * FIXED).astype(np.int64).sum(axis=0)
    loss, on = np.logaddexp(0, f), liked.astype(bool)
    parts = [fixed(np.ones(len(z))), fixed(loss), fixed(sig[:, None] * each), fixed(np.ones(on.sum())), fixed(loss[on]), fixed((sig[on] - 1)[:, None] * each[on]), fixed(sig[on][:, None] * each[on])]
    return np.concatenate([np.atleast_1d(a) for a in parts])


def refine(model: Model, rows: DataFrame, prior: float, passes: int = PASSES) -> Model:
    """The model after full passes of the non-negative risk over all ``rows`` (x, liked): every row counts as unlabelled, and
    those that are liked as trusted positives too. A pass is one aggregation of some thousand numbers."""
    shapes = [a.shape for a in model.p]
    size = sum(int(np.prod(a)) for a in shapes)
    first, second = np.zeros(size), np.zeros(size)
    flat = np.concatenate([a.ravel() for a in model.p])
    for step in range(1, passes + 1):

        def run(batches: Iterator[pa.RecordBatch], m: Model = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(4 + 3 * size, np.int64)
            for b in batches:
                for i in range(0, b.num_rows, 2048):
                    part = b.slice(i, 2048)
                    total += _parts(m, _matrix(part.column(0), part.num_rows), part.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "v"])

        sums = np.zeros(4 + 3 * size)
        for r in rows.select("x", "liked").mapInArrow(run, "at int, v long").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
            sums[r["at"]] = float(r["v"]) / FIXED
        n, loss, gu = sums[0], sums[1], sums[2 : 2 + size]
        k, liked_loss = sums[2 + size], sums[3 + size]
        plus, minus = sums[4 + size : 4 + 2 * size], sums[4 + 2 * size :]
        negative = loss / n - prior * liked_loss / k
        g = prior * plus / k + gu / n - prior * minus / k if negative >= 0 else prior * minus / k - gu / n
        g = g + DECAY * flat
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        flat = np.round(flat - RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8), 6)
        ends = np.cumsum([int(np.prod(a)) for a in shapes])[:-1]
        model = model.copy([a.reshape(shape) for a, shape in zip(np.split(flat, ends), shapes)])
    return model


def scores(found: DataFrame, model: Model | None) -> DataFrame:
    """(id, held_out, score) for every row of ``vectors``. Null and empty texts are scored as texts
    without evidence; with no model every score is 0.5; repeated rows each get a row; a null id is
    not held out; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.full(b.num_rows, 0.5) if model is None or not b.num_rows else model.score(_matrix(b.column(1), b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["id", "score"])

    rows = found.mapInArrow(run, f"id {found.schema['id'].dataType.simpleString()}, score double")
    return rows.select("id", F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score")
