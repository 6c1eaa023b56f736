"""Quality rules: robust multivariate outliers among documents of a language and source.

Two plain rules decide first (too few words; too much text in repeated five-word windows). Of the
rest, a document goes if its vector of transformed statistics lies far from its group's centre in
the Mahalanobis distance of a minimum-covariance-determinant estimate.

The estimates are made over all documents, for each language and source, each language and all
together in one go. They start from three robust estimates (Hubert et al., "A Deterministic Algorithm
for Robust Location and Scatter", 2012): medians with quartile ranges, with the correlations of
hyperbolic tangents, and with those of spatial signs. Concentration steps go on until no determinant
falls any more; of the three the least determinant counts. A step is one aggregation with map-side
combining: moments by logarithmic bins of the distance, of which those that hold ``SUPPORT`` of a
group are added up. A group's moments are joined by those of ``PRIOR_ROWS`` imagined documents of
its parent (its language, then all), so small groups lean on larger ones and no group goes unjudged.
Covariances are regularised by a diagonal of least scales (the exact-fit case: most groups repeat no
lines at all).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekloom.llm.common import counted, forget, scratch, small, written

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
STATS = ("word_length", "symbols", "marks", "capitals", "repeats", "same_lines")
#: Least scale of each statistic, in its transformed unit.
FLOORS = (0.06, 0.35, 0.25, 0.35, 0.5, 0.5)
SUPPORT = 0.75
#: Fall of a logarithm of the determinant for which a step is taken; and a guard against a defect.
LEAST_FALL, MAX_STEPS = 0.05, 100
#: Documents that a group's parent counts for in its estimate.
PRIOR_ROWS = 50
#: Words at which a document's distance counts half: short texts have noisy statistics.
HALF_WORDS = 50
#: Groups up to which their estimates are broadcast (about 2 kB each).
BROADCAST_GROUPS = 20_000
#: Kept documents up to which their keys are broadcast (about 60 bytes each).
BROADCAST_ROWS = 500_000
_BINS = 16  # a power of two


def base_statistics(text: bytes | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a UTF-8 text."""
    t = text or b""
    words = t.split()
    chars = sum(map(len, words)) if t.isascii() else sum(len(w.decode()) for w in words)
    symbols = sum(map(t.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))))
    seen: set[bytes] = set()
    same = 0
    for line in t.split(b"\n"):
        if line in seen:
            same += 1
        elif line and not line.isspace():
            seen.add(line)
    repeat = 0
    if len(words) > 5:
        windows = list(zip(*(words[i:] for i in range(5)), strict=False))
        if len(set(windows)) < len(windows):
            often, reach = Counter(windows), 0
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeat += i + 5 - max(i, reach)
                    reach = i + 5
    return len(words), chars, symbols, same, repeat


def _vector(t: bytes, n: int, chars: int, symbols: int, same: int, repeat: int) -> tuple[float, ...]:
    """The statistics, each on a scale where clean texts are about normal."""
    text = t.decode()
    marks = sum(map(text.count, ".,;:!?"))
    capitals = len(t) - len(t.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lines = 1 + t.count(b"\n")

    def level(k: float, of: float, usual: float, weight: float) -> float:
        # bounded below, however long a text without any: to have less than usual is no fault
        return math.log((k + usual * weight) / (of + weight) + usual)

    return (math.log((chars + 100.0) / (n + 20.0)), level(symbols, chars, 0.002, 500), level(marks, chars, 0.02, 200), level(capitals, chars, 0.02, 200), level(repeat, n, 0.02, 200), level(same, lines, 0.02, 50))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    x: array of the transformed statistics) of every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, xs = [], []
            for t in b.column(3).cast(pa.binary()):
                t = t.as_py() or b""
                base = base_statistics(t)
                got.append(base)
                xs.append(_vector(t, *base))
            cols = [pa.array(c, pa.int64()) for c in zip(*got, strict=True)] if got else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols, pa.array(xs, pa.list_(pa.float64()))], names=["id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("t"))
    rows = plain.mapInArrow(run, f"id {kind}, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, x array<double>")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def chi_square_cdf(x: float, p: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi_square_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, p) < q else (lo, mid)
    return lo


#: Squared distance beyond which a document goes: one in ten thousand of a normal group.
CUTOFF = chi_square_quantile(0.9999, len(STATS))


def _name(*cols: str) -> Column:
    """Name of a group, which tells null from any value."""
    return F.concat_ws("\x01", F.lit(str(len(cols))), *[F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in cols])


def _distance() -> Column:
    """Squared length of root * (x - centre); ``root`` is lower triangular, by rows."""
    p, total, k = len(STATS), F.lit(0.0), 0
    for i in range(p):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col("root")[k] * (F.col("x")[j] - F.col("centre")[j])
            k += 1
        total = total + z * z
    return total


def _square(lower) -> np.ndarray:
    """The symmetric matrix of a lower triangle by rows."""
    out = np.zeros((len(STATS), len(STATS)))
    out[np.tril_indices(len(STATS))] = lower
    return out + np.tril(out, -1).T


def _rooted(centre: np.ndarray, cov: np.ndarray) -> tuple:
    """(centre, cov, root, logdet) with ``cov`` regularised for the last two."""
    root = np.linalg.inv(np.linalg.cholesky(cov + np.diag(np.square(FLOORS))))
    low = np.tril_indices(len(STATS))
    return centre, cov[low], root[low], -2 * np.log(np.diag(root)).sum()


_ESTIMATE = "grp string, parent string, start int, centre array<double>, cov array<double>, root array<double>, logdet double"


def _products(v: list[Column]) -> list[Column]:
    return [F.sum(v[i] * v[j]) for i in range(len(v)) for j in range(i + 1)]


def _starts(rows: DataFrame) -> DataFrame:
    """Three estimates of every group of rows (grp, parent, x)."""
    p = len(STATS)
    # medians and quartile ranges from bins of a fixed width
    long = rows.select("grp", "parent", F.posexplode("x").alias("i", "v")).groupBy("grp", "parent", "i", F.floor(F.col("v") * 50).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("grp", "i")
    ran = long.withColumn("run", F.sum("n").over(by.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(by))
    at = lambda q: F.min(F.when(F.col("run") >= q * F.col("all"), F.col("bin"))) / 50 + 0.01
    scales = ran.groupBy("grp", "parent", "i").agg(at(0.5).alias("mid"), (at(0.75) - at(0.25)).alias("iqr"))
    floor = F.element_at(F.array(*map(F.lit, FLOORS)), F.col("i") + 1)
    scales = scales.groupBy("grp", "parent").agg(F.sort_array(F.collect_list(F.struct("i", "mid", F.greatest(F.col("iqr") / 1.349, floor).alias("scale")))).alias("a"))
    scales = written(counted(scales.select("grp", F.col("a.mid").alias("mid"), F.col("a.scale").alias("scale"))), "scales")
    z = [((F.col("x")[i] - F.col("mid")[i]) / F.col("scale")[i]) for i in range(p)]
    rows = rows.join(small(scales, BROADCAST_GROUPS), "grp").select("grp", "parent", "mid", "scale", *[c.alias(f"z{i}") for i, c in enumerate(z)])
    z = [F.col(f"z{i}") for i in range(p)]
    length = F.sqrt(sum((c * c for c in z), F.lit(1e-12)))
    soft, signs = [F.array(*_products(v)) for v in ([F.tanh(c) for c in z], [c / length for c in z])]
    sums = rows.groupBy("grp", "parent").agg(F.count(F.lit(1)).alias("n"), F.first("mid").alias("mid"), F.first("scale").alias("scale"), soft.alias("soft"), signs.alias("signs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for grp, parent, n, mid, scale, soft, signs in zip(*(b[c] for c in ("grp", "parent", "n", "mid", "scale", "soft", "signs")), strict=True):
                for start, lower in enumerate((None, soft, signs)):
                    r = np.eye(p) if lower is None else _square(lower) / n + 0.01 * np.eye(p)
                    d = np.asarray(scale) / np.sqrt(np.diag(r))
                    out.append((grp, parent, start, *_rooted(np.asarray(mid), r * np.outer(d, d))))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _ESTIMATE.split(", ")])

    return sums.mapInPandas(run, _ESTIMATE)


def _solved(moments: DataFrame, factor: float) -> DataFrame:
    """Estimates with ``fell`` from sums of each group, its parent's estimate and its own so far,
    which stays where its determinant doesn't fall (the first, of no scale yet, has no ``was``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for grp, parent, start, was, n, s, q, above, spread, *before in zip(*(b[c] for c in ("grp", "parent", "start", "was", "n", "s", "q", "above", "spread", "centre", "cov", "root")), strict=True):
                centre = np.asarray(s) / n
                cov = factor * (_square(q) / n - np.outer(centre, centre))
                if parent is not None:
                    m, gap = PRIOR_ROWS, centre - np.asarray(above)
                    cov = (n * cov + m * _square(spread) + n * m / (n + m) * np.outer(gap, gap)) / (n + m)
                    centre = centre - gap * m / (n + m)
                got = _rooted(centre, cov)
                fell = np.inf if np.isnan(was) else was - got[-1]
                out.append((grp, parent, start, *got, fell) if fell >= LEAST_FALL else (grp, parent, start, *before, was, 0.0))
            yield pd.DataFrame(out, columns=[*(x.split()[0] for x in _ESTIMATE.split(", ")), "fell"])

    return moments.mapInPandas(run, f"{_ESTIMATE}, fell double")


def estimates(rows: DataFrame) -> DataFrame:
    """(grp, centre, root) of every group of rows (grp, parent, x); the parent of a group is a group,
    or null: the regularised minimum-covariance-determinant estimate."""
    p = len(STATS)
    now = written(counted(_starts(rows)), "estimate")
    inside = chi_square_quantile(SUPPORT, p)
    factor = SUPPORT / chi_square_cdf(inside, p + 2)
    x = [F.col(f"x{i}") for i in range(p)]
    for step in range(MAX_STEPS):
        own = small(now.select("grp", "start", "centre", "cov", "root", (F.col("logdet") if step else F.lit(None).cast("double")).alias("was")), BROADCAST_GROUPS, now.measured["rows"])
        far = rows.join(own, "grp").select("grp", "parent", "start", F.floor(_BINS * F.log2(_distance() + F.lit(1e-6))).cast("int").alias("bin"), *[F.col("x")[i].alias(f"x{i}") for i in range(p)])
        sums = [c.alias(f"s{i}") for i, c in enumerate([*map(F.sum, x), *_products(x)])]
        cells = written(far.groupBy("grp", "parent", "start", "bin").agg(F.count(F.lit(1)).alias("n"), *sums), "cells")
        by = W.partitionBy("grp", "start")
        run = F.sum("n").over(by.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
        near = cells.withColumn("run", run).withColumn("all", F.sum("n").over(by)).where(F.col("run") < SUPPORT * F.col("all"))
        total = [F.sum(f"s{i}") for i in range(len(sums))]
        moments = near.groupBy("grp", "parent", "start").agg(F.sum("n").alias("n"), F.array(*total[:p]).alias("s"), F.array(*total[p:]).alias("q"))
        above = small(now.select(F.col("grp").alias("__p"), F.col("start").alias("__s"), F.col("centre").alias("above"), F.col("cov").alias("spread")), BROADCAST_GROUPS, now.measured["rows"])
        joined = moments.join(own, ["grp", "start"]).join(above, (F.col("parent") == F.col("__p")) & (F.col("start") == F.col("__s")), "left")
        last, now = now, written(counted(_solved(joined, factor), fell=F.max("fell")), "estimate")
        forget(last, cells)
        if not now.measured["fell"]:
            break
    else:
        raise RuntimeError("concentration steps did not settle")
    return now.groupBy("grp").agg(F.min_by(F.struct("centre", "root"), F.struct("logdet", "start")).alias("e")).select("grp", "e.centre", "e.root")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """One row for each row of ``docs``: id, the counts, base_failed, ``distance`` (squared, weighted
    by n_words / (n_words + HALF_WORDS); null in groups where all fail the base rule) and ``kept``.

    Null and empty texts have no words and fail the base rule; null languages and sources are
    groups of their own; repeated rows each get a row; an empty table gives an empty result."""
    stats = written(statistics(docs, id_col, text_col, lang_col, source_col), "stats")
    levels = [_name("lang", "source"), _name("lang"), _name()]
    groups = F.array(*[F.struct(g.alias("grp"), (up if up is not None else F.lit(None).cast("string")).alias("parent")) for g, up in zip(levels, [*levels[1:], None], strict=True)])
    rows = stats.where("NOT base_failed").select("x", F.explode(groups).alias("g")).select("g.grp", "g.parent", "x")
    with scratch() as keep:
        estimate = keep(written(counted(estimates(rows)), "estimates"))
    estimate = small(estimate, BROADCAST_GROUPS)
    found = stats.withColumn("grp", levels[0]).join(estimate, "grp", "left")
    distance = _distance() * F.col("n_words") / (F.col("n_words") + HALF_WORDS)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return found.withColumn("distance", distance).withColumn("kept", kept).drop("centre", "root")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` without the rejected rows; same columns. Rows of one id and text share a verdict."""
    with scratch() as keep:
        verdicts = judge(docs.withColumn("__k", F.xxhash64(text_col)).withColumn("__id", F.struct(F.col(id_col).alias("i"), F.col("__k").alias("k"))), "__id", text_col, lang_col, source_col)
        kept = keep(written(counted(verdicts.where("kept").select(F.col("id.i").alias("__i"), F.col("id.k").alias("__k"), F.col("lang").alias("__l"), F.col("source").alias("__s")).distinct()), "kept"))
    same = docs[id_col].eqNullSafe(kept["__i"]) & (F.xxhash64(text_col) == kept["__k"]) & docs[lang_col].eqNullSafe(kept["__l"]) & docs[source_col].eqNullSafe(kept["__s"])
    return docs.join(small(kept, BROADCAST_ROWS), same, "left_semi")
