"""Inference with one model a group, networks as array expressions, and batches of token ids."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.functions.text import safe_name

#: Rows that a group's model sees in one task.
BLOCK_ROWS = 100_000


# ---------------------------------------------------------------- linear models
def dot(a: Column, b: Column) -> Column:
    """Sum of products in order; null if a value is."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def linear(weights: Column, bias: Column, x: Column) -> Column:
    """Values of linear functions: ``weights`` is an array of arrays, ``bias`` an array."""
    return F.zip_with(F.transform(weights, lambda w: dot(w, x)), bias, lambda v, b: v + b)


def linear_rows(weights: Sequence[Sequence[float]], bias: Sequence[float], x: np.ndarray) -> np.ndarray:
    """``linear`` of the rows of ``x``, bit for bit: products are added one by one. A matrix product adds them in an order
    that depends on the machine and the number of rows, and so decides ties of two values otherwise."""
    w, out = np.array(weights, float), np.zeros((len(x), len(weights)))
    for i in range(w.shape[1]):
        out = out + x[:, i : i + 1] * w[:, i]
    return out + np.array(bias, float)


# ---------------------------------------------------------------- routing
def routed(rows: DataFrame, load: Callable[[str], Callable[[pd.DataFrame], Sequence[Sequence[float]]] | None], key: str, major: str = "major", logits: str = "sub_logits", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with the logits of each row's own model; null where its group has none.

    ``load(name)`` makes a group's model, once in every worker that meets the group, from its file-safe name; the model takes
    a batch of rows. Rows are dealt by (model, block of the key), so a group of any size is split into blocks of
    about ``block_rows`` and a task meets few models; they pass through as a stream, with all their columns. A
    null group has no model."""
    counts = rows.groupBy(F.coalesce(safe_name(F.col(major)), F.lit("")).alias("__model")).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("__blocks"))
    held = rows.drop(logits).withColumn("__model", F.coalesce(safe_name(F.col(major)), F.lit(""))).join(counts, "__model")  # a row a group, by its size broadcast or not
    dealt = held.withColumn("__block", F.pmod(F.xxhash64(key), F.col("__blocks"))).repartition("__model", "__block").sortWithinPartitions("__model")
    kept = [c for c in rows.columns if c != logits]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, model = None, None
        for b in batches:
            for found, part in b.groupby("__model", sort=False):
                if found != name:
                    name, model = found, load(found) if found else None
                values = [None] * len(part) if model is None else [list(map(float, v)) for v in model(part)]
                yield part[kept].assign(**{logits: values})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != logits)
    return dealt.select(*kept, "__model").mapInPandas(run, f"{fields}, `{logits}` array<double>")


# ---------------------------------------------------------------- networks
def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is computed once, wherever and however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def masked_mean(h: Column, mask: Column) -> Column:
    """Mean of token vectors that the mask keeps; zeros where it keeps none."""
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1e-9))
    zero = F.transform(F.get(h, F.lit(0)), lambda _: F.lit(0.0))
    total = F.aggregate(F.zip_with(h, mask, lambda v, m: F.transform(v, lambda x: x * m)), zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / n)


def causal_conv(x: Column, weights: Column, bias: Column, dilation: Column) -> Column:
    """Dilated causal convolution over time: ``x`` is (time, channel), ``weights`` (out, kernel, in); what lies before the
    first row is zero."""
    size = F.size(F.get(weights, F.lit(0)))

    def out(t: Column, w: Column) -> Column:
        def term(k: Column) -> Column:
            at = t - (size - 1 - k) * dilation
            return F.when(at >= 0, dot(F.get(w, k), F.get(x, at))).otherwise(0.0)

        return F.aggregate(F.transform(F.sequence(F.lit(0), size - 1), term), F.lit(0.0), lambda a, v: a + v)

    one = lambda t: F.zip_with(F.transform(weights, lambda w: out(t, w)), bias, lambda v, b: v + b)
    return F.transform(F.sequence(F.lit(0), F.size(x) - 1), one)


def _relu(x: Column) -> Column:
    return F.transform(x, lambda row: F.transform(row, lambda v: F.greatest(v, F.lit(0.0))))


#: A temporal network as a column: blocks in order (dilation doubling from 1), and the heads' layers.
TCN = """struct<blocks:array<struct<w1:array<array<array<double>>>,b1:array<double>,w2:array<array<array<double>>>,b2:array<double>,down:array<array<double>>,down_b:array<double>>>,
reg:array<struct<w:array<array<double>>,b:array<double>>>,cls:array<struct<w:array<array<double>>,b:array<double>>>>"""


def tcn(model: Column, x: Column) -> Column:
    """Struct (momentum, anomaly) of a sequence ``x`` (time, channel) by a temporal network ``model`` of type ``TCN``.

    A block is two dilated causal convolutions with rectifiers and a residual, through ``down`` where that is not null.
    The last block's rows are averaged over time; each head is a linear layer, a rectifier and a linear layer; then tanh
    for the momentum and the logistic function for the anomaly. Weights are those in use (norms folded in)."""

    def block(state: Column, w: Column) -> Column:
        h, d = state["h"], state["d"]
        out = _let(_relu(causal_conv(h, w["w1"], w["b1"], d)), lambda first: _relu(causal_conv(first, w["w2"], w["b2"], d)))
        res = F.when(w["down"].isNull(), h).otherwise(F.transform(h, lambda row: linear(w["down"], w["down_b"], row)))
        both = _relu(F.zip_with(out, res, lambda a, b: F.zip_with(a, b, lambda p, q: p + q)))
        return F.struct(both.alias("h"), (d * 2).alias("d"))

    def head(layers: Column, pooled: Column) -> Column:
        first = F.transform(linear(layers[0]["w"], layers[0]["b"], pooled), lambda v: F.greatest(v, F.lit(0.0)))
        return F.get(linear(layers[1]["w"], layers[1]["b"], first), F.lit(0))

    def heads(pooled: Column) -> Column:
        return F.struct(F.tanh(head(model["reg"], pooled)).alias("momentum"), (1 / (1 + F.exp(-head(model["cls"], pooled)))).alias("anomaly"))

    last = F.aggregate(model["blocks"], F.struct(x.alias("h"), F.lit(1).alias("d")), block)["h"]
    return _let(_let(last, lambda h: masked_mean(h, F.transform(h, lambda _: F.lit(1.0)))), heads)


# ---------------------------------------------------------------- token batches
class WordPieces:
    """Greedy longest-match pieces of words over a trie. ``vocabulary``: pieces by id, continuations with ``##``."""

    def __init__(self, vocabulary: Sequence[str], lower: bool = True):
        self.ids = {p: i for i, p in enumerate(vocabulary)}
        self.pad, self.unknown, self.start, self.end = (self.ids[p] for p in ("[PAD]", "[UNK]", "[CLS]", "[SEP]"))
        self.lower = lower
        self.begin: dict = {}
        self.inside: dict = {}
        for piece, i in self.ids.items():
            at = self.inside if piece.startswith("##") else self.begin
            for ch in piece.removeprefix("##"):
                at = at.setdefault(ch, {})
            at[""] = i

    def words(self, text: str) -> Iterator[str]:
        """Runs of letters and digits; punctuation, symbols and ideographs are words by themselves; controls vanish. In
        lower case accents go too."""
        if self.lower:
            text = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
        word: list[str] = []
        for c in text:
            kind = unicodedata.category(c)
            alone = kind[0] in "PS" or 0x3400 <= ord(c) <= 0x9FFF or 0xF900 <= ord(c) <= 0xFAFF or 0x20000 <= ord(c) <= 0x2FA1F
            space = c.isspace() or kind == "Zs"
            if (alone or space) and word:
                yield "".join(word)
                word = []
            if alone:
                yield c
            elif not space and kind[0] != "C":
                word.append(c)
        if word:
            yield "".join(word)

    def pieces(self, word: str) -> list[int]:
        """Ids of a word's pieces, or the unknown one if some part has none or it is over 100 characters long."""
        if len(word) > 100:
            return [self.unknown]
        out: list[int] = []
        i, trie = 0, self.begin
        while i < len(word):
            at, best, n = trie, None, 0
            for j in range(i, len(word)):
                at = at.get(word[j])
                if at is None:
                    break
                if "" in at:
                    best, n = at[""], j + 1
            if best is None:
                return [self.unknown]
            out.append(best)
            i, trie = n, self.inside
        return out

    def encode(self, text: str, max_length: int) -> list[int]:
        """Start, pieces and end, cut to ``max_length`` in all."""
        out = [self.start]
        for w in self.words(text):
            out += self.pieces(w)
            if len(out) >= max_length - 1:
                break
        return [*out[: max_length - 1], self.end]


def token_batches(rows: DataFrame, vocabulary: Sequence[str], text_col: str, max_length: int = 256, lower: bool = True) -> DataFrame:
    """``rows`` with input_ids, attention_mask and token_type_ids (arrays of ``max_length`` ints): pieces with a start and
    an end, cut and padded, with masks of what is no padding and zero types. Null text is empty. Columns of these names are
    replaced. Cutting is what the model asks for: nothing beyond ``max_length`` pieces is looked at."""
    made = ("input_ids", "attention_mask", "token_type_ids")
    kept = rows.drop(*made)
    at = kept.columns.index(text_col)
    given = list(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = WordPieces(given, lower)
        kind = pa.list_(pa.int32())
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                ids = [model.encode(t.as_py() or "", max_length) for t in b.column(at)]
                spare = [max_length - len(x) for x in ids]
                columns = [[x + [model.pad] * s for x, s in zip(ids, spare)], [[1] * len(x) + [0] * s for x, s in zip(ids, spare)], [[0] * max_length] * len(ids)]
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, kind) for c in columns)], names=[*b.schema.names, *made])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, " + ", ".join(f"{c} array<int>" for c in made))
