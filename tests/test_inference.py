"""Routing, networks and token batches against plain loops."""

import math
import random
import unicodedata

from pyspark.sql import functions as F

from weekloom import model_queries as M
from weekloom.operators import inference


def test_routed_blocks(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else rng.choice(["a/b", "c d", None, "none"]), [rng.random(), rng.random()], "kept") for i in range(3000)]
    table = spark.createDataFrame(rows, "id long, major string, x array<double>, sub_logits string").repartition(7)

    def load(name):
        if name == "none":
            return None
        k = {"hot": 1.0, "a_b": 2.0, "c_d": 3.0}[name]
        return lambda part: [[k * v[0], v[1] - k] for v in part["x"]]

    out = inference.routed(table, load, "id", block_rows=200).collect()
    assert len(out) == len(rows)
    want = {i: None if m in (None, "none") else [k * x[0], x[1] - k] for i, m, x, _ in rows for k in [{"hot": 1.0, "a/b": 2.0, "c d": 3.0}.get(m, 0)]}
    assert all(r.sub_logits == want[r.id] for r in out)
    assert inference.routed(table.where("false"), load, "id").count() == 0


def slow_tcn(w, x):
    relu = lambda v: max(v, 0.0)
    h = [[v] for v in x]
    for layer, b in enumerate(w["blocks"]):
        d = 2**layer

        def conv(h, ws, bs):
            k = len(ws[0])
            return [[relu(bs[o] + sum(ws[o][j][i] * h[t - (k - 1 - j) * d][i] for j in range(k) if t - (k - 1 - j) * d >= 0 for i in range(len(h[0])))) for o in range(len(ws))] for t in range(len(h))]

        out = conv(conv(h, b["w1"], b["b1"]), b["w2"], b["b2"])
        res = h if b["down"] is None else [[sum(p * q for p, q in zip(row, v)) + c for row, c in zip(b["down"], b["down_b"])] for v in h]
        h = [[relu(p + q) for p, q in zip(a, c)] for a, c in zip(out, res)]
    pooled = [sum(col) / len(h) for col in zip(*h)]

    def head(layers):
        first = [relu(sum(p * q for p, q in zip(row, pooled)) + b) for row, b in zip(layers[0]["w"], layers[0]["b"])]
        return sum(p * q for p, q in zip(layers[1]["w"][0], first)) + layers[1]["b"][0]

    return math.tanh(head(w["reg"])), 1 / (1 + math.exp(-head(w["cls"])))


def test_tcn(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(rng.choice([1, 2, 5, 9]))]) for i in range(60)]
    w = M._tcn_weights()
    weights = spark.createDataFrame([(w,)], f"model {inference.TCN}".replace("\n", ""))
    table = spark.createDataFrame(rows, "id int, x array<double>").join(weights)
    got = {r.id: r.y for r in table.select("id", inference.tcn(F.col("model"), F.transform("x", lambda v: F.array(v))).alias("y")).collect()}
    for i, x in rows:
        m, a = slow_tcn(w, x)
        assert abs(got[i].momentum - m) < 1e-12 and abs(got[i].anomaly - a) < 1e-12


def test_masked_mean(spark):
    rows = [([[1.0, 2.0], [3.0, 5.0]], [1.0, 1.0], [2.0, 3.5]), ([[1.0, 2.0], [3.0, 5.0]], [0.0, 1.0], [3.0, 5.0]), ([[1.0, 2.0]], [0.0], [0.0, 0.0])]
    got = spark.createDataFrame(rows, "h array<array<double>>, m array<double>, want array<double>").select(inference.masked_mean(F.col("h"), F.col("m")).alias("p"), "want").collect()
    assert all(r.p == r.want for r in got)


def slow_pieces(text, vocabulary, n):
    """Ids by slicing words and looking the slices up."""
    ids = {p: i for i, p in enumerate(vocabulary)}
    text = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    spaced = ""
    for c in text:
        kind = unicodedata.category(c)
        if kind[0] in "PS" or 0x3400 <= ord(c) <= 0x9FFF:
            spaced += f" {c} "
        elif c.isspace() or kind[0] != "C":
            spaced += c
    out = []
    for word in spaced.split():
        found, i = [], 0
        while i < len(word) and len(word) <= 100:
            for j in range(len(word), i, -1):
                piece = word[i:j] if i == 0 else "##" + word[i:j]
                if piece in ids:
                    found.append(ids[piece])
                    break
            else:
                found = []
                break
            i = j
        out += found or [ids["[UNK]"]]
    out = [ids["[CLS]"], *out[: n - 2], ids["[SEP]"]]
    return out + [0] * (n - len(out)), [1] * len(out) + [0] * (n - len(out))


def test_token_batches(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = [*docs, None, "", "\x00​", "The THE thé 日日 a.b", "x" * 101, "theand thing", "unß", "(((", "a b"]
    table = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("input_ids", F.lit("clash")).repartition(3)
    for n in (2, 16, 300):
        got = inference.token_batches(table, M.VOCABULARY, "t", n).collect()
        assert len(got) == len(texts)
        for r in got:
            ids, mask = slow_pieces(texts[r.id] or "", M.VOCABULARY, n)
            assert (r.input_ids, r.attention_mask, r.token_type_ids) == (ids, mask, [0] * n), (r.id, n)
