"""The language model: counts and base scores against plain loops, a proper distribution, and gain on held-out text."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from weekloom.llm import lm

WORDS = "river stone paper cloud green table seven under music light house water after again small story".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def fixture(n=150):
    rng = random.Random(8)
    texts = [None, "", " \n\x0b", "É日 😀 Ab\x1cB", "x" * 50_000, *(prose(rng, rng.randint(1, 300)) for _ in range(n))]
    return [*enumerate(texts), (7, texts[7]), (7, texts[7]), (None, "The river"), (-3, "RIVER river")]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")) + [""]


def test_base_and_distribution(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("token", F.lit(1))
    seen = Counter(w for i, t in rows if not held(i) for w in words(t))
    total, v = sum(seen.values()), len(seen)
    was = lm.FREQUENT
    for lm.FREQUENT in (was, 4):  # with few frequent tokens the rest is joined
        got = lm.scores(docs.repartition(5)).collect()
        assert len(got) == len(rows)
        want = {i: (len(words(t)), sum(seen[w] > 0 for w in words(t)), sum(math.log10((seen[w] + 0.5) / (total + 0.5 * (v + 1))) for w in words(t)), len((t or "").encode())) for i, t in rows}
        for r in got:
            n, known, base, size = want[r.id]
            assert (r.n_tokens, r.n_known, r.train_tokens, r.n_bytes, r.held_out) == (n, known, total, size, held(r.id))
            assert abs(r.base_score - base) < 1e-6 and r.score < 0 and math.isfinite(r.score)
    lm.FREQUENT = was
    out = [r for r in got if r.held_out and r.n_bytes > 200]
    assert out and sum(r.bits_per_byte for r in out) / len(out) < 1.6  # letters in words of a small list; 8 untrained
    again = {(r.id, r.score) for r in lm.scores(docs.repartition(2)).collect()}
    assert all(min(abs(s - r.score) for i, s in again if i == r.id) < 1e-6 for r in got)  # however rows lie


def test_windows_and_counts(spark):
    rows = [(i, t) for i, t in fixture(20)]
    want = Counter()
    for _, t in rows:
        b = b"\xff" * 5 + (t or "").encode() + b"\xff"
        want.update(int.from_bytes(b[i : i + 6], "big") for i in range(len(b) - 5))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    was, lm.CHUNK = lm.CHUNK, 1000
    texts = [(t or "").encode() for _, t in rows]
    found, owners = Counter(), Counter()
    for grams, owner in lm.pieces(iter(texts)):
        found.update(grams.tolist())
        owners.update(owner.tolist())
    lm.CHUNK = was
    assert found == want and owners == Counter({k: len(t) + 1 for k, t in enumerate(texts)})
    assert {r.gram: r.c for r in lm.training_counts(docs).where("gram IS NOT NULL").collect()} == dict(want)


def slow_pairs(want, bits):
    n = np.zeros((lm.ORDERS, 1 << bits, 2))
    for gram, c in want.items():
        for k in range(lm.ORDERS):
            region, local = lm.slots_of(np.array([gram >> 8 & (1 << 8 * k) - 1], np.uint64), k, bits)
            base = int(region[0]) * ((1 << bits) // lm.REGIONS) + int(local[0])
            for i in range(8):
                node = 1 << i | (gram & 255) >> (8 - i)
                n[k, base ^ node, (gram & 255) >> (7 - i) & 1] += c
    return n


def test_predictors_against_plain_counts(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 40)) for i in range(30)]
    counts = lm.written(lm.training_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "counts")
    model = lm.fit(counts)
    want = {r.gram: r.c for r in counts.where("gram IS NOT NULL").collect()}
    n = slow_pairs(want, model.bits)
    assert all((model.pairs[k].view("u1").reshape(-1, 2) == lm.packed(n[k])).all() for k in range(lm.ORDERS))
    # for any context the 256 next bytes have probabilities that sum to one
    for context in (0, 0xFFFFFFFFFF, int.from_bytes(b"river", "big"), int.from_bytes(b"qqqqq", "big")):
        p = 10 ** lm.Mixer(model).log10(np.array([context << 8 | b for b in range(256)], np.uint64))
        assert abs(p.sum() - 1) < 1e-6
    # the mixture beats each single order on text it has not seen
    mixer = lm.Mixer(model)
    grams = np.concatenate([g for g, _ in lm.pieces(iter([prose(rng, 300).encode()]))])
    whole = -mixer.log10(grams).mean()
    for k in range(lm.ORDERS):
        alone = 0.0
        for bit, _, x in mixer.decisions(grams):
            alone += np.logaddexp(0, np.where(bit == 1, -x[:, k], x[:, k])).mean() / math.log(10)
        assert whole < alone, k


def test_no_training_and_no_rows(spark):
    one = spark.createDataFrame([(next(i for i in range(100) if held(i)), "abc")], "doc_id long, text string")
    r = lm.scores(one).first()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.n_tokens == 2 and abs(r.base_score) < 1e-12 and abs(r.bits_per_byte * 3 - 32) < 1e-6
    assert lm.scores(one.limit(0)).count() == 0
