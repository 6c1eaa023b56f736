"""Fill-in-middle against the pattern and a plain loop."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from weekloom.llm import fim


def slow(doc_id, text):
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def texts():
    rng = random.Random(3)
    odd = ["", None, "abc", "é", "a😀b", "<", "x<P>y", "<S", "<M<S", "P><P", "\n\n", "A" * 300_000 + "é" * 300_000, "\x00[`{@z"]
    return odd + ["".join(rng.choice("abZ é日😀<>PSM\n\t@[`{") for _ in range(rng.randint(1, 60))) for _ in range(400)]


def test_against_plain_loop(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "one two"), (7, "again"), (7, "again"), (-5, "minus")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("output", F.lit(1)).repartition(3)
    out = fim.transform(docs).withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n, r.form, r.prefix_chars or 0, r.middle_chars or 0, r.output) for r in out)
    assert got == sorted(((i is None, i or 0), *(x or 0 if k in (2, 3) else x for k, x in enumerate(slow(i, t or "")))) for i, t in rows)
    assert all(r.back == (r.text or "") for r in out)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0
