"""The automaton against the tokenizers library, and round trips."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weekloom.llm import bpe
from weekloom.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    return bpe.automaton(vocabulary()), tokenizers.Tokenizer.from_file(vocabulary())


def check(pair, text):
    a, lib = pair
    ids = lib.encode(text, add_special_tokens=False).ids
    assert a.encode(text) == ids
    assert a.decode(ids) == lib.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text(pair, text):
    check(pair, text)


def test_odd_texts(pair):
    rng = random.Random(3)
    for t in ("", "<|endoftext|>", "a<|endoftext|>\n<|endoftext|>b", "x" * 3000, "-=" * 900, " " * 700 + "y", "日本語😀" * 60, "don't WE'LL it's"):
        check(pair, t)
    for _ in range(300):
        check(pair, "".join(rng.choice("ab -=_\n\t01é日") for _ in range(rng.randint(0, 200))))


def test_columns(spark, pair):
    docs = spark.createDataFrame([(1, "Hello world", 7), (2, None, 8), (3, "", 9)], "doc_id long, text string, ids long")
    rows = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary()).orderBy("doc_id").collect()
    assert [r.decoded for r in rows] == ["Hello world", "", ""]
    assert list(rows[0].ids) == pair[1].encode("Hello world").ids
    assert bpe.digests(docs.limit(0), vocabulary()).count() == 0
    assert [r.n_tokens for r in bpe.digests(docs.withColumn("id", F.lit(0)), vocabulary()).orderBy("id").collect()] == [2, 0, 0]


def test_plane_split_is_the_patterns(tmp_path):
    """Texts of the basic plane are split by the standard module; every character of it goes the same way."""
    a = bpe.automaton(vocabulary())
    plane = "".join(chr(i) for i in range(1 << 16) if not 0xD800 <= i < 0xE000)
    rng = random.Random(4)
    odd = list(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 　᠎'sTrevmld a1.\xb2\xbdⅧé中")
    texts = [plane, "a\U0001d400 \U0001f600  b", *("".join(rng.choice(odd) for _ in range(40)) for _ in range(2000)), *("".join(rng.choice(plane) for _ in range(40)) for _ in range(2000))]
    assert all(a.split_plane(t) == a.split_any(t) for t in texts if max(t) < "\U00010000")
    assert all(a.split(t) == a.split_any(t) for t in texts)
