"""Work that grows with a text, not with its square; results that don't hang on unrelated text; pages of the review."""

import random
import time

from pyspark.sql import functions as F

from weekloom.llm import bpe, html_extract, pii, secrets
from weekloom.llm.queries import vocabulary


def seconds(f):
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def test_bpe_long_word():
    a = bpe.automaton(vocabulary())
    word = "日本" * 200_000
    small = seconds(lambda: a.run((word[:40_000]).encode()))
    large = seconds(lambda: a.run(word.encode()))
    assert large < 40 * small + 2  # ten times the text
    assert a.decode(list(a.run(word.encode()))) == word


def test_pii_many_numbers(spark):
    text = "12, " * 200_000 + "write to me@example.com or 4111 1111 1111 1111"
    docs = spark.createDataFrame([(1, text), (2, "10.0.0.1 " * 20_000)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.id: r for r in pii.find(docs).collect()}
    assert time.perf_counter() - began < 90
    assert (got[1].n_email, got[1].n_card, got[2].n_ip) == (1, 1, 20_000)
    at = text.index("me@")
    assert f"email:{at}:{at + 14}" in got[1].spans and f"card:{len(text) - 19}:{len(text)}" in got[1].spans
    assert got[2].spans.startswith("ip:0:8,ip:9:17,") and got[2].spans.endswith(f"ip:{9 * 19_999}:{9 * 19_999 + 8}")


def test_match_places(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("1é 😀x,") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, __t string")
    got = pii._pieces(rows, "__a", "1+", F.lit(True)).select("id", pii._matches("__a").alias("m")).collect()
    import re

    for r in got:
        t = texts[r.id]
        assert [(m.start, m.end, m.hit, m.before, m.after) for m in r.m] == [
            (x.start(), x.end(), x[0], re.split("1+", t)[k][-32:], re.split("1+", t)[k + 1][:16]) for k, x in enumerate(re.finditer("1+", t))
        ]


def test_unclosed_markup():
    for part in ("<!--", "<!x", "<?x", "<![CDATA[", "<a ", "</", '<a b="x', "<", "<!--<p>", "<![CDATA[<p>", "<script><p>"):
        assert seconds(lambda: html_extract.extract("<p>Some text is here.</p>" + part * (600_000 // len(part)))) < 20, part
    assert html_extract.extract("<p>Some text is here.</p><a href='") == "Some text is here."


def test_pages_of_the_review():
    p = "".join(f"<p>Paragraph {i} of the article has some words, more than a few of them.</p>" for i in range(3))
    article = html_extract.extract(p)
    assert article.count("\n") == 2
    assert html_extract.extract(f'<body><div class="widget text">{p}</div><p>short</p></body>') == article
    assert html_extract.extract('<body><p>He gave <span class="notice">due notice</span> of it.</p></body>') == "He gave due notice of it."
    assert html_extract.extract(f'<body><div class="post"><header><h1>Title here</h1></header>{p}</div></body>') == f"Title here\n{article}"
    assert html_extract.extract(f'<body><header><a href="/">Site</a></header>{p}<div class="widget">Few words</div></body>') == article
    assert html_extract.extract(f'<body><article>{p}</article><div class="comments">{p * 4}</div></body>') == article


def test_secrets_stand_by_themselves():
    base = 'api_access = "Zx9Qm7Lr2Tk8Vw4Np6Bc"\n'
    want = [s for s in secrets.scan(base)]
    assert want == [("literal", 14, 34)]
    for more in ("the key\n", "a password of sorts\n", "nothing\n", "x = 1\n"):
        assert secrets.scan(base + more) == want
    assert secrets.scan('session_access = "Zx9Qm7Lr2Tk8Vw4Np6Bc"')[0][0] == "literal"
    # a word within key material is no placeholder, a part or the whole value is
    assert [k for k, _, _ in secrets.scan('auth_key = "q8testZ2nonePw7yK4vB"')] == ["literal"]
    for value in ("your-Key-12345678", "EXAMPLE_9fK2mQ7x", "changeme"):
        assert not [s for s in secrets.scan(f'auth_key = "{value}"') if s[0] == "literal"]


def test_guard_is_necessary():
    rng = random.Random(1)
    parts = [*secrets.NAME_WEIGHTS, "my", "Foo", "x2"]
    for _ in range(3000):
        name = rng.choice(["_", "", "."]).join(rng.choice([str.lower, str.title])(rng.choice(parts)) for _ in range(rng.randint(1, 4)))
        if secrets.name_score(name) > 0:
            assert any(w in name.lower().encode() for w in secrets._NAME_WORDS), name
