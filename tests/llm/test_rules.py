"""Quality rules and classifier, secrets, personal data, pages and neighbours on small fixtures."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from weekloom.llm import ann, html_extract, pii, quality_classifier, quality_rules, secrets

WORDS = "river stone paper cloud green table seven under music light house water after again small story".split()


def prose(rng, n):
    return " ".join((rng.choice(WORDS) + ("." if rng.random() < 0.1 else "")) for _ in range(n))


def slow_statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    often = Counter(zip(*(w[i:] for i in range(5)), strict=False))
    covered, seen, dup = set(), set(), 0
    for i in range(len(w) - 4):
        if often[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_base_statistics():
    rng = random.Random(5)
    texts = [None, "", " \n\x0b", "a b c", "é日 😀", "a a a a a a a a", "x\n\x1c\nx\n\x1c"] + ["".join(rng.choice("ab \n#|é") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    for t in texts:
        assert quality_rules.base_statistics(None if t is None else t.encode()) == slow_statistics(t), repr(t)


def test_outliers_go_and_clean_text_stays(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(60, 400)), "en", "hot" if i % 3 else "b") for i in range(400)]
    rows += [(1000 + i, " ".join(rng.choice(WORDS).upper() + rng.choice(["###", "$$$", "%%%"]) for _ in range(120)), "en", "hot") for i in range(12)]
    rows += [(2000, None, "en", "hot"), (2001, "", None, None), (2002, prose(rng, 40_000), "en", "b"), (2003, prose(rng, 300), "xx", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("grp", F.lit(1)).withColumn("x", F.lit(2))
    kept = {r.id: r.kept for r in quality_rules.judge(docs).collect()}
    assert len(kept) == len(rows)
    assert all(kept[i] for i in range(400)) and kept[2002] and kept[2003]
    assert not any(kept[1000 + i] for i in range(12)) and not kept[2000] and not kept[2001]
    assert sorted(r.doc_id for r in quality_rules.clean(docs).collect()) == sorted(i for i, k in kept.items() if k)
    assert quality_rules.judge(docs.limit(0)).count() == 0


def slow_estimate(x, support=quality_rules.SUPPORT):
    """The regularised estimate of one group with numpy: centre, covariance, logdet."""
    p = x.shape[1]
    floors = np.array(quality_rules.FLOORS)
    factor = support / quality_rules.chi_square_cdf(quality_rules.chi_square_quantile(support, p), p + 2)
    mid, scale = np.median(x, 0), np.maximum((np.quantile(x, 0.75, 0) - np.quantile(x, 0.25, 0)) / 1.349, floors)
    z = (x - mid) / scale
    best = None
    for v in (None, np.tanh(z), z / np.sqrt(np.square(z).sum(1, keepdims=True) + 1e-12)):
        r = np.eye(p) if v is None else v.T @ v / len(x) + 0.01 * np.eye(p)
        d = scale / np.sqrt(np.diag(r))
        centre, cov, was = mid, r * np.outer(d, d), np.inf
        for _ in range(100):
            d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov + np.diag(floors**2)), x - centre)
            near = x[np.argsort(d2, kind="stable")[: int(np.ceil(support * len(x)))]]
            centre, cov = near.mean(0), factor * np.cov(near.T, bias=True)
            now = np.linalg.slogdet(cov + np.diag(floors**2))[1]
            if was - now < 1e-9:
                break
            was = now
        if best is None or now < best[2]:
            best = centre, cov, now
    return best


def test_concentration_steps_find_the_clean_majority(spark):
    """Against the same estimate with numpy on one machine; radii are binned here, to 4 %."""
    rng = np.random.default_rng(7)
    p = len(quality_rules.STATS)
    mix = rng.normal(0, 1, (p, p)) / 2 + np.eye(p)
    x = np.vstack([rng.normal(0, 1, (600, p)) @ mix, rng.normal(6, 0.5, (120, p))])
    rows = spark.createDataFrame([("a", None, [float(v) for v in r]) for r in x], "grp string, parent string, x array<double>")
    got = quality_rules.estimates(rows).collect()
    centre, cov, logdet = slow_estimate(x)
    assert len(got) == 1 and np.abs(np.array(got[0].centre) - centre).max() < 0.1
    root = np.zeros((p, p))
    root[np.tril_indices(p)] = got[0].root
    assert abs(-2 * np.log(np.diag(root)).sum() - logdet) < 0.35
    assert np.abs(np.linalg.inv(root.T @ root) - cov - np.diag(np.square(quality_rules.FLOORS))).max() < 0.2 * np.diag(cov).max()
    d2 = np.square((x - np.array(got[0].centre)) @ root.T).sum(1)
    assert (d2[600:] > quality_rules.CUTOFF).all() and (d2[:600] < quality_rules.CUTOFF).mean() > 0.99


def test_small_groups_lean_on_their_parent(spark):
    rng = np.random.default_rng(8)
    p = len(quality_rules.STATS)
    x, few = rng.normal(0, 1, (500, p)), rng.normal(0.5, 1, (4, p))
    rows = [("all", None, r) for r in (*x, *few)] + [("few", "all", r) for r in few]
    got = {r.grp: r for r in quality_rules.estimates(spark.createDataFrame([(g, u, [float(v) for v in r]) for g, u, r in rows], "grp string, parent string, x array<double>")).collect()}
    assert np.abs(np.array(got["few"].centre) - np.array(got["all"].centre)).max() < 0.4
    ends = [i * (i + 3) // 2 for i in range(p)]
    assert (np.array(got["few"].root)[ends] / np.array(got["all"].root)[ends]).max() < 2


def test_classifier(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(900):
        good = i % 4 != 0
        t = prose(rng, rng.randint(20, 120)) if good else " ".join(rng.choice(WORDS).upper() + "!!" for _ in range(rng.randint(20, 120)))
        docs.append((i, t))
        if i % 2:
            labels.append((i, int(good), 0))
    docs += [(5000, None), (5001, ""), (None, "a null id"), (5002, "word " * 400_000)]
    d, l = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = quality_classifier.vectors(d)
    model = quality_classifier.fit(seen, l)
    rows = {r.id: r for r in quality_classifier.scores(seen, model).collect()}
    again = quality_classifier.fit(quality_classifier.vectors(d.repartition(5, "text")), l.repartition(3))
    assert all((a == b).all() for a, b in zip(model.p, again.p, strict=True))  # whatever the partitions
    held = [i for i in range(900) if rows[i].held_out]
    assert sum((rows[i].score >= quality_classifier.THRESHOLD) == (i % 4 != 0) for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows.values()) and not rows[None].held_out
    import zlib

    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(900))
    assert quality_classifier.fit(seen, l.limit(0)) is None
    assert quality_classifier.scores(quality_classifier.vectors(d.limit(0)), model).count() == 0


def luhn(x):
    return sum((v - 9 if v > 9 else v) for v in (int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(x)))) % 10 == 0


def slow_pii(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(x := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(x)]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans).encode()).hexdigest()


def test_personal_data(spark):
    rng = random.Random(9)
    parts = ["a@b.co", "x.y+z@mail-1.example.org", "a@b@c.de", "1.2.3.4.5.6.7.8", "999.1.1.1", "000.01.1.255", "4111 1111 1111 1111", "4111111111111112", "+1 (017) 555-7713", "+12", "é日", "..@", "_", " ", "-", "\n", "+44 20 7946 0958", "5500-0000-0000-0004", "12345678901234567890"]
    texts = [None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    texts += ["a." * 60_000, "1" * 60_000, "1.2.3.4 " * 3_000, "+1" + "(" * 30_000, "1 2 3 4 " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("c", F.lit(0)).withColumn("__t", F.lit("clash"))
    rows = {r.id: r for r in pii.find(docs).collect()}
    for i, t in enumerate(texts):
        want = slow_pii(t or "")
        n = Counter(s[3] for s in want)
        assert (rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone) == (n["email"], n["ip"], n["card"], n["phone"]), repr(t[:200])
        assert rows[i].base_sha256 == digest(want), repr(t[:200])
        assert {f"{k}:{s}:{e}" for s, _, e, k in want} <= set(rows[i].spans.split(","))
    assert pii.find(docs.limit(0)).count() == 0


def test_weak_labels_add_what_context_supports(spark):
    rng = random.Random(10)
    texts = [f"please call or phone ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} or mail a{i}@mail.example.com today" for i in range(60)]
    texts += [f"version order {rng.randint(10**15, 10**16 - 1)} item" for _ in range(60)]
    rows = {r.id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum("phone:" in rows[i].spans for i in range(60)) >= 55
    assert sum("card:" in rows[i].spans and not rows[i].n_card for i in range(60, 120)) == 0


def test_reliable_labelers_weigh_more():
    """Expectation-maximisation against truth: a labeler that is right counts, one that guesses not."""
    rng = random.Random(14)
    n = Counter()
    truth = {}
    for i in range(4000):
        yes = rng.random() < 0.6
        v = tuple((1 if (rng.random() < right) == yes else -1) for right in (0.95, 0.9, 0.9, 0.5))
        n[(0, i % 16, v)] += 1
        truth.setdefault(v, []).append(yes)
    rows = [(k, f, v, c) for (k, f, v), c in sorted(n.items())]
    post = pii.reliabilities(rows)
    for (_, _, v, _), p in zip(rows, post, strict=True):
        if len(truth[v]) > 200:
            assert abs(p - sum(truth[v]) / len(truth[v])) < 0.1
    w = pii.span_classifier(rows, post)
    assert w[0] - w[1] > 2 * abs(w[6] - w[7])
    assert pii.span_classifier([], []) == [0.0] * len(w)


def slow_secrets(t):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(11)
    parts = ["token", "PassWord", "apı_key", "api_key", "ſecret", "secret", ' = "', ": ", "=", '"', "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef" * 4, "é", "\n", " ", "value", "x"]
    texts = [None, "", "token" * 30_000, "0" * 100_000] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    rows = {r.id: r for r in secrets.secrets(docs).collect()}
    for i, t in enumerate(texts):
        want = slow_secrets(t or "")
        n = Counter(s[3] for s in want)
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == (n["assign"], n["access"], n["hex"]), repr(t)
        assert rows[i].base_sha256 == digest(want), repr(t)
    assert secrets.secrets(docs.limit(0)).count() == 0


def test_constants_are_propagated():
    text = 'base = "q9Zk4LmT7xWv2RbN"\nimport os\nauth_token = base\nname = "hello world text"\ndb:\n  client_secret: Zx81mQp4Lw0vT6yK\nurl = "http://x.y/z"\n'
    found = [text[s:e] for k, s, e in secrets.scan(text) if k == "literal"]
    assert "q9Zk4LmT7xWv2RbN" in found and all("hello" not in f and "http" not in f for f in found)
    assert any("Zx81mQp4Lw0vT6yK" in text[s:e] for _, s, e in secrets.scan(text))
    assert [k for k, _, _ in secrets.scan("The key point: tokens are words, and the secret is out.")] == []


def literals(text):
    return [text[s:e] for k, s, e in secrets.scan(text) if k == "literal"]


def test_secret_literals_are_whole():
    jwt = "eyJhbGciOi9" * 60
    assert literals(f'auth_header_token_x = "{jwt}"\n') == [jwt]
    assert literals('db_pwd = "aB3\\\\x9Qz7LmT"\n') == ['aB3\\\\x9Qz7LmT']
    assert literals('db_pwd = "p@ss\'w0rd!9Zk"\n') == ["p@ss'w0rd!9Zk"]
    assert literals('db_pwd = "q9\\"Zk4LmT7xW"\n') == ['q9\\"Zk4LmT7xW']
    assert literals("don't use db_pwd = \"q9Zk4LmT7xWv2R\", it's bad\n") == ["q9Zk4LmT7xWv2R"]
    assert "q9Zk4LmT7xWv2R" in literals("data = '{\"db_pwd\": \"q9Zk4LmT7xWv2R\"}'\n")
    assert literals('db_pwd = "q9Zk4LmT7xWv2R/4mN\n') == ["q9Zk4LmT7xWv2R/4mN"]
    many = [f"q9Zk4LmT7xWv2R{i}" for i in range(100)]
    assert literals("all = " + " + ".join(f'"{x}"' for x in many) + "\ndb_pwd = all\n") == many
    doubled = 'a0 = "q9Zk4LmT7xWv2R"\n' + "".join(f"a{i + 1} = a{i} + a{i}\n" for i in range(200)) + "db_pwd = a200\n"
    assert literals(doubled) == ["q9Zk4LmT7xWv2R"]
    secrets.scan('pwd = "' + '\\"' * 200_000)  # linear, or it would not end


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><header>Site</header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div id="content"><article><h1>Head &amp; more</h1><p>First   paragraph with a <a href=x>link</a> and
more words in it.<p>Second &lt;one&gt; here, of several words too.</p><aside>side</aside></article><div class="comments"><p>Nice post</p></div></div>
<div class="cookie-notice">Cookies</div><form><input name=q>Search</form><footer>&copy; 2020</footer>"""


def test_pages(spark):
    want = "Head & more\nFirst paragraph with a link and more words in it.\nSecond <one> here, of several words too."
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "just text"), (5, "u", "<div>" * 3000 + "deep" + "<p>" * 20_000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = {r.page_id: r for r in html_extract.extract_pages(pages).collect()}
    assert rows[1].text == want and rows[1].n_chars == len(want)
    assert (rows[2].text, rows[3].text, rows[4].text, rows[5].text) == ("", "", "just text", "deep")
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


ONE, TWO = "The first paragraph has a good number of words, and goes on.", "The second one has many words as well, as good ones do."


def test_text_after_unclosed_or_wrapped_parts_stays():
    both = f"{ONE}\n{TWO}"
    for page in (
        f'<p class="notice">N<p>{ONE}<p>{TWO}', f'<ul><li class="menu">M<li class="menu">K</ul><p>{ONE}<p>{TWO}', f"<button>Go<p>{ONE}<p>{TWO}", f"<svg/><p>{ONE}<p>{TWO}", f"<iframe/><p>{ONE}<p>{TWO}",
        f"<iframe src=x><p>{ONE}</p><p>{TWO}", f'<div class="side-by-side"><p>{ONE}<p>{TWO}</div>', f'<article><p>{ONE}<div class="related-work"><p>{TWO}</div></article>', f'<article><p>{ONE}<p class="comment">{TWO}</article>',
        f'<article><h2 id="search">{ONE}</h2><p>{TWO}</article>', f"<form><div><p>{ONE}<p>{TWO}</div></form>", f'<head><title>T<body class="x has-sidebar"><div id="content-sidebar-wrap" class="post with-comments"><p>{ONE}<p>{TWO}</div>',
        f'<div class="ad">Buy now.</div><div><p>{ONE}</p><p>{TWO}</p></div><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul><div class="comments"><p>Nice post</div>',
    ):
        assert html_extract.extract(page) == both, page
    sections = f"<main><article><section><p>{ONE}</p><p>{ONE}</p></section><section><h2>Head two</h2><p>{TWO}</p></section></article></main>"
    assert html_extract.extract(sections) == f"{ONE}\n{ONE}\nHead two\n{TWO}"
    for hard in ("<b>" * 40_000 + "x", "<b>" * 20_000 + "</i>" * 20_000, "<a><div>" + "<i>" * 20_000 + "</a>" * 20_000, "<div>" * 20_000 + "x"):
        began = time.process_time()
        html_extract.extract(hard)
        assert time.process_time() - began < 5


def test_densities_against_a_recomputation():
    """Random trees: every density from the node's own text and tags, the sum from its children."""
    rng = random.Random(15)

    def made(depth):
        tag = rng.choice(["div", "section", "span", "a"] if depth else ["div"])
        inner = "".join(rng.choice([made(depth + 1), prose(rng, rng.randint(1, 9))]) for _ in range(rng.randint(1, 4))) if depth < 4 else prose(rng, 3)
        return f"<{tag}>{inner}</{tag}>"

    def strings(node, link=False):
        link = link or node.tag == "a"
        out, tags = [], []
        for k in node.kids:
            if isinstance(k, str):
                out.append((len(k.strip()), link))
            else:
                tags.append(k.tag)
                o, t = strings(k, link)
                out, tags = out + o, tags + t
        return out, tags

    for _ in range(30):
        tree = html_extract._Tree()
        tree.feed(made(0).replace("<a>", "<i></i><a>"))
        order = html_extract._ordered(tree.body)
        html_extract._count(order)
        html_extract._measure(order)
        c_b, lc_b = (lambda s: (sum(n for n, _ in s), sum(n for n, link in s if link)))(strings(tree.body)[0])
        for node, link in order:
            s, tags = strings(node, link)
            c, lc, t, lt = sum(n for n, _ in s), sum(n for n, x in s if x), max(1, len(tags)), max(1, tags.count("a"))
            want = 0.0
            if c:
                base = math.log(c / max(1, c - lc) * lc + lc_b / max(1, c_b) * c + math.e)
                want = c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(max(base, 1.0001))
            assert abs(node.density - want) <= 1e-9 * max(1, want)
            assert abs(node.total - sum(k.density for k in node.kids if not isinstance(k, str))) < 1e-6
        assert tree.body.best.total == max(n.total for n, _ in order)


def test_neighbours(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 16)) + 2 * rng.normal(size=(10, 16))[rng.integers(0, 10, 1500)]
    x[300:800] = x[300]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit(1)).withColumn("v", F.lit(2))
    got = {}
    for r in ann.search(df, lambda i: i % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        score = (x * x[q]).cumsum(1)[:, -1]
        true = [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:20]
        hits += len({v for _, v, _ in found} & set(true))
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in {v for _, v, _ in found}
        assert all(s == score[v] for _, v, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
    assert hits / (20 * len(got)) >= 0.9
    few = ann.search(df.where("vec_id < 6"), lambda i: i % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4, 5]
    assert ann.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_equal_scores_go_to_the_smaller_id(spark):
    """60 distinct vectors of equal inner product with the query, and many of product zero."""
    rows = [(0, [1.0] + [0.0] * 63)] + [(i, [0.5] + [float(j == i) for j in range(1, 64)]) for i in range(60, 0, -1)]
    rows += [(100 + i, [0.0] + [float(j == i % 63 + 1) * (2 + i) for j in range(1, 64)]) for i in range(400)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), lambda i: i == 0, k=20).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(i, i, 0.5) for i in range(1, 21)]
    few = ann.search(spark.createDataFrame([r for r in rows if r[0] == 0 or r[0] > 60], "vec_id long, embedding array<double>"), lambda i: i == 0, k=20).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] == list(range(100, 120))
