"""Line dedup against all pairs of lines."""

import random

import pytest
from pyspark.sql import functions as F

from weekloom.llm import components, line_dedup
from weekloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, k=2):
    """Texts after dedup, by union-find over all pairs of distinct lines."""
    lines = sorted({x for _, t in rows for x in (t or "").split("\n") if x.split()})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if min(len(a), len(b)) >= line_dedup.LEAST_CHARS and abs(len(a) - len(b)) <= k and distance(a, b) <= k:
                root[find(a)] = find(b)
    first = {}
    for d, t in sorted((r for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        for p, x in enumerate((t or "").split("\n")):
            if x.split():
                first.setdefault(find(x), (d, p))
    out = []
    for d, t in rows:
        keep = [x for p, x in enumerate((t or "").split("\n")) if not x.split() or first[find(x)] == (d, p)]
        out.append((d, None if t is None else "\n".join(keep)))
    return out


def typo(rng, s):
    for _ in range(rng.randint(0, 3)):
        i = rng.randrange(len(s) + 1)
        c = rng.choice("abcdé日")
        s = rng.choice([s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :]])
    return s


@pytest.mark.parametrize("dense", [16, 0])
def test_classes_match_all_pairs(spark, dense):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd éñ") for _ in range(rng.randint(12, 60))) + "x" for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(["", " ", "short", *[typo(rng, rng.choice(base)) for _ in range(3)]]) for _ in range(rng.randint(1, 8)))) for i in range(40)]
    rows += [(40, None), (41, ""), (None, base[0])]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs, dense=dense).collect()}
    assert got == dict(brute(rows))


def test_edit_distance_agrees(spark):
    rng = random.Random(7)
    pairs = [("", ""), ("a", ""), ("", "ab"), ("abc", "")]
    for _ in range(300):
        a = "".join(rng.choice("ab日") for _ in range(rng.randint(0, 12)))
        pairs.append((a, typo(rng, a)))
    rows = spark.createDataFrame(pairs, "a string, b string").withColumn("d", line_dedup.edit_distance(F.col("a"), F.col("b"))).collect()
    for r in rows:
        assert min(r.d, 3) == min(distance(r.a, r.b), 3), r


def test_edges(spark):
    assert line_dedup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "word " * 60_000
    docs = spark.createDataFrame([(1, long, 9), (1, long, 9), (2, long + "\nown line", 9), (3, None, None)], "doc_id long, text string, line long").withColumn("flags", F.lit("f")).withColumn("h", F.lit(0))
    got = sorted(((r.doc_id, r.text, r.n_dropped, r.flags) for r in line_dedup.dedup(docs).collect()), key=str)
    assert got == sorted([(1, long, 0, "f"), (1, long, 0, "f"), (2, "own line", 1, "f"), (3, None, 0, "f")], key=str)


def test_layouts_find_every_near_line():
    """Whatever two edits do to a line, some layout of it has the segments of the other's."""
    rng = random.Random(3)

    def keys(s, layouts, parts):
        for d, number, blocks in layouts:
            n = len(s) - d
            start = lambda i: i * (n // parts) + max(0, i - (parts - n % parts))  # noqa: B023, E731
            yield n, number, *(s[start(a) + m : start(b) + m] for a, b, m in blocks)

    for k, parts in ((1, 2), (1, 5), (2, 3), (2, 5), (2, 16), (3, 4), (3, 7)):
        layouts = line_dedup._layouts(parts, k)
        for _ in range(150):
            a = "".join(rng.choice("ab") for _ in range(rng.randint(20, 45)))
            b = a
            for _ in range(k):
                i, c = rng.randrange(len(b) + 1), rng.choice("abc")
                b = rng.choice([b[:i] + c + b[i:], b[:i] + b[i + 1 :], b[:i] + c + b[i + 1 :]])
            longer, shorter = (a, b) if len(a) >= len(b) else (b, a)
            assert set(keys(longer, layouts, parts)) & set(keys(shorter, line_dedup._own(layouts), parts)), (k, parts, a, b)


def test_a_large_group_of_near_copies_costs_its_size(spark):
    """2,000 lines that differ from one by a character, and 600 that differ by a whole word: the first
    are one class, with links in proportion to their number."""
    rng = random.Random(6)
    base = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(16))
    near = {base[:i] + c + base[i + 1 :] for i in range(len(base)) for c in "klmnopqrstuvwxyzKLMN"}
    near = sorted(near)[:2000]
    words = base.split()
    far = sorted({" ".join([*words[:i], "".join(rng.choice("zyxwvutsrq") for _ in range(6)), *words[i + 1 :]]) for i in [j % 16 for j in range(600)]})
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(near + far)], "h long, line string").select("h", F.lit(0).cast("long").alias("g"), line_dedup._letters(F.col("line")).alias("c"), "line")
    found = [(r.a.h, r.b.h) for r in line_dedup.near_links(lines.cache()).collect()]
    assert len(found) <= 20 * len(near + far)
    root = list(range(len(near + far)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[find(a)] = find(b)
    assert len({find(i) for i in range(len(near))}) == 1
    for i in range(len(near), len(root)):
        want = {find(j) for j in range(len(root)) if j != i and abs(len((near + far)[i]) - len((near + far)[j])) <= 2 and sum(x != y for x, y in zip((near + far)[i], (near + far)[j], strict=True)) <= 2}
        assert want <= {find(i)}


def test_a_line_costs_its_keys_once_and_is_counted_if_it_meets(spark, monkeypatch):
    """Keys without a shift are made for the index and not again as probes; letters are counted of
    lines that meet others only. Characters of one to four bytes; edits at both ends and shifts."""
    rng = random.Random(8)
    base = ["".join(rng.choice("abc dé日𝄞") for _ in range(rng.randint(30, 70))) for _ in range(30)]
    near = [(base[0], "𝄞" + base[0][:-1]), (base[1], base[1][1:] + "é"), (base[2], base[2][:9] + "日" + base[2][9:40] + base[2][41:]), (base[3], base[3][2:]), (base[4], base[4] + "é𝄞"), (base[5], "x" + base[5][1:-1] + "y")]
    texts = base + [b for _, b in near]
    keys, counted = [], []
    make, write = line_dedup._keys, line_dedup.written
    monkeypatch.setattr(line_dedup, "_keys", lambda lines, layouts, *rest: keys.append(len(layouts)) or make(lines, layouts, *rest))

    def seen(df, name):
        found = write(df, name)
        if "c" in df.columns and name == "texts":
            counted.append(found.count())
        return found

    monkeypatch.setattr(line_dedup, "written", seen)
    lines = spark.createDataFrame(list(enumerate(texts)), "h long, line string").select("h", F.lit(0).cast("long").alias("g"), "line")
    found = {frozenset((texts[r.a.h], texts[r.b.h])) for r in line_dedup.near_links(lines).collect()}
    assert found == {frozenset((a, b)) for i, a in enumerate(texts) for b in texts[:i] if distance(a, b) <= 2}
    assert found >= set(map(frozenset, near))
    assert sum(keys) == 12  # 15 if the three of the index were made again
    assert counted == [2 * len(near)]


def test_few_links_in_one_partition_give_the_same_classes(spark):
    rng = random.Random(10)
    edges = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(160)], "a long, b long").repartition(7)
    apart, together = (sorted(map(tuple, connected_components(edges, few=few).collect())) for few in (0, 160))
    assert apart == together and len({r for _, r in apart}) > 20


def rows_met(spark, monkeypatch, texts):
    """Links as pairs of texts, and how many pairs of lines met, letters turned down and were verified."""
    met, write = [], line_dedup.written

    def seen(df, name):
        found = write(df, name)
        if name in ("pairs", "likely", "middles"):
            met.append(found.count())
        return found

    with monkeypatch.context() as m:
        m.setattr(line_dedup, "written", seen)
        lines = spark.createDataFrame(list(enumerate(texts)), "h long, line string").select("h", F.lit(0).cast("long").alias("g"), "line")
        found = {frozenset((texts[r.a.h], texts[r.b.h])) for r in line_dedup.near_links(lines).collect()}
    return found, sum(met)


def test_near_copies_beyond_two_edits_meet_few(spark, monkeypatch):
    """Copies of a line with four letters put in at a random place: no two are within two edits but
    those made so. What meets grows with their number, not with its square."""
    rng = random.Random(9)
    base = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(50))
    copies = []
    while len(copies) < 800:
        i = rng.randrange(len(base))
        copies.append(base[:i] + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) + base[i:])
    near = [x[:-1] + "#" for x in copies[:20]]
    few, n1 = rows_met(spark, monkeypatch, copies[:400] + near)
    many, n2 = rows_met(spark, monkeypatch, copies + near)
    for a, b in zip(copies, near, strict=False):
        assert frozenset((a, b)) in few and frozenset((a, b)) in many
    assert all(distance(*pair) <= 2 for pair in map(tuple, many))
    assert n2 <= 3 * n1 and n2 <= 50 * len(copies), (n1, n2)


def test_the_pipelines_line_stage_meets_few_near_copies(spark, monkeypatch):
    """The stage of the pipeline on documents of one near copy each: all but true repeats stay."""
    import corpus_pipeline

    rng = random.Random(11)
    base = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(50))
    spots = [rng.randrange(len(base)) for _ in range(500)]
    copies = list(dict.fromkeys(base[:i] + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) + base[i:] for i in spots))
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(copies + [copies[7][:-1] + "#"])], SCHEMA)
    met, write = [], line_dedup.written

    def seen(df, name):
        found = write(df, name)
        if name in ("pairs", "likely", "middles"):
            met.append(found.count())
        return found

    monkeypatch.setattr(line_dedup, "written", seen)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert len(got) == len(copies) + 1 and got[len(copies)] == ("", 0)
    assert sum(1 for t, _ in got.values() if t) >= len(copies) - 20
    assert sum(met) <= 50 * len(copies), sum(met)


def test_the_pipelines_line_stage_runs_few_queries(spark, monkeypatch):
    """Tables are counted as they are written, so the stage runs one query for each table that it
    writes: counts and looks for rows had been almost as many again, each with its plan, stages and
    broadcasts on the driver."""
    import corpus_pipeline

    rng = random.Random(12)
    line = lambda: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(12))
    lines = [line() for _ in range(60)]
    crowd = [lines[0][:i] + "q" + lines[0][i + 1 :] for i in range(40)]
    texts = [*lines, *crowd, *(x[:-1] + "#" for x in lines[1:9]), *lines[:5]]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(texts)], SCHEMA)
    names, write = [], line_dedup.written
    for module in (line_dedup, components):
        monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or write(df, name))
    executions = spark._jsparkSession.sharedState().statusStore()
    before = executions.executionsCount()
    out = corpus_pipeline.lines(spark, docs, "")
    ran = executions.executionsCount() - before
    kept = {r.doc_id for r in out.collect() if r.text}
    assert kept == set(range(60))
    assert {"heads", "unlike", "first"} <= set(names)
    assert ran <= len(names), (ran, len(names))
