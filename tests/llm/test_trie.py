"""The trie against a plain one, with every cut of the sorted paths into ranges."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weekloom.llm import trie


def slow(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], sha(ends.get(p, []))) for p, m in members.items())


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit("clash")).withColumn("n", F.lit(1))


def conversations(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 900), n):
        size = rng.choice([1, 1, 2, 3, 5, 8])
        rows += [(c, t, rng.choice(["user", None, "a"]), rng.choice(["x", "yy", "zé😀", "", None])) for t in range(size)]
    rows += [(1000 + i, t, "user", "hot" * t) for i in range(120) for t in range(4)]  # one conversation, many times
    rows += [(2000 + i, 0, "system", "the same beginning") for i in range(100)] + [(2000 + i, 1, "user", f"own {i}") for i in range(100)]
    rows += [(3001, None, "user", "null turn"), (3001, 1, None, None), (3002, 5, "user", "w" * 200_000), (None, 1, "user", "nobody's")]
    rows += [(4001, t, "user", "long") for t in range(300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_against_plain_trie(spark, partitions):
    rows = conversations(partitions)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges cut anywhere
    try:
        got = sorted(tuple(-1 if v is None else v for v in r) for r in trie.nodes(table(spark, rows)).collect())
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == slow(rows)


def test_ranges_merge_to_the_same_points():
    """Points of every cut into two or three ranges add up to those of one range."""
    rng = random.Random(9)
    paths = sorted({"".join(rng.choice("ab") * trie.WIDTH for _ in range(rng.randint(0, 5))) for _ in range(40)})
    rows = [dict(path=p, sizes=[ord(p[i]) - 90 for i in range(0, len(p), trie.WIDTH)], n=i % 3 + 1, least=i * 7 % 50, ends=str(i)) for i, p in enumerate(paths)]

    def tree(cuts):
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        dealt = []
        for k, part in enumerate(parts):
            before = trie.shared_turns(parts[k - 1][-1]["path"], part[0]["path"]) if k else 0
            after = trie.shared_turns(part[-1]["path"], parts[k + 1][0]["path"]) if k + 1 < len(parts) else 0
            dealt += [r | {"part": k, "before": before, "after": after} for r in part]
        merged = {}
        for key, parent, above, depth, rest, last, n, least, kids, leaves, below, once, ends, _ in trie._points(iter(dealt)):
            old = merged.get(key)
            merged[key] = (n, least, kids, leaves, below, once, ends) if old is None else (old[0] + n, min(old[1], least), old[2] + kids, old[3] + leaves, old[4] + below, old[5] + once, old[6] or ends)
        return merged

    whole = tree([])
    for a in range(1, len(rows)):
        for b in [None, *range(a + 1, len(rows), 3)]:
            found = tree([a] if b is None else [a, b])
            assert all(found[k] == v for k, v in whole.items()), (a, b)


def test_empty_and_turnless(spark):
    assert trie.nodes(table(spark, []).where("false")).count() == 0
    rows = [(c, 0, "user", "only") for c in (1, 2, 3, 4, 5, 6, 7, 8)]  # h > 0 and no base: no turns at all
    got = sorted(tuple(-1 if v is None else v for v in r) for r in trie.nodes(table(spark, rows)).collect())
    assert got == slow(rows) and any(r[1] == 0 and r[3] == 8 for r in got)
