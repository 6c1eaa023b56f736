"""Line dedup by a segment-partition edit join, with DataFrame functions only.

Lines that are equal, or within ``THRESHOLD`` edits of each other (both at least ``LEAST_CHARS``
long), are linked; of each connected class of lines the first occurrence (smallest document id,
then position) stays. Lines without a word are left alone.

A line within k edits of another shares one of its k + 1 segments with it, near the same place
(Li et al., "Pass-Join", 2011). So every distinct line is indexed by the hashes of its segments and
probes with the substrings that could match a segment of a line up to k characters shorter, at the
places that multi-match-aware selection leaves. Pairs that meet lose their common ends and are
verified by a banded bit-parallel edit distance (Hyyrö 2003) in integer arithmetic.

Only hashes are shuffled for the join. Keys that a line has in common with the index as they are
(no shift) are the index itself, so of these only such as two lines have are sent as probes. Lines
that meet get packed counts of a few letters: an edit changes the counts by two in all, so pairs
whose counts differ by more than 2k are turned down before their texts are joined. Most lines meet
none and are never counted. A line that occurs many times enters once.

A segment that many lines share is not joined with itself. Its lines meet the least of them only,
and what is then one class needs no further look. Lines of a crowded segment whose classes differ go
on to the next of ``PARTS``: cut into more segments, of which all but k must be the same, at once.
Each step costs a line a fixed number of keys and a bucket's lines at most ``dense`` times that of
pairs; the last step has no bound, but there a bucket holds lines that are alike in all but k
forty-eighths (in all but k characters, for lines up to that length).
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import combinations, groupby, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import counted, forget, scratch, small, written
from weekloom.llm.components import connected_components

THRESHOLD = 2
LEAST_CHARS = 20
#: Lines of a segment from which they meet the least of them only; and by how much that rises from
#: one step to the next, as the keys of a line do.
DENSE_SEGMENT, DENSE_RISE = 8, 32
#: Segments beyond k in each step.
PARTS = (1, 3, 14, 46)
#: Rows of hashes up to which a table is broadcast (about 24 bytes each).
BROADCAST_ROWS = 1_000_000
#: Links up to which classes are found in one partition, without a shuffle.
FEW_LINKS = 4096
#: Letters that are counted, eight at most to a column, of one byte each: first, and in later steps.
LETTERS, MORE_LETTERS = " entaoir", ("shdlcumg", "pwfybkvj", "01234567")
#: Lines whose flags one number holds.
WORD_BITS = 63
#: Bytes of a character in the form that segments are cut from.
CODE_BYTES = 4
#: White space of a line; one of nothing else has no word.
BLANKS = " \t\n\x0b\x0c\r"

#: Characters shorter, number of the choice, and (from segment, to segment, shift) of what is shared.
Layout = tuple[int, int, list[tuple[int, int, int]]]


def _layouts(parts: int, k: int) -> list[Layout]:
    """Ways in which a line can share all but ``k`` of the ``parts`` segments of one up to ``k``
    characters shorter. A run of segments left out can be taken to hold as many edits as it has
    segments at most, so by no more do the shifts on its sides differ."""
    out: list[Layout] = []
    for number, bad in enumerate(combinations(range(parts), k)):
        runs = [[i for _, i in g] for _, g in groupby(enumerate(bad), lambda x: x[1] - x[0])]
        for moves in product(*(range(-len(r), len(r) + 1) for r in runs)):
            if sum(map(abs, moves)) > k or not 0 <= sum(moves) <= k:
                continue
            blocks, at, shift = [], 0, 0
            for run, move in zip(runs, moves, strict=True):
                blocks.append((at, run[0], shift))
                at, shift = run[-1] + 1, shift + move
            blocks.append((at, parts, shift))
            out.append((shift, number, [b for b in blocks if b[0] < b[1]]))
    return out


def _own(layouts: list[Layout]) -> list[Layout]:
    return [x for x in layouts if not x[0] and not any(s for _, _, s in x[2])]


def _code(line: str) -> Column:
    """The line in four bytes a character, of which any part is found without going through the rest."""
    return F.encode(F.col(line), "UTF-32")


def _chars(code: str) -> Column:
    return F.expr(f"octet_length({code}) div {CODE_BYTES}").cast("int")


def _keys(lines: DataFrame, layouts: list[Layout], parts: int, *carry: str) -> DataFrame:
    """(carry, key) for each line and layout. Of the even segments of a length the longer ones come
    last. Layouts are rows of a literal before the key is made, so that the code for it stays small
    enough to be compiled."""
    most = max(len(b) for _, _, b in layouts)
    spots = json.dumps([{"d": d, "i": i} | {f"{n}{j}": x for j, block in enumerate(b + [(0, 0, 0)] * (most - len(b))) for n, x in zip("abs", block, strict=True)} for d, i, b in layouts])
    kind = ", ".join(["d int", "i int", *(f"{n}{j} int" for j in range(most) for n in "abs")])
    coded = lines.select(*carry, _code("line").alias("code")).select("*", _chars("code").alias("n"))
    rows = coded.select("*", F.explode(F.from_json(F.lit(spots), f"array<struct<{kind.replace(' int', ':int')}>>")).alias("p")).select(*carry, "code", (F.col("n") - F.col("p.d")).alias("n"), "p.*")
    short, first_long = F.expr(f"n div {parts}").cast("int"), F.expr(f"{parts} - n % {parts}")
    start = lambda i: i * short + F.greatest(F.lit(0), i - first_long)
    shared = [F.substring(F.col("code"), (start(F.col(f"a{j}")) + F.col(f"s{j}")) * CODE_BYTES + 1, (start(F.col(f"b{j}")) - start(F.col(f"a{j}"))) * CODE_BYTES) for j in range(most)]
    return rows.select(*carry, F.xxhash64("n", "i", *shared).alias("key"))


def _letters(line: Column, letters: str = LETTERS) -> Column:
    """Counts of ``letters``, up to 255 each, packed into a long. A loop: written out, the code would
    be too long to be compiled."""

    def add(packed: Column, letter: Column) -> Column:
        n = F.octet_length(line) - F.octet_length(F.replace(line, letter, F.lit("")))
        return F.shiftleft(packed, 8).bitwiseOR(F.least(F.lit(255), n).cast("long"))

    return F.aggregate(F.array(*map(F.lit, letters)), F.lit(0).cast("long"), add)


def _letter_gap(x: Column, y: Column, letters: str = LETTERS) -> Column:
    """By how much two packed counts differ in all: at most twice the edit distance."""
    at = lambda c, i: F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255))
    return sum((F.abs(at(x, i) - at(y, i)) for i in range(len(letters))), F.lit(0))


def _common(a: Column, b: Column, most: Column, last: bool) -> Column:
    """Length of the common prefix (or suffix) of two lines of ``_code``, by halving; ``most``: length
    of the shorter one, under 2^20 characters."""
    cut = (lambda s, n: F.substring(s, -n * CODE_BYTES, n * CODE_BYTES)) if last else (lambda s, n: F.substring(s, F.lit(1), n * CODE_BYTES))
    steps = F.array(*[F.lit(1 << e) for e in range(19, -1, -1)])
    grow = lambda n, s: F.when((n + s <= most) & (cut(a, n + s) == cut(b, n + s)), n + s).otherwise(n)
    return F.aggregate(steps, F.lit(0), grow)


def edit_distance(a: Column, b: Column, k: int = THRESHOLD) -> Column:
    """Edit distance of two string columns if it is at most ``k``, else a number above ``k``.

    One word of 2k + 1 bits holds the differences along the band's column; each character of the
    shorter string moves the band one place down (Hyyrö's recurrences). Two equal characters are put
    before both strings, which the band's first columns need."""
    longer, shorter = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    pad = F.lit("\x01" * k)
    # an expression language without let: a one-element array is bound by a lambda. Rows are read
    # through the binding and not carried along, since what a lambda returns is copied.
    bound = F.array(F.struct(F.split(F.concat(pad, longer), "").alias("rows"), F.split(F.concat(pad, shorter), "").alias("cols")))
    found = F.element_at(F.transform(bound, lambda s: _banded(s["rows"], s["cols"], k)), 1)
    return F.when(F.abs(F.length(a) - F.length(b)) > k, F.lit(k + 1)).otherwise(found)


def _banded(rows: Column, cols: Column, k: int) -> Column:
    """The distance of two arrays of characters, of which ``rows`` is not the shorter."""
    w = 2 * k + 1
    full, high = (1 << w) - 1, 1 << (w - 1)
    marks = F.array(*[F.lit(1 << max(0, w - 2 - e)) for e in range(k + 1)])

    def bits(x: Column, y: Column) -> Column:
        return x.bitwiseAND(y)

    def step(acc: Column, c: Column) -> Column:
        match = F.lit(0)
        for bit in range(w):
            at = acc["j"] + F.lit(k + 1 - w + bit)  # row of this bit
            match = match + F.when((at >= 0) & (F.get(rows, at) == c), F.lit(1 << bit)).otherwise(0)
        one = F.array(F.struct(acc["j"].alias("j"), acc["vp"].alias("vp"), acc["vn"].alias("vn"), acc["d"].alias("d"), match.alias("x")))

        def diagonal(s: Column) -> Column:
            d0 = bits(((bits(s["x"], s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(s["x"]).bitwiseOR(s["vn"]), F.lit(full))
            return F.struct(s["j"].alias("j"), s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), d0.alias("d0"))

        def moved(s: Column) -> Column:
            hp = bits(s["vn"].bitwiseOR(F.bitwise_not(s["d0"].bitwiseOR(s["vp"]))), F.lit(full))
            return F.struct(s["j"].alias("j"), s["d"].alias("d"), s["d0"].alias("d0"), hp.alias("hp"), bits(s["d0"], s["vp"]).alias("hn"), (s["j"] - (F.size(rows) - k)).alias("past"))

        def last(s: Column) -> Column:
            down = F.shiftright(s["d0"], 1)
            mark = F.element_at(marks, F.greatest(F.lit(0), F.least(s["past"], F.lit(k))) + 1)
            side = (bits(s["hp"], mark) != 0).cast("int") - (bits(s["hn"], mark) != 0).cast("int")
            d = s["d"] + F.when(s["past"] < 0, (bits(s["d0"], F.lit(high)) == 0).cast("int")).otherwise(side)  # on the diagonal, then along the last row
            return F.struct((s["j"] + 1).alias("j"), bits(s["hn"].bitwiseOR(F.bitwise_not(down.bitwiseOR(s["hp"]))), F.lit(full)).alias("vp"), bits(down, s["hp"]).alias("vn"), d.alias("d"))

        return F.element_at(F.transform(F.transform(F.transform(one, diagonal), moved), last), 1)

    start = F.struct(F.lit(0).alias("j"), F.lit((full << (w - k - 1)) & full).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("d"))
    # far above the bound nothing is worth computing
    on = lambda acc, c: F.when(acc["d"] > 3 * k, acc).otherwise(step(acc, c))
    return F.aggregate(cols, start, on, lambda acc: acc["d"])


def _trimmed(pairs: DataFrame) -> DataFrame:
    """(a, b, x, y): the middles of the lines ``la`` and ``lb``. Each step is written: the next one
    names its columns many times over, and a plan would repeat their making."""
    coded = pairs.select("*", _code("la").alias("ca"), _code("lb").alias("cb")).select("*", F.least(_chars("ca"), _chars("cb")).alias("most"))
    ends = [_common(F.col("ca"), F.col("cb"), F.col("most"), last).alias(name) for name, last in (("pre", False), ("suf", True))]
    one = written(coded.select("a", "b", "la", "lb", "most", *ends), "ends")
    cut = F.col("pre") + F.least(F.col("suf"), F.col("most") - F.col("pre"))  # the ends may overlap
    two = written(one.select("a", "b", *[F.substring(F.col(c), F.col("pre") + 1, F.length(c) - cut).alias(x) for c, x in (("la", "x"), ("lb", "y"))]), "middles")
    forget(one)
    return two


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dk, pos, line) of every line; dk: hash of the text, which tells apart rows of one id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("dk"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def _hashed(lines: DataFrame) -> DataFrame:
    """With the two halves h and g of a 128-bit hash; null for lines without a word."""
    there = F.ltrim(F.col("line"), F.lit(BLANKS)) != ""
    return lines.withColumn("h", F.when(there, F.xxhash64("line"))).withColumn("g", F.when(there, F.xxhash64(F.lit(1), F.col("line"))))


def near_links(lines: DataFrame, k: int = THRESHOLD, dense: int = DENSE_SEGMENT, parts: Sequence[int] = PARTS) -> DataFrame:
    """Pairs (a, b) of structs (h, g): distinct lines within ``k`` edits, such that their closure is
    that of all pairs within ``k``. ``lines``: h, g, line, each line of ``LEAST_CHARS`` or more
    once; read several times."""
    links, todo = None, lines
    for step, more in enumerate(parts):
        last = step == len(parts) - 1
        met, heads = _met(todo, k + more, k, None if last else dense * DENSE_RISE**step, rooted=step > 0)
        pairs = written(counted(met.where("near").select(F.least("h", "h1").alias("h1"), F.greatest("h", "h1").alias("h2")).distinct()), "pairs")
        found = _verified(_with_texts(pairs, todo, k, letters=step == 0), k)
        links = found if links is None else written(links.union(found), "links")
        if last or not heads.measured["rows"]:
            return links
        crowd = written(counted(met.where("crowded").select("h", "key").union(heads.select("h", "key"))), "crowd")
        forget(met, heads)
        todo = _unlike(todo, crowd, links)
        if not todo.measured["rows"]:
            return links
    return links


def _met(lines: DataFrame, parts: int, k: int, dense: int | None, rooted: bool) -> tuple[DataFrame, DataFrame]:
    """(pairs, heads). Pairs (h, h1, key, crowded, near) of lines that meet in a bucket; in one of
    more than ``dense`` lines, with its head only. Near are those that letters and classes don't turn
    down, if ``rooted``, and all otherwise. Heads: key, h and so on of such a bucket's least line."""
    layouts = _layouts(parts, k)
    own = _own(layouts)
    carry = ["h", *(["c", *(f"m{j}" for j in range(len(MORE_LETTERS))), "root"] if rooted else [])]
    indexed = written(_keys(lines, own, parts, *carry), "index")
    shared = written(counted(indexed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")), "shared")
    several = written(counted(indexed.join(small(shared, BROADCAST_ROWS), "key"), most=F.max("n")), "several")
    most = several.where(F.lit(False) if dense is None else F.col("n") > dense)
    none = dense is None or (several.measured["most"] or 0) <= dense
    heads = written(counted(most.drop("n") if none else most.groupBy("key").agg(F.min(F.struct(*carry)).alias("first")).select("key", "first.*")), "heads")
    crowded = small(heads, BROADCAST_ROWS)
    index = indexed.join(crowded, "key", "left_anti").withColumn("crowded", F.lit(False)).unionByName(heads.withColumn("crowded", F.lit(True)))
    i = index.select(F.col("key").alias("k1"), "crowded", *[F.col(c).alias(f"{c}1") for c in carry])
    near = F.lit(True)
    if rooted:
        gaps = [_letter_gap(F.col(f"m{j}"), F.col(f"m{j}1"), letters) for j, letters in enumerate(MORE_LETTERS)]
        near = (sum(gaps, _letter_gap(F.col("c"), F.col("c1"))) <= 2 * k) & (F.col("root") != F.col("root1"))
    probes = _keys(lines, [x for x in layouts if x not in own], parts, *carry).unionByName(several.drop("n"))
    met = probes.join(i, (F.col("key") == F.col("k1")) & (F.col("h") != F.col("h1")) & (F.col("crowded") | near))
    out = written(met.select("h", "h1", "key", "crowded", near.alias("near")), "met")
    forget(indexed, shared, several)
    return out, heads


def _unlike(lines: DataFrame, crowd: DataFrame, links: DataFrame) -> DataFrame:
    """The lines of crowded buckets (h, key) in which lines of several classes meet, with their class
    as ``root`` and counts of more letters."""
    roots = connected_components(links, few=FEW_LINKS).select(F.col("node.h").alias("h"), F.col("node.g").alias("g"), F.col("root").alias("found"))
    here = lines.select("h", "g", "line").join(small(crowd.select("h"), BROADCAST_ROWS, crowd.measured["rows"]), "h", "left_semi")
    rows = written(here.join(roots, ["h", "g"], "left").select("h", "g", _letters(F.col("line")).alias("c"), "line", F.coalesce("found", F.struct("h", "g")).alias("root"), *[_letters(F.col("line"), x).alias(f"m{j}") for j, x in enumerate(MORE_LETTERS)]), "rooted")
    of = crowd.join(rows.select("h", "root"), "h")
    mixed = written(counted(of.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")), "mixed")
    names = crowd.join(small(mixed, BROADCAST_ROWS), "key", "left_semi").select("h")
    return written(counted(rows.join(small(written(counted(names), "names"), BROADCAST_ROWS), "h", "left_semi")), "unlike")


def _with_texts(pairs: DataFrame, lines: DataFrame, k: int, letters: bool) -> DataFrame:
    """(a, la, b, lb) of the pairs (h1, h2) of hashes; with ``letters``, of those that they don't
    turn down: in later steps they did where lines met."""
    names = small(pairs.select(F.col("h1").alias("h")).union(pairs.select("h2")), BROADCAST_ROWS, 2 * pairs.measured["rows"])
    here = lines.join(names, "h", "left_semi")
    texts = written(counted(here.select("h", "g", "line", *([_letters(F.col("line")).alias("c")] if letters else []))), "texts")
    likely = pairs
    if letters:
        c1, c2 = (small(texts.select(F.col("h").alias(f"h{j}"), F.col("c").alias(f"c{j}")), BROADCAST_ROWS, texts.measured["rows"]) for j in (1, 2))
        likely = written(pairs.join(c1, "h1").join(c2, "h2").where(_letter_gap(F.col("c1"), F.col("c2")) <= 2 * k).select("h1", "h2"), "likely")
    one = texts.select(F.col("h").alias("h1"), F.struct("h", "g").alias("a"), F.col("line").alias("la"))
    two = texts.select(F.col("h").alias("h2"), F.struct("h", "g").alias("b"), F.col("line").alias("lb"))
    return likely.join(one, "h1").join(two, "h2").select("a", "la", "b", "lb")


def _verified(pairs: DataFrame, k: int) -> DataFrame:
    close = _trimmed(pairs)
    return written(close.where(edit_distance(F.col("x"), F.col("y"), k) <= k).select("a", "b"), "links")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = THRESHOLD, dense: int = DENSE_SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(occurrences, roots): every line with a word as (id, dk, pos, h, g), and the class of those
    lines that are not alone as (h, g, class)."""
    scan = _hashed(_lines(docs, id_col, text_col))
    seen = written(scan.select("id", "dk", "pos", "h", "g"), "seen")
    there = seen.where("h IS NOT NULL")
    often = there.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "dk", "pos")).alias("at")).where("n > 1")
    copied = written(counted(often.select("h", "g", "at")), "copied")
    # of a line that occurs more than once, its first occurrence stands for it
    usable = scan.where(F.length("line") >= LEAST_CHARS).where("h IS NOT NULL").join(small(copied, BROADCAST_ROWS), ["h", "g"], "left")
    once = usable.where(F.col("at").isNull() | F.struct("id", "dk", "pos").eqNullSafe(F.col("at"))).select("h", "g", "line")
    near = connected_components(near_links(written(once, "lines"), k, dense), few=FEW_LINKS)
    named = near.select(F.col("node.h").alias("h"), F.col("node.g").alias("g"), F.col("root").alias("class"))
    alone = copied.join(named.select("h", "g"), ["h", "g"], "left_anti").select("h", "g", F.struct("h", "g").alias("class"))
    return seen, written(counted(named.unionByName(alone)), "classes")


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = THRESHOLD, dense: int = DENSE_SEGMENT) -> DataFrame:
    """(id, dk, flags, dropped): for each document with a line to drop, a bit for each of its lines,
    ``WORD_BITS`` to a number, and how many are set."""
    seen, roots = classes(docs, id_col, text_col, k, dense)
    rows = written(seen.where("h IS NOT NULL").join(small(roots, BROADCAST_ROWS), ["h", "g"]).select("id", "dk", "pos", "class"), "members")
    stays = small(written(counted(rows.groupBy("class").agg(F.min(F.struct("id", "dk", "pos")).alias("first"))), "first"), BROADCAST_ROWS)
    drops = rows.join(stays, "class").where(~F.struct("id", "dk", "pos").eqNullSafe(F.col("first")))
    bit = F.expr(f"shiftleft(1L, pos % {WORD_BITS})")
    words = drops.groupBy("id", "dk", F.expr(f"cast(pos div {WORD_BITS} AS int)").alias("w")).agg(F.bit_or(bit).alias("bits"))
    found = words.groupBy("id", "dk").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"), F.max("w").alias("top"), F.sum(F.bit_count("bits")).cast("int").alias("dropped"))
    dense_words = F.transform(F.sequence(F.lit(0), F.col("top")), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long")))
    return found.select("id", "dk", dense_words.alias("flags"), "dropped")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = THRESHOLD, dense: int = DENSE_SEGMENT) -> DataFrame:
    """``docs`` with ``text_col`` less its dropped lines, and the columns ``n_lines`` and
    ``n_dropped`` (replaced if there); all other columns and all rows stay.

    A null text stays null and has no lines; an empty one has one line, without a word. Documents all
    of whose lines are dropped become empty. Rows that repeat id and text are one document and get
    one answer; null ids come first. An empty table gives an empty result."""
    with scratch() as keep:
        found = keep(written(flagged(docs, id_col, text_col, k, dense), "flags"))
    found = found.select(F.col("id").alias("__i"), F.col("dk").alias("__d"), F.col("flags").alias("__f"), F.col("dropped").alias("__n"))
    keys = docs[id_col].eqNullSafe(found["__i"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == found["__d"])
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(lines, lambda x, i: F.coalesce(F.getbit(F.get(F.col("__f"), F.floor(i / WORD_BITS).cast("int")), i % WORD_BITS), F.lit(0)) == 0)
    text = F.when(F.col("__f").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    n = F.coalesce(F.size(lines), F.lit(0))
    joined = docs.drop("n_lines", "n_dropped").join(found, keys, "left")
    return joined.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(n)).withColumn("n_dropped", F.coalesce("__n", F.lit(0))).withColumn(text_col, text).drop("__i", "__d", "__f", "__n")
