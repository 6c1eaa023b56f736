"""Personal data by weak supervision, with DataFrame and SQL functions only.

Candidate spans come from the plain patterns (email, ip, card, phone) and a few looser ones. Four
labelers vote on each: the pattern's own check, a gazetteer (top-level domains, country codes, issuer
prefixes, reserved networks), the words around it, and its shape. How often each combination of
votes, kind and span features occurs is counted over all documents; expectation-maximisation on that
table (some thousand rows at most, whatever the input) estimates how reliable each labeler is, and a
logistic span classifier is fitted to its posteriors, from the votes and from what the votes do not
say: kind, length, and what stands right before and after the span. Plain spans that pass their check always stand; looser candidates and
failed matches are added where the classifier believes them.

The patterns are the plain ones in linear-time form: possessive repeats, and a look behind so that a
run is entered at its start only. They find the same matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import written

#: In the order that breaks ties of starts.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = "|".join(
    (
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
        r"[A-Za-z0-9._%+-]{1,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[(\[]dot[)\]]\x20?|\.)[A-Za-z]{2,24}",
    )
)
# The gazetteer.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "biz", "co", "uk", "de", "fr", "es", "it", "nl", "eu", "us", "ca", "au", "ch", "at", "be", "se", "no", "dk", "pl", "pt", "br", "mx", "ar", "jp", "cn", "in", "ru")
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
RESERVED = r"^(?:0|10|127|192\.168|169\.254|255)\."
BANKS = r"^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|RO|SE)"
AROUND = {
    "email": r"mail|contact|write|correo|courriel|kontakt|schreib",
    "ip": r"\bip\b|host|server|address|login|adres|serveur|servidor",
    "card": r"card|visa|credit|master|amex|karte|carte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax|cell|anruf|appel|llam",
    "ssn": r"ssn|social|security|tax|steuer",
    "iban": r"iban|account|bank|konto|compte|cuenta",
}
AGAINST = r"version|\bv$|isbn|order|item|sku|serial|\bref\b|figure|section|chapter"
LABELERS = ("pattern", "gazetteer", "context", "shape")
ROUNDS, FIT_ROUNDS, RATE, BELIEVED = 8, 60, 1.0, 0.5
#: Matches whose lengths are summed up at once.
BLOCK = 32
#: Lengths at which a span goes to the next class.
LENGTHS = (10, 14, 20)
LEFT, RIGHT = r"(?:^|[\s:;,=\"'(<\[])$", r"^(?:$|[\s.,;:!?\"')>\]])"
_SPOT = "struct<start:int,end:int,k:int,base:boolean,v:array<int>,f:int>"


def _pieces(rows: DataFrame, name: str, pattern: str, there: Column) -> DataFrame:
    """Adds ``name``: struct of the texts between matches and the matches; null where ``there`` is
    false (a cheap necessary condition)."""
    t = F.col("__t")
    return rows.withColumn(name, F.when(there, F.struct(F.split(t, pattern, -1).alias("p"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("h"))))


def _let(x: Column, f) -> Column:
    """``f`` of ``x``, which is computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda acc, x: acc + x)


def _matches(name: str) -> Column:
    """Array of (start, end, hit, before, after), in code points, of a column of ``_pieces``.

    Starts are sums of the lengths before, taken in blocks: those of a block's own matches, after a list of the
    blocks' sums. So no match copies what is found before it."""
    p, h = F.col(name)["p"], F.col(name)["h"]
    spot = "struct<start:int,end:int,hit:string,before:string,after:string>"
    block = lambda sizes, i, n: F.slice(sizes, F.floor(i / BLOCK).cast("int") * BLOCK + 1, n)

    def before(sizes: Column) -> Column:
        step = lambda acc, b: F.struct((acc["at"] + _sum(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), zero, step, lambda acc: acc["out"])

    def spots(sizes: Column, offsets: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            start = F.get(offsets, F.floor(i / BLOCK).cast("int")) + _sum(block(sizes, i, i % BLOCK)) + F.length(F.get(p, i))
            return _let(start, lambda at: F.struct(at.alias("start"), (at + F.length(hit)).alias("end"), hit.alias("hit"), F.right(F.get(p, i), F.lit(32)).alias("before"), F.left(F.get(p, i + 1), F.lit(16)).alias("after")))

        return F.transform(h, one)

    found = _let(F.transform(h, lambda hit, i: F.length(F.get(p, i)) + F.length(hit)), lambda sizes: _let(before(sizes), lambda offsets: spots(sizes, offsets)))
    return F.when(F.size(h) > 0, found).otherwise(F.array().cast(f"array<{spot}>"))


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits holds."""

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _passes(kind: str, hit: Column) -> Column:
    """The plain pattern's own check."""
    n = F.length(_digits(hit))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(12, 19), _luhn(_digits(hit))).otherwise(False)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("int")


def _gazetteer(kind: str, hit: Column) -> Column:
    if kind == "email":
        known = F.lower(F.regexp_extract(hit, r"([A-Za-z]+)$", 1)).isin(*DOMAINS)
        return _vote(known, ~known)
    if kind == "ip":
        return _vote(~hit.rlike(RESERVED), hit.rlike(RESERVED))
    if kind == "card":
        known = _digits(hit).rlike(ISSUERS)
        return _vote(known, ~known)
    if kind == "phone":
        return _vote(hit.rlike(CALLING), F.lit(False))
    if kind == "iban":
        return _vote(hit.rlike(BANKS), ~hit.rlike(BANKS))
    return _vote(F.lit(False), hit.rlike("^(?:000|666|9)"))


def _shape(kind: str, hit: Column) -> Column:
    if kind == "email":
        return _vote(hit.rlike("^[A-Za-z0-9]"), hit.rlike(r"^[._%+-]|\.\."))
    if kind == "ip":
        return _vote(hit.rlike(r"^[1-9][0-9]{0,2}\."), hit.rlike(r"(?:^|\.)0[0-9]"))
    if kind == "card":
        return _vote(hit.rlike(r"^[0-9]{13,16}$|^[0-9]{4}(?:[\x20-][0-9]{4}){3}$"), hit.rlike(r"[\x20-][0-9][\x20-]|[0-9]{17}"))
    if kind == "phone":
        return _vote(hit.rlike(r"[().\x20-]"), hit.rlike(r"[().\x20-]{3}"))
    return _vote(hit.rlike(r"[\x20-]"), F.lit(False))


def _judged(kind: str, found: Column, plain: bool) -> Column:
    """Candidates of one kind: (start, end, kind, base, votes, features)."""

    def one(m: Column) -> Column:
        hit = m["hit"]
        ok = _passes(kind, hit) if plain else F.lit(False)
        own = _vote(ok, ~ok) if plain else F.lit(0)
        near = F.lower(F.concat(m["before"], F.lit(" "), m["after"]))
        context = _vote(near.rlike(AROUND[kind]), near.rlike(AGAINST))
        long = sum(((F.length(hit) >= n).cast("int") for n in LENGTHS), F.lit(0))
        features = long + F.when(m["before"].rlike(LEFT), 4).otherwise(0) + F.when(m["after"].rlike(RIGHT), 8).otherwise(0)
        votes = F.array(own, _gazetteer(kind, hit), context, _shape(kind, hit))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(KINDS.index(kind)).alias("k"), ok.alias("base"), votes.alias("v"), features.alias("f"))

    return F.transform(found, one)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, c) for every row of ``docs``; c: array of (start, end, k, base, v, f)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    digits = F.col("__t").rlike("[0-9]")
    guards = {"email": F.contains(F.col("__t"), F.lit("@")), "ip": digits, "card": digits, "phone": F.contains(F.col("__t"), F.lit("+"))}
    for kind, pattern in PATTERNS.items():
        rows = _pieces(rows, f"__{kind}", pattern, guards[kind])
    rows = _pieces(rows, "__loose", LOOSE, digits | F.contains(F.col("__t"), F.lit("at)")) | F.contains(F.col("__t"), F.lit("at]")))
    for name in (*PATTERNS, "loose"):
        rows = rows.withColumn(f"m_{name}", _matches(f"__{name}")).drop(f"__{name}")
    lists = []
    for kind in PATTERNS:
        found = F.col(f"m_{kind}")
        if kind == "card":  # most runs of digits are numbers of other kinds
            found = F.filter(found, lambda m: F.length(_digits(m["hit"])).between(12, 19))
        lists.append(_judged(kind, found, True))
    loose = F.col("m_loose")
    lists.append(_judged("ssn", F.filter(loose, lambda m: m["hit"].rlike(r"^[0-9]{3}-[0-9]{2}-")), False))
    lists.append(_judged("iban", F.filter(loose, lambda m: m["hit"].rlike("^[A-Z]{2}[0-9]{2}")), False))
    lists.append(_judged("phone", F.filter(loose, lambda m: m["hit"].rlike(r"^[(0-9]") & ~m["hit"].rlike(r"^[0-9]{3}-[0-9]{2}-")), False))
    lists.append(_judged("email", F.filter(loose, lambda m: m["hit"].rlike(r"[(\[]at[)\]]")), False))
    every = F.concat(*[F.coalesce(x, F.array().cast(f"array<{_SPOT}>")) for x in lists])
    return rows.select("id", every.alias("c"))


#: How often (kind, features, votes) occurs.
Combination = tuple[int, int, tuple[int, ...], int]


def _combinations(found: DataFrame) -> list[Combination]:
    """All that occur: 6 * 16 * 3**4 at most."""
    each = found.where(F.size("c") > 0).select(F.explode("c").alias("c"))
    votes = [f"v{i}" for i in range(len(LABELERS))]
    rows = each.groupBy(F.col("c.k").alias("k"), F.col("c.f").alias("f"), *[F.col("c.v")[i].alias(v) for i, v in enumerate(votes)]).agg(F.count(F.lit(1)).alias("n"))
    return sorted((r["k"], r["f"], tuple(r[v] for v in votes), r["n"]) for r in rows.collect())


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def reliabilities(rows: list[Combination], rounds: int = ROUNDS) -> list[float]:
    """The posterior that each combination is personal data, by expectation-maximisation over a
    latent class, with labelers independent within a class and a prior for each kind."""
    odds = [float(sum(v)) for _, _, v, _ in rows]  # the start: a majority
    for _ in range(rounds):
        votes = [[[1.0] * 3 for _ in LABELERS] for _ in range(2)]  # one imagined case each
        kinds = [[1.0] * len(KINDS) for _ in range(2)]
        for (k, _, v, n), o in zip(rows, odds, strict=True):
            for c, w in enumerate((n * (1 - _sigmoid(o)), n * _sigmoid(o))):
                kinds[c][k] += w
                for i, x in enumerate(v):
                    votes[c][i][x + 1] += w
        no, yes = [[[math.log(x / sum(each)) for x in each] for each in votes[c]] for c in range(2)]
        odds = [math.log(kinds[1][k] / kinds[0][k]) + sum(yes[i][x + 1] - no[i][x + 1] for i, x in enumerate(v)) for k, _, v, _ in rows]
    return [_sigmoid(o) for o in odds]


def _inputs(k: int, f: int, v: tuple[int, ...]) -> list[int]:
    """Places of the inputs that are 1: votes for and against, kind, length, sides, bias."""
    at = 2 * len(LABELERS)
    found = [2 * i + (x < 0) for i, x in enumerate(v) if x]
    return [*found, at + k, at + len(KINDS) + f % 4, *(at + len(KINDS) + 4 + i for i in range(2) if f >> (2 + i) & 1), at + len(KINDS) + 6]


def span_classifier(rows: list[Combination], posterior: list[float], rounds: int = FIT_ROUNDS) -> list[float]:
    """Weights of a logistic model of the posterior on ``_inputs``."""
    inputs = [_inputs(k, f, v) for k, f, v, _ in rows]
    weights = [0.0] * (2 * len(LABELERS) + len(KINDS) + 7)
    seen, total = [1e-8] * len(weights), sum(n for *_, n in rows)
    for _ in range(rounds if total else 0):
        slope = [0.0] * len(weights)
        for at, (*_, n), p in zip(inputs, rows, posterior, strict=True):
            gap = n / total * (_sigmoid(sum(weights[i] for i in at)) - p)
            for i in at:
                slope[i] += gap
        for i, g in enumerate(slope):
            seen[i] += g * g
            weights[i] -= RATE * g / math.sqrt(seen[i])
    return weights


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row of ``docs``.

    Counts and the digest cover the plain spans; ``spans`` has all, as kind:start:end by start and
    kind. A candidate that overlaps a plain span is never added. Null texts count as empty; repeated
    rows each get a row; an empty table gives an empty result; further columns are ignored."""
    found = written(candidates(docs, id_col, text_col), "candidates")
    rows = _combinations(found)
    weights = span_classifier(rows, reliabilities(rows))
    kinds, sizes = (F.array(*map(F.lit, weights[at : at + n])) for at, n in ((2 * len(LABELERS), len(KINDS)), (2 * len(LABELERS) + len(KINDS), 4)))

    def believed(c: Column) -> Column:
        logit = F.lit(weights[-1]) + F.get(kinds, c["k"]) + F.get(sizes, c["f"] % 4)
        for i in range(2):
            logit = logit + F.when(c["f"].bitwiseAND(F.lit(4 << i)) != 0, F.lit(weights[-3 + i])).otherwise(F.lit(0.0))
        for i in range(len(LABELERS)):
            logit = logit + F.when(c["v"][i] == 1, F.lit(weights[2 * i])).when(c["v"][i] == -1, F.lit(weights[2 * i + 1])).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)) >= BELIEVED

    rows = found.withColumn("b", F.array_sort(F.transform(F.filter("c", lambda c: c["base"]), _place)))
    rows = rows.withColumn("m", F.transform(F.filter("c", lambda c: ~c["base"] & believed(c)), _place))
    # overlaps are looked for only in the few documents that have something to add
    clear = F.filter("m", lambda a: ~F.exists("b", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    rows = rows.withColumn("m", F.when(F.size("m") > 0, clear).otherwise(F.col("m")))
    all_spans = F.array_sort(F.concat("b", "m"))
    counts = [_count(F.col("b"), k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return rows.select("id", *counts, F.sha2(_joined(F.col("b")), 256).alias("base_sha256"), _joined(all_spans).alias("spans"), F.size("m").cast("long").alias("n_added"))


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["k"] == kind)).cast("long")


def _place(c: Column) -> Column:
    return F.struct(c["start"].alias("start"), c["k"].alias("k"), c["end"].alias("end"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
