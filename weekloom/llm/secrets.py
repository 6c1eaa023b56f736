"""Secret scan: plain patterns, and assignment-aware lexing of source and configuration syntax.

The plain patterns always count. Beside them, lines are lexed into name-literal pairs
(``name = "x"``, ``name: x``, ``"name": "x"``, ``-Dname=x``, ``<name>x</name>``), constants are
propagated through names (``a = "x"`` ... ``token = a + "y"``), and a literal is reported when a
name it reaches is sensitive and the literal looks like key material.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The maximal runs of 24 and more are what the plain pattern's matches of that length are.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_ONLY = bytes(97 if chr(i) in "0123456789abcdef" else 32 for i in range(256))

#: Weights of the parts of a name (camelCase, snake_case and dotted names are taken apart).
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "bearer": 0.8, "auth": 0.6, "authorization": 0.8, "signature": 0.5, "private": 0.5, "access": 0.3, "api": 0.3, "key": 0.4, "client": 0.1, "session": 0.3, "salt": 0.5,
}
#: A name of any weight holds one of these, so that a text without them has none.
_NAME_WORDS = tuple(w.encode() for w in NAME_WEIGHTS if not any(v != w and v in w for v in NAME_WEIGHTS))
#: Values, or parts of them, that stand for a secret to be filled in.
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "todo", "none", "null", "true", "false", "redacted", "dummy", "sample", "test")
LEAST_SCORE = 1.0

_NAME = r"[A-Za-z_][A-Za-z0-9_]{0,63}(?:[.-][A-Za-z0-9_]{1,64}){0,6}"
_LEX = re.compile(rf"""(?P<q>["'])|(?P<n>{_NAME})|(?P<op>:=|=>|==|!=|<=|>=|[=:+,;\n<>/(){{}}\[\]])""")
_REST = {q: re.compile(rf"((?:[^{q}\\\n]++|\\.)*+){q}") for q in "\"'"}
#: What may stand right before an opening quote; after other letters it is an apostrophe.
_PREFIX = re.compile(r"(?:^|[^A-Za-z0-9_])[rbfuRBFUNL]{1,2}$")
_UNCLOSED = re.compile(r"""[^\s"']+""")
_BARE = re.compile(r"[A-Za-z0-9+/_.=~!@#$%^&*-]+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """How sensitive a target name is."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return sum(NAME_WEIGHTS.get(p, 0.0) for p in dict.fromkeys([*parts, *(a + b for a, b in zip(parts, parts[1:], strict=False))]))


def value_words(value: str) -> set[str]:
    """Words that a literal is made of: between other characters than letters and digits, without digits at their ends,
    and the parts of camelCase; letters among digits are no words."""
    words = {w.strip("0123456789") for w in re.split("[^A-Za-z0-9]+", value)}
    return {p.lower() for w in words for p in [w, *(_PARTS.findall(w) if w.isalpha() else [])]}


def literal_score(value: str) -> float:
    """How much a literal looks like key material: 0 for words, placeholders and short values."""
    if len(value) < 8 or " " in value or not value_words(value).isdisjoint(PLACEHOLDERS) or re.fullmatch(r"\$?[{(%<].*", value):
        return 0.0
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if kinds < 2 or not re.search("[0-9]", value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return min(1.0, entropy / 3.5) * min(1.0, n / 16 + 0.25)


def lex(text: str, at: int = 0, end: int | None = None, known: dict[str, list] | None = None) -> list[tuple[str, list]]:
    """Name-literal pairs of a text: (target name, spans of the literals that reach it), with
    constants propagated in order of appearance. A constant's own list stands among the spans and
    is shared, not copied; ``spans_of`` takes such lists apart. A string that holds other quotes or
    escapes is lexed within, too, once (``known`` is given then)."""
    nested, known = known is not None, {} if known is None else known
    pairs: list[tuple[str, list]] = []
    unclosed = {'"': -1, "'": -1}  # no quote closes one that opens before this place
    name, target, found, want = "", "", [], False  # last name; the open assignment

    def close() -> None:
        nonlocal target, found, want
        if target and found:
            pairs.append((target, found))
            known[target] = found
        target, found, want = "", [], False

    end = len(text) if end is None else end
    while at < end:
        m = _LEX.search(text, at, end)
        if m is None:
            break
        at = m.end()
        if m["op"]:
            op = m["op"]
            if op in ("=", ":", ":=", "=>") and name:
                close()
                target, want, name = name, True, ""
                skip = at
                while skip < end and text[skip] == " ":
                    skip += 1
                b = _BARE.match(text, skip, end)
                if b and not re.fullmatch(_NAME, b[0]) and text[skip - 1 : skip] not in ("'", '"'):
                    found.append((b.start(), b.end()))
                    want, at = False, b.end()
            elif op == "+" and target:
                want = True
            elif op in (",", ";", "\n", "}", ")"):
                close()
                name = ""
            elif op == "<" and target:
                close()
                name = ""
            elif op == ">" and name and text[m.start() - len(name) - 1 : m.start() - len(name)] == "<":
                target, want, name = name, True, ""  # <name>value</name>
                b = _BARE.match(text, at, end)
                if b:
                    found.append((b.start(), b.end()))
                    want, at = False, b.end()
        elif m["q"]:
            q = m["q"]
            if q == "'" and text[at - 2 : at - 1].isalnum() and at > 1 and not _PREFIX.search(text[max(0, at - 4) : at - 1]):
                continue
            closed = _REST[q].match(text, at, end) if at > unclosed[q] else None
            if closed is None:
                # later quotes of the kind on this line were escaped, and find no end either
                line = text.find("\n", at, end)
                unclosed[q] = end if line < 0 else line
                if target and want and (b := _UNCLOSED.match(text, at, end)):
                    found.append(b.span())
                    at = b.end()
                want = False
                continue
            at, value = closed.end(), closed[1]
            if not nested and any(c in value for c in "\\\"'"):
                pairs += lex(text, closed.start(1), closed.end(1), known)
            if target and want:
                found.append(closed.span(1))
                want = False
            else:
                name = value if re.fullmatch(_NAME, value) else ""
        elif target and want and m["n"] in known:
            found.append(known[m["n"]])
            want = False
        elif target and want:
            found.append(m.span("n"))  # a bare word
            want = False
        else:
            name = m["n"]
    close()
    return pairs


def spans_of(found: list, seen: set[int]) -> Iterator[tuple[int, int]]:
    """The spans of a literal list and of the lists in it, each list once by ``seen``."""
    todo = [found]
    while todo:
        here = todo.pop()
        if id(here) not in seen:
            seen.add(id(here))
            todo += [x for x in here if isinstance(x, list)]
            yield from (x for x in here if isinstance(x, tuple))


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, in code points, by start and kind."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    spans: list[tuple[str, int, int]] = []
    if any(w in low for w in _ASSIGN_WORDS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"a" * 24 in raw.translate(_HEX_ONLY):
        spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if any(w in low for w in _NAME_WORDS):
        taken = {(s, e) for _, s, e in spans}
        seen: set[int] = set()
        weighed = [(name_score(name), found) for name, found in lex(text)]
        # a list that a name of more weight has reached needs no second look
        for weight, found in sorted((x for x in weighed if x[0] >= 0.5), key=lambda x: -x[0]):
            for s, e in spans_of(found, seen):
                score = literal_score(text[s:e])
                if (s, e) not in taken and weight + score >= LEAST_SCORE + 0.5 and score >= 0.5:
                    taken.add((s, e))
                    spans.append(("literal", s, e))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_literal, base_sha256, spans) for every row of ``docs``.

    Null texts count as empty; repeated rows each get a row; an empty table gives an empty result;
    further columns are ignored. ``base_sha256`` covers the plain patterns' spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(1):
                spans = scan(t.as_py() or "")
                n = Counter(k for k, _, _ in spans)
                base = joined([x for x in spans if x[0] != "literal"])
                for c, v in zip(cols, (*(n[k] for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), joined(spans)), strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span of the text replaced by ``<secret>``; same columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                pieces, end = [], 0
                for _, s, e in scan(t or ""):
                    if e > end:
                        pieces += [t[end : max(s, end)], "<secret>"] if s >= end else []
                        end = e
                out.append(None if t is None else "".join(pieces) + t[end:])
            cols = list(b.columns)
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
