"""Byte-pair encoding and decoding with a tokenization automaton.

States are the last token read; ``arc(p, t)`` says whether token ``t`` may follow ``p`` (or the
start). Initially every byte may follow every byte. Merges are applied in rank order, each as one
gadget (compare Berglund et al., "Constructing a BPE Tokenization DFA", 2024); for (a, b) -> c:

* the new state c leaves by the arcs that b has now (its row is b's row),
* the arc from a to b goes,
* c may be entered from just the states that a may be entered from now (its column is a's column).

The automaton then accepts exactly the token sequences that BPE makes. It is deterministic: every
byte string has one accepted path, as has each of its prefixes. Fifty thousand merges make a table
of 2.5 billion arcs, so a compiled gadget keeps its two references and its rank, and arcs are
resolved through them when first asked for and kept in a bounded table.

Encoding runs the automaton over a pre-split word by its tables: the labels' tree gives the tokens
at a position, longest first, and the arcs say which may be read. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenizer's pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and arcs that a Python worker remembers: when so many are new, those not asked for since are forgotten.
MEMO = 60_000


def _plane_pattern() -> str:
    """``PATTERN`` for texts of the basic plane, with the ranges of its classes written out: the standard module matches
    these in half the time. The ranges are those of ``regex``, so both split alike."""
    plane = "".join(map(chr, range(1 << 16)))
    ranges = lambda c: "".join(f"\\u{m.start():04x}-\\u{m.end() - 1:04x}" for m in regex.finditer(f"{c}+", plane))
    letter, number, space = map(ranges, (r"\p{L}", r"\p{N}", r"\s"))
    return f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable bytes are themselves, the rest are
    256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled from a tokenizer file's vocabulary and merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.label: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            self.label[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.label[i] = token.encode()
        self.byte = {self.label[i]: i for i in model["vocab"].values() if len(self.label[i]) == 1}
        self.born = [0] * size  # rank of the gadget that made a state; 0 for bytes
        self.row = [-1] * size  # whose arcs a new state takes over
        self.column = [-1] * size  # who is entered from where a new state is
        self.cut: dict[int, int] = {}  # the arc that a gadget removes (from << 20 | to), and its rank
        self.token = dict(self.byte)
        for rank, merge in enumerate(model["merges"], 1):
            a, b = (model["vocab"][x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            label = self.label[a] + self.label[b]
            c = model["vocab"]["".join(merge) if isinstance(merge, list) else merge.replace(" ", "")]
            self.cut[a << 20 | b] = rank
            self.born[c], self.row[c], self.column[c] = rank, b, a
            self.token[label] = c
        self.step: dict[int, int] = {}  # (node of the labels' tree) << 8 | byte -> node
        self.at = [-1]  # node -> token
        for label in sorted(self.token):
            node = 0
            for byte in label:
                node = self.step.setdefault(node << 8 | byte, len(self.at))
                if node == len(self.at):
                    self.at.append(-1)
            self.at[node] = self.token[label]
        self.shorter = [-1] * size  # the longest token that a token begins with
        for label, t in self.token.items():
            self.shorter[t] = next((x for n in range(len(label) - 1, 0, -1) if (x := self.token.get(label[:n])) is not None), -1)
        self.length = list(map(len, self.label))
        self.longest = max(self.length)
        self.arcs: dict[int, int] = {}  # from << 20 | longest token -> what is entered, see next
        self.older_arcs: dict[int, int] = {}
        self.words = Words(self)
        self.split_any, self.split_plane = regex.compile(PATTERN).findall, re.compile(_plane_pattern()).findall
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def arc(self, p: int, t: int) -> bool:
        """Whether ``t`` may follow ``p`` once all merges are compiled."""
        return self._open(p, t, 1 << 60)

    def next(self, p: int, t: int) -> int:
        """The first of ``t`` and the tokens it begins with, longest first, that may follow ``p``; -1 if none may."""
        key = p << 20 | t
        if (found := self.arcs.get(key)) is None and (found := self.older_arcs.get(key)) is None:
            found = t
            while found >= 0 and not self.arc(p, found):
                found = self.shorter[found]
        if len(self.arcs) > MEMO:
            self.older_arcs = dict(self.arcs)
            self.arcs.clear()
        self.arcs[key] = found
        return found

    def _longest(self, data: bytes, i: int) -> int:
        """The longest token at position ``i``."""
        node, found, step, at = 0, -1, self.step, self.at
        for byte in data[i : i + self.longest]:
            node = step.get(node << 8 | byte)
            if node is None:
                break
            if at[node] >= 0:
                found = at[node]
        return found

    def run(self, data: bytes) -> tuple[int, ...]:
        """The accepted path over one word's bytes. Tokens are tried longest first; a position from
        which the path cannot go on is closed, so that each is left at most once."""
        if (t := self.token.get(data, -1)) >= 0 and self._alone(t):
            return (t,)
        path: list[int] = []
        closed: set[int] = set()
        i, p, size, t = 0, -1, len(data), self._longest(data, 0)
        arcs, length, shorter, step, at, longest = self.arcs, self.length, self.shorter, self.step, self.at, self.longest
        while i < size:
            if p < 0:
                while t >= 0 and not self._alone(t):
                    t = shorter[t]
            elif t >= 0:
                known = arcs.get(p << 20 | t)
                t = self.next(p, t) if known is None else known
            if t >= 0:
                end = i + length[t]
                if end in closed:
                    t = shorter[t]
                    continue
                path.append(t)
                i, p, node = end, t, 0
                for byte in data[i : i + longest]:  # as _longest
                    node = step.get(node << 8 | byte)
                    if node is None:
                        break
                    if at[node] >= 0:
                        t = at[node]
                continue
            closed.add(i)  # nothing goes on from here
            t = path.pop()
            i -= length[t]
            t = shorter[t]
            p = path[-1] if path else -1
        return tuple(path)

    def _alone(self, t: int) -> bool:
        """Whether the start may go to ``t``: its two parts may meet until its own gadget. True for
        all but unreachable vocabulary entries."""
        return not self.born[t] or self._reachable(t)

    @lru_cache(maxsize=200_000)  # noqa: B019  one automaton lives as long as its worker
    def _reachable(self, t: int) -> bool:
        a, b, rank = self.column[t], self.row[t], self.born[t]
        return (not self.born[a] or self._reachable(a)) and (not self.born[b] or self._reachable(b)) and self._open(a, b, rank)

    def _open(self, p: int, t: int, rank: int) -> bool:
        """Whether the arc stands when the gadgets below ``rank`` are compiled."""
        cut, born, row, column = self.cut, self.born, self.row, self.column
        while True:
            if cut.get(p << 20 | t, rank) < rank:
                return False
            born_p, born_t = born[p], born[t]
            if born_p > born_t:  # the younger of the two was made from the table as it was then
                p, rank = row[p], born_p
            elif born_t:  # a column is copied after the gadget's own cut
                t, rank = column[t], born_t + 1
            else:
                return True

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; special tokens' strings are those tokens."""
        ids: list[int] = []
        if self.specials is None:
            return self._plain(text, ids)
        at = 0
        for m in self.specials.finditer(text):
            self._plain(text[at : m.start()], ids)
            ids.append(self.special[m[0]])
            at = m.end()
        return self._plain(text[at:] if at else text, ids)

    def split(self, text: str) -> list[str]:
        """The pre-tokenizer's words."""
        plane = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        return (self.split_plane if plane else self.split_any)(text)

    def _plain(self, text: str, ids: list[int]) -> list[int]:
        ids.extend(chain.from_iterable(map(self.words.__getitem__, self.split(text))))
        return ids

    def decode(self, ids: list[int]) -> str:
        """Labels of the arcs, joined; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", errors="replace")


class Words(dict):
    """Paths by word. A word that is asked for and not there is run; see ``MEMO``."""

    def __init__(self, owner: Automaton):
        super().__init__()
        self.owner, self.older = owner, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        path = self.older.get(word)
        if path is None:
            path = self.owner.run(word.encode())
        if len(self) > MEMO:
            self.older = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = path
        return path


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(path)


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids_col`` (array<int>): the tokens of every whole text. Null
    counts as the empty text, which has no tokens. A column of that name is replaced; others stay.
    ``vocabulary``: a tokenizer file that every executor can open under that path."""
    kept = docs.drop(ids_col)
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier stages left in this worker
        a = automaton(vocabulary)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                found = [a.encode(t.as_py() or "") for t in part.column(at)]
                ends = np.cumsum([0, *map(len, found)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.fromiter(chain.from_iterable(found), np.int32, ends[-1])))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, ids_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, `{ids_col}` array<int>")


def decode(rows: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the column ``text_col``: the text of ``ids_col``; null ids count as none."""
    kept = rows.drop(text_col)
    at = kept.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(vocabulary)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                texts = pa.array([a.decode(x or []) for x in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, text_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, `{text_col}` string")


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded in one
    pass so that token lists need not leave the worker. Null counts as the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(vocabulary)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                ids = a.encode(t.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(np.fromiter(ids, "<u4", len(ids)).tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(a.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
