"""Fill-in-middle examples from whole texts.

A text is decoded to an array of code points. Tokens are runs of ASCII letters and single other
characters, so a token begins wherever two neighbours are not both letters; the positions found
there are indexed by two drawn ranks, and the three pieces between them are encoded again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIELDS = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Options:
    """Of a hundred texts, ``rate`` are cut and the rest stay plain; of a hundred cut ones, ``spm``
    begin with the suffix."""

    seed: str = "1"
    rate: int = 90
    spm: int = 20


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def token_starts(points: np.ndarray) -> np.ndarray:
    """Positions at which tokens begin, and the length of the text as the last entry."""
    if not len(points):
        return np.zeros(1, np.int64)
    low = points | 0x20
    letter = (low >= ord("a")) & (low <= ord("z"))
    inside = letter[1:] & letter[:-1]
    return np.concatenate(([0], np.flatnonzero(~inside) + 1, [len(points)]))


def draws(doc_id: int | None, seed: str) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that depend on the id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def cut(doc_id: int | None, text: str, options: Options = Options()) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    points = code_points(text)
    starts = token_starts(points)
    n = len(starts) - 1
    h1, h2, h3, h4 = draws(doc_id, options.seed)
    if not n or h3 % 100 >= options.rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = int(starts[a]), int(starts[b])
    p, m, s = (x.tobytes().decode("utf-32-le") for x in (points[:i], points[i:j], points[j:]))
    if h4 % 100 < options.spm:
        return n, "spm", i, j - i, f"{SUFFIX}{s}{PREFIX}{p}{MIDDLE}{m}"
    return n, "psm", i, j - i, f"{PREFIX}{p}{SUFFIX}{s}{MIDDLE}{m}"


def transform(docs: DataFrame, options: Options = Options(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the columns n (tokens), form (plain, psm or spm), prefix_chars, middle_chars
    (code points; null where plain) and output.

    Null text counts as empty and stays plain; a null id draws as the empty string does; repeated
    rows give repeated rows. Columns of these names are replaced, others stay. Texts are taken as
    they are, whatever their length; a batch leaves the worker after 16 million characters."""
    kept = docs.drop(*FIELDS)
    ids, texts = kept.columns.index(id_col), kept.columns.index(text_col)
    names = [*kept.columns, *FIELDS]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, rows, size = 0, [], 0
            for k in range(b.num_rows):
                text = b.column(texts)[k].as_py() or ""
                rows.append(cut(b.column(ids)[k].as_py(), text, options))
                size += len(text)
                if size > 16_000_000 or k == b.num_rows - 1:
                    made = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays([*b.slice(first, len(rows)).columns, *made], names=names)
                    first, rows, size = k + 1, [], 0

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form, output):
    """The text of an output. It holds no marker but the three written, and none can arise where a
    piece meets a marker, so the first of each kind is the one written."""
    psm = F.concat(
        F.split_part(F.split_part(output, F.lit(SUFFIX), F.lit(1)), F.lit(PREFIX), F.lit(2)),
        F.split_part(output, F.lit(MIDDLE), F.lit(2)),
        F.split_part(F.split_part(output, F.lit(SUFFIX), F.lit(2)), F.lit(MIDDLE), F.lit(1)),
    )
    rest = F.split_part(output, F.lit(PREFIX), F.lit(2))
    spm = F.concat(F.split_part(rest, F.lit(MIDDLE), F.lit(1)), F.split_part(rest, F.lit(MIDDLE), F.lit(2)), F.split_part(F.split_part(output, F.lit(PREFIX), F.lit(1)), F.lit(SUFFIX), F.lit(2)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
