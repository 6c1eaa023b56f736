"""Workbooks (.xlsx) as DataFrames.

Spark reads the files (``binaryFile``, from any store it reaches), and tasks read their zipped XML: shared strings, styles,
dates and types. A sheet is one partition. Rows are read as a stream, so a sheet costs a task the
workbook's bytes and its shared strings; only names and types of columns come to the driver.

The first row with a cell is the header; columns without a name are called column_N, and a repeated name
gets the suffix _N of its column. A column of whole numbers is long, of numbers double, of truth values
boolean, of dates date or timestamp, and string in any other case; an empty cell or an error is null. A sheet without
rows is a table without columns' values, one without cells is left out.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Numbers of the built-in date and time formats.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_KINDS = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "date": pa.date32(), "timestamp_ntz": pa.timestamp("us"), "string": pa.string()}


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _text(e: ElementTree.Element) -> str:
    """Text of a string item: its runs, without phonetic hints."""
    return "".join(_text(c) if _tag(c) == "r" else c.text or "" for c in e if _tag(c) in ("t", "r"))


class Workbook:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        #: (name, member) of every sheet in order.
        self.sheets: list[tuple[str, str]] = []
        self.epoch = dt.datetime(1899, 12, 30)
        for e in book.iter():
            if _tag(e) == "workbookPr" and e.get("date1904") in ("1", "true"):
                self.epoch = dt.datetime(1904, 1, 1)
            elif _tag(e) == "sheet":
                at = links.get(_attribute(e, "id")) or ""
                member = at.lstrip("/") if at.startswith("/") else f"xl/{at}"
                if "worksheets/" in member and member in self.names:
                    self.sheets.append((e.get("name"), member))
        self.dated = self._date_styles()
        self._strings: list[str] | None = None

    def _date_styles(self) -> set[int]:
        """Cell styles whose number format writes a date or time."""
        if "xl/styles.xml" not in self.names:
            return set()
        root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        custom = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter() if _tag(f) == "numFmt"}
        plain = lambda code: re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|[_*].', "", code)
        dates = _DATE_FORMATS | {i for i, code in custom.items() if re.search(r"[dmyhs]", plain(code), re.I)}
        found = next((e for e in root if _tag(e) == "cellXfs"), ())
        return {i for i, x in enumerate(found) if int(x.get("numFmtId") or 0) in dates}

    @property
    def strings(self) -> list[str]:
        if self._strings is None:
            self._strings = []
            if "xl/sharedStrings.xml" in self.names:
                for _, e in ElementTree.iterparse(self.zip.open("xl/sharedStrings.xml")):
                    if _tag(e) == "si":
                        self._strings.append(_text(e))
                        e.clear()
        return self._strings

    def rows(self, member: str) -> Iterator[dict[int, object]]:
        """Rows with a cell, as values by column number (from 0)."""
        at = 0
        for _, e in ElementTree.iterparse(self.zip.open(member)):
            if _tag(e) != "row":
                continue
            cells: dict[int, object] = {}
            at = 0
            for c in e:
                if _tag(c) != "c":
                    continue
                letters = re.match(r"[A-Z]+", c.get("r") or "")
                if letters:
                    at = 0
                    for ch in letters[0]:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                if (v := self._value(c)) is not None:
                    cells[at] = v
                at += 1
            e.clear()
            if cells:
                yield cells

    def _value(self, c: ElementTree.Element):
        kind, raw = c.get("t") or "n", None
        for child in c:
            if _tag(child) == "is":
                return _text(child) or None
            if _tag(child) == "v":
                raw = child.text
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(raw)] or None
        if kind == "b":
            return raw.strip() in ("1", "true")
        if kind == "d":
            return dt.datetime.fromisoformat(raw.strip().replace("Z", ""))
        if kind != "n":
            return raw or None
        x = float(raw)
        if int(c.get("s") or 0) in self.dated:
            return self.epoch + dt.timedelta(microseconds=round(x * 86_400_000_000))
        return int(x) if re.fullmatch(r"-?\d{1,18}(\.0*)?", raw.strip()) else x


def _kind(values: set[str]) -> str:
    """Type of a column that holds values of these kinds."""
    for wide, parts in (("boolean", {"boolean"}), ("long", {"long"}), ("double", {"long", "double"}), ("date", {"date"}), ("timestamp_ntz", {"date", "timestamp_ntz"})):
        if values and values <= parts:
            return wide
    return "string"


def _kind_of(v: object) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, dt.datetime):
        return "date" if v.time() == dt.time() else "timestamp_ntz"
    return "long" if isinstance(v, int) else "double" if isinstance(v, float) else "string"


def _as(v: object, kind: str):
    if v is None:
        return None
    if kind == "string":
        return ("true" if v else "false") if isinstance(v, bool) else v.isoformat(" ") if isinstance(v, dt.datetime) else str(v)
    return v.date() if kind == "date" else float(v) if kind == "double" else v


def _header(cells: dict[int, object], width: int) -> list[str]:
    names: list[str] = []
    for i in range(width):
        name = _as(cells.get(i), "string") or f"column_{i + 1}"
        names.append(name if name.lower() not in {n.lower() for n in names} else f"{name}_{i + 1}")
    return names


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, columns array<string>, types array<string>, rows) for every sheet with a cell in the workbooks of a
    folder, or in one file. Workbooks are read by as many tasks as there are files."""
    schema = T.StructType([T.StructField(n, t) for n, t in (("path", T.StringType()), ("sheet", T.StringType()), ("place", T.IntegerType()), ("columns", T.ArrayType(T.StringType())), ("types", T.ArrayType(T.StringType())), ("rows", T.LongType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path_, content in zip(b["path"], b["content"]):
                book = Workbook(content)
                for place, (name, member) in enumerate(book.sheets):
                    rows = book.rows(member)
                    head = next(rows, None)
                    if head is None:
                        continue
                    kinds: dict[int, set[str]] = {i: set() for i in head}
                    n = 0
                    for r in rows:
                        n += 1
                        for i, v in r.items():
                            kinds.setdefault(i, set()).add(_kind_of(v))
                    width = max(kinds) + 1
                    yield pd.DataFrame({"path": [path_], "sheet": [name], "place": [place], "columns": [_header(head, width)], "types": [[_kind(kinds.get(i, set())) for i in range(width)]], "rows": [n]})

    return _files(spark, path).select("path", "content").mapInPandas(run, schema)


def read_sheet(spark: SparkSession, path: str, sheet: str, columns: list[str], types: list[str]) -> DataFrame:
    """One sheet of one workbook with the columns and types that ``sheets`` found: a task streams it in batches."""
    schema = T.StructType([T.StructField(c, T._parse_datatype_string(t)) for c, t in zip(columns, types)])
    arrow = pa.schema([pa.field(c, _KINDS[t]) for c, t in zip(columns, types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                book = Workbook(content.as_py())
                rows = book.rows(dict(book.sheets)[sheet])
                next(rows, None)
                held: list[dict] = []

                def batch() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([_as(r.get(i), t) for r in held], _KINDS[t]) for i, t in enumerate(types)], schema=arrow)

                for r in rows:
                    held.append(r)
                    if len(held) == 10_000:
                        yield batch()
                        held = []
                if held:
                    yield batch()

    literal = re.sub(r"([\[\]{}*?\\])", r"\\\1", path)  # a name, not a pattern
    return spark.read.format("binaryFile").load(literal).select("content").mapInArrow(run, schema)


def read_workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every sheet of a workbook by its name, in order."""
    found = sorted(sheets(spark, path).collect(), key=lambda r: r.place)  # names and types
    return {r.sheet: read_sheet(spark, r.path, r.sheet, r.columns, r.types) for r in found}
