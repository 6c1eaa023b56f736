"""Workbooks written by hand, read back; the folder sweep over both kinds of file."""

import datetime as dt
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from weekloom.operators import labeling
from weekloom.functions import text
from weekloom.sources import files, workbooks


def letters(i):
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(path, sheets, date1904=False):
    """Sheets are name -> rows; a cell is a value, or raw XML attributes and content as a tuple."""
    strings, parts = [], []
    for rows in sheets.values():
        body = ""
        for y, row in enumerate(rows, 1):
            cells = ""
            for x, v in enumerate(row):
                at = f'r="{letters(x)}{y}"'
                if v is None:
                    continue
                if isinstance(v, tuple):
                    cells += f"<c {at} {v[0]}>{v[1]}</c>"
                elif isinstance(v, bool):
                    cells += f'<c {at} t="b"><v>{int(v)}</v></c>'
                elif isinstance(v, str):
                    strings.append(v)
                    cells += f'<c {at} t="s"><v>{len(strings) - 1}</v></c>'
                else:
                    cells += f"<c {at}><v>{v!r}</v></c>"
            body += f'<row r="{y}">{cells}</row>'
        parts.append(f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {main}><workbookPr date1904="{int(date1904)}"/><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(parts) + 1)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="171" formatCode="&quot;days&quot; 0.0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><r><t>{escape(s[:1])}</t></r><r><t>{escape(s[1:])}</t></r><rPh><t>no</t></rPh></si>" for s in strings) + "</sst>")
        for k, p in enumerate(parts, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", p)


def test_types_and_names(spark, tmp_path):
    rows = [
        ["id", "价格", "flag", "day", "at", "mixed", "id", None, "empty", "days"],
        [1, 1.5, True, ("s='1'", "<v>45000</v>"), ("s='2'", "<v>45000.25</v>"), "é & <x>", 10, ("t='inlineStr'", "<is><t>beyond</t></is>"), None, ("s='3'", "<v>2.5</v>")],
        [],
        [2, 3, False, ("s='1'", "<v>45001</v>"), ("s='1'", "<v>45001</v>"), 7, ("t='e'", "<v>#N/A</v>"), None, None, None],
        [None, None, None, None, None, True, None, None, None, None, ("t='str'", "<v>formula</v>")],
    ]
    path = tmp_path / "Book [1].xlsx"
    workbook(path, {"a/b": rows, "none": [], "header only": [["x", "y"]]})
    book = workbooks.read_workbook(spark, str(tmp_path))
    assert list(book) == ["a/b", "header only"] and book["header only"].columns == ["x", "y"] and book["header only"].count() == 0
    got = book["a/b"]
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [
        ("id", "bigint"), ("价格", "double"), ("flag", "boolean"), ("day", "date"), ("at", "timestamp_ntz"), ("mixed", "string"), ("id_7", "bigint"), ("column_8", "string"), ("empty", "string"), ("days", "double"), ("column_11", "string"),
    ]
    day = dt.date(2023, 3, 15)
    assert [tuple(r) for r in got.collect()] == [
        (1, 1.5, True, day, dt.datetime(2023, 3, 15, 6), "é & <x>", 10, "beyond", None, 2.5, None),
        (2, 3.0, False, dt.date(2023, 3, 16), dt.datetime(2023, 3, 16), "7", None, None, None, None, None),
        (None, None, None, None, None, "true", None, None, None, None, "formula"),
    ]
    workbook(tmp_path / "old.xlsx", {"s": [["d"], [("s='1'", "<v>1</v>")]]}, date1904=True)
    assert workbooks.read_workbook(spark, str(tmp_path / "old.xlsx"))["s"].first()[0] == dt.date(1904, 1, 2)


def test_folder_sweep(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "prices.csv").write_text("code,close\n1,2.5\n2,3\n")
    workbook(folder / "funds.xlsx", {"A/股": [["code", "aum"], *([i, i / 4] for i in range(25_000))], "b\\c": [["name"], ["x"], ["y"]]})
    (folder / "notes.txt").write_text("not a table")
    out = str(tmp_path / "out")
    got = {r.name: r.rows for r in files.to_parquet(spark, str(folder), out).collect()}
    assert got == {"prices": 2, "funds_A_股": 25_000, "funds_b_c": 2}
    back = spark.read.parquet(f"{out}/funds_A_股.parquet")
    assert back.agg(F.sum("code"), F.sum("aum")).first() == (25_000 * 24_999 // 2, 25_000 * 24_999 / 8)
    (tmp_path / "nothing").mkdir()
    assert files.to_parquet(spark, str(tmp_path / "nothing"), out).count() == 0


def test_json_sink(spark, tmp_path):
    rows = spark.createDataFrame([("科技", 3), (None, 4)], "major string, n long")
    files.write_json(rows, str(tmp_path / "labels"))
    assert sorted(map(str, spark.read.json(str(tmp_path / "labels")).select("major", "n").collect())) == sorted(map(str, rows.collect()))


def test_inferred_logits_and_fences(spark):
    rows = spark.createDataFrame([(i, "x" * (i % 5)) for i in range(50)], "id long, model_text string").repartition(3)
    out = labeling.inferred(rows, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()
    assert len(out) == 50 and all(r.logits == [float(r.id % 5), 1.0] for r in out)
    for given, want in (("```json\n[1]\n```", "[1]"), ("[2]", "[2]"), ("", "")):
        assert spark.createDataFrame([(given,)], "t string").select(text.unfenced(F.col("t"))).first()[0] == want
