"""Workbooks: cells of each kind, headers, several sheets, dates and parts."""

import io
import zipfile
from datetime import date, datetime

import pytest

from quern.sources import excel

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(rows, shared=(), styles="", props="", names=("One",), active=0, part=0):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        sheets = "".join(f'<sheet name="{n}" sheetId="{k + 1}" r:id="r{k}"/>' for k, n in enumerate(names))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}">{props}<bookViews><workbookView activeTab="{active}"/></bookViews><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Target="{"/xl/" if k % 2 else ""}worksheets/s{k}.xml"/>' for k in range(len(names)))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for k in range(len(names)):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows if k == part else ""}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{"".join(shared)}</sst>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')
    return out.getvalue()


def test_cells_of_each_kind():
    shared = ("<si><t>plain</t></si>", "<si><r><t>rich </t></r><r><t>text</t></r><rPh><t>hint</t></rPh></si>", "<si><t>a_x000D_b</t></si>")
    styles = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
    rows = (
        '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="AB1" t="s"><v>2</v></c></row><row/>'
        '<row><c><v>5</v></c><c><v>0.10000000000000001</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><v>sum</v></c><c t="inlineStr"><is><t>in</t></is></c><c s="1"/></row>'
        '<row><c s="1"><v>45000</v></c><c s="2"><v>45000.5</v></c><c s="3"><v>3</v></c><c s="1"><v>1</v></c><c><v>1E+20</v></c></row>'
    )
    got = list(excel.sheet_rows(workbook(rows, shared, styles)))
    assert got[0] == ["plain", None, "rich text", *[None] * 24, "a\rb"] and got[1] == []
    assert got[2] == ["5", "0.1", "true", None, "sum", "in", None]
    assert got[3] == ["2023-03-15", "2023-03-15 12:00:00", "3", "1900-01-01", "1e+20"]
    late = workbook('<row><c s="1"><v>0</v></c></row>', (), '<cellXfs><xf/><xf numFmtId="14"/></cellXfs>', '<workbookPr date1904="1"/>')
    assert list(excel.sheet_rows(late)) == [["1904-01-01"]]


def test_sheets_by_name_and_the_active_one():
    book = workbook("<row><c><v>1</v></c></row>", names=("One", "Two"), active=1, part=1)
    assert list(excel.sheet_rows(book)) == [["1"]] == list(excel.sheet_rows(book, "Two")) and list(excel.sheet_rows(book, "One")) == []
    with pytest.raises(ValueError, match="no sheet"):
        list(excel.sheet_rows(book, "Three"))


def test_round_trip_in_parts(spark, tmp_path):
    rows = [(k, None if k % 5 == 0 else f"t <&\"{k}\x01 _x0041_\n ", k / 7, date(2020, 1, 1 + k % 28), datetime(2021, 3, 4, 5, 6, k % 60), k % 2 == 0, 2**60 + k) for k in range(50)]
    df = spark.createDataFrame(rows, "id long, text string, x double, d date, at timestamp, flag boolean, big long").repartition(3)
    path = f"file://{tmp_path}/books"
    made = excel.write_excel(df, path, most_rows=11).collect()
    assert sum(r["rows"] for r in made) == 50 and len(made) >= 6
    got = excel.read_excel(spark, f"{path}/*.xlsx", {"key": ("ID ",), "text": (), "x": (), "d": (), "at": (), "flag": (), "big": ()}).collect()
    want = {(str(i), t, repr(x) if x != int(x) else str(int(x)), str(d), str(a), str(f).lower(), str(b)) for i, t, x, d, a, f, b in rows}
    assert {tuple(r) for r in got} == want and len(got) == 50


def test_missing_headers_long_cells_and_no_rows(spark, tmp_path):
    path = f"file://{tmp_path}/books"
    assert excel.write_excel(spark.createDataFrame([], "a long"), path).collect() == []
    excel.write_excel(spark.createDataFrame([(1,)], "a long").coalesce(1), path).collect()
    with pytest.raises(Exception, match="no column for b"):
        excel.read_excel(spark, f"{path}/*.xlsx", {"b": ()}).collect()
    with pytest.raises(Exception, match="characters at most"):
        excel.write_excel(spark.createDataFrame([("x" * 40_000,)], "a string"), f"{path}2").collect()


def test_rows_read_leave_nothing_behind():
    """A sheet is read as a stream: no element of a row that was given stays in its tree."""
    import io
    import tracemalloc

    from quern.sources import excel

    stream = io.BytesIO()
    book = excel._Workbook(stream, ["a"], "S")
    for k in range(40_000):
        book.add([k])
    book.close()
    tracemalloc.start()
    n = sum(1 for _ in excel.sheet_rows(stream.getvalue()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 40_001 and peak < 2_000_000, peak
