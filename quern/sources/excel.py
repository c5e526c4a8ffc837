"""Workbooks: sheets are read as a stream of rows, one file a task, and written in parts.

Files come through Spark's own reader, so any store that Spark opens will do.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.batches import bounded_batches

# Fixed values of the format: name spaces, number formats that are dates, rows of a sheet and characters of a cell at most.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
MOST_ROWS, MOST_CHARACTERS = 1_048_576, 32_767
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0d\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")


def _text(node) -> str:
    """The text of a string item, runs joined, without phonetic hints."""
    parts = [t.text or "" for run in node if run.tag != f"{_MAIN}rPh" for t in ([run] if run.tag == f"{_MAIN}t" else run.iter(f"{_MAIN}t"))]
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


def _elements(book: zipfile.ZipFile, name: str, tag: str) -> Iterator:
    """Elements of one tag in a part of the book, each forgotten when the next one is asked for."""
    if name in book.namelist():
        with book.open(name) as f:
            above: list = []
            for event, node in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    above.append(node)
                    continue
                above.pop()
                if node.tag == _MAIN + tag:
                    yield node
                    node.clear()
                    if above:  # else an empty element stays for each
                        above[-1].remove(node)


def _is_date(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
    return bool(re.search("[ymdhs]", bare.lower())) and "general" not in bare.lower()


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date or a time."""
    own = {int(n.get("numFmtId")): n.get("formatCode", "") for n in _elements(book, "xl/styles.xml", "numFmt")}
    dates = _DATE_FORMATS | {k for k, code in own.items() if _is_date(code)}
    for cells in _elements(book, "xl/styles.xml", "cellXfs"):
        return {k for k, x in enumerate(cells) if int(x.get("numFmtId", 0)) in dates}
    return set()


def _sheet(book: zipfile.ZipFile, sheet: str | None) -> tuple[str, bool]:
    """The part that holds a sheet, by its name or else the active one, and whether days count from 1904."""
    tree = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = {n.get("name"): n.get(_RELATION) for n in tree.iter(f"{_MAIN}sheet")}
    active = next((int(v.get("activeTab", 0)) for v in tree.iter(f"{_MAIN}workbookView")), 0)
    name = sheet if sheet is not None else list(sheets)[active]
    if name not in sheets:
        raise ValueError(f"no sheet {name}")
    links = {n.get("Id"): n.get("Target") for n in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = links[sheets[name]]
    part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
    return part, any(n.get("date1904") in ("1", "true") for n in tree.iter(f"{_MAIN}workbookPr"))


def _moment(serial: float, from_1904: bool) -> str:
    """Date, or date and time to the second, of a day number; the format counts a 29 February 1900."""
    first = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 31) if serial < 60 else datetime(1899, 12, 30)
    at = first + timedelta(seconds=round(serial * 86_400))
    return at.strftime("%Y-%m-%d") if serial == int(serial) else at.strftime("%Y-%m-%d %H:%M:%S")


def _place(ref: str) -> int:
    out = 0
    for letter in ref:
        if not letter.isalpha():
            break
        out = out * 26 + ord(letter.upper()) - 64
    return out - 1


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Rows of a sheet as texts; an empty or erroneous cell is null, a number has no more digits than it needs."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        part, from_1904 = _sheet(book, sheet)
        shared = [_text(n) for n in _elements(book, "xl/sharedStrings.xml", "si")]
        dates = _date_styles(book)
        for row in _elements(book, part, "row"):
            out: list[str | None] = []
            for cell in row.iter(f"{_MAIN}c"):
                at, kind, raw = _place(cell.get("r", "")), cell.get("t", "n"), cell.findtext(f"{_MAIN}v")
                out += [None] * ((at if at >= 0 else len(out)) - len(out))
                if kind == "inlineStr":
                    value = next((_text(n) for n in cell.iter(f"{_MAIN}is")), None)
                elif raw is None or kind == "e":
                    value = None
                elif kind == "s":
                    value = shared[int(raw)]
                elif kind == "b":
                    value = "true" if raw == "1" else "false"
                elif kind == "n":
                    x = float(raw)
                    value = _moment(x, from_1904) if int(cell.get("s", 0)) in dates else repr(int(x)) if x == int(x) and abs(x) < 2**53 else repr(x)
                else:
                    value = raw
                out.append(value)
            yield out


def read_excel(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]], sheet: str | None = None) -> DataFrame:
    """Columns of a sheet, by name or by their known headers, as texts; one file a task.

    The first row holds the headers, whose case and blanks at the ends don't
    count; an absent one is an error. Rows without a value in any column of the
    sheet are left out. ``path`` may name several workbooks.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = sheet_rows(content.as_py(), sheet)
                header = [(h or "").strip().lower() for h in next(rows, [])]
                picked = []
                for name, known in aliases.items():
                    hit = next((header.index(k.strip().lower()) for k in (name, *known) if k.strip().lower() in header), None)
                    if hit is None:
                        raise ValueError(f"no column for {name}")
                    picked.append(hit)
                held: list[list] = []
                for row in rows:
                    if any(v is not None for v in row):
                        held.append([row[k] if k < len(row) else None for k in picked])
                    if len(held) == 4096:
                        yield _columns(held, list(aliases))
                        held = []
                yield _columns(held, list(aliases))

    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(of, ", ".join(f"`{name}` string" for name in aliases))


def _columns(rows: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names)


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, datetime):
        day = value.replace(tzinfo=None) - datetime(1899, 12, 30)
        return f'<c s="2"><v>{day.total_seconds() / 86_400!r}</v></c>'
    if isinstance(value, date):
        return f'<c s="1"><v>{(value - date(1899, 12, 30)).days}</v></c>'
    if isinstance(value, int) and abs(value) < 2**53 or isinstance(value, float) and abs(value) < float("inf"):
        return f"<c><v>{value!r}</v></c>"
    text = str(value)
    if len(text) > MOST_CHARACTERS:
        raise ValueError(f"a cell holds {MOST_CHARACTERS} characters at most")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_ILLEGAL.sub(lambda m: f"_x{ord(m[0]):04X}_", text))}</t></is></c>'


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPE}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPE}.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{_MAIN[1:-1]}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
}


class _Workbook:
    """One workbook, written row by row."""

    def __init__(self, stream, columns: list[str], sheet: str):
        self.book = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
        for name, body in _PARTS.items():
            self.book.writestr(name, _HEAD + body)
        self.book.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_OFFICE}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        self.part = self.book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.part.write(f'{_HEAD}<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
        self.rows = 0
        self.add(columns)

    def add(self, values) -> None:
        self.part.write(f"<row>{''.join(map(_cell, values))}</row>".encode())
        self.rows += 1

    def close(self) -> None:
        self.part.write(b"</sheetData></worksheet>")
        self.part.close()
        self.book.close()


def write_excel(df: DataFrame, path: str, sheet: str = "Sheet1", most_rows: int = MOST_ROWS) -> DataFrame:
    """Workbooks below a new folder, one per task or more where a sheet is full: (file, rows).

    ``path`` is one that ``pyarrow.fs`` opens and all executors share. A file
    appears whole or not at all, under a name told by its partition, so a
    repeated task writes the same again. Whole numbers of 2 ** 53 or more are
    written as text, as the format has doubles only; a text longer than a cell is
    an error. Nothing is written before the result is read.
    """
    columns = df.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        task, turn, book, stream, done = TaskContext.get().partitionId(), 0, None, None, []
        name = lambda: f"part-{task:05d}-{turn:03d}.xlsx"

        def finish() -> None:
            book.close()
            stream.close()
            store.move(f"{root}/.{name()}.part", f"{root}/{name()}")
            done.append((name(), book.rows - 1))

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                if book is not None and book.rows == most_rows:
                    finish()
                    book, turn = None, turn + 1
                if book is None:
                    stream = store.open_output_stream(f"{root}/.{name()}.part")
                    book = _Workbook(stream, columns, sheet)
                book.add(values)
        if book is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["file", "rows"])

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(of, "file string, rows long")
