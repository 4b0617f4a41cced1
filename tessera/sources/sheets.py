"""Spreadsheets (.xlsx): cells with their types, read and written by the executors, without a spreadsheet library.

A file is a zip archive of XML. Spark's binary reader gives a file to a task, which streams the rows of its
sheets; a cell keeps what it is: text, number, date, bool or error. So what was typed as text stays
text even if it looks like a number or date, and dates that a spreadsheet made of codes are known as such.
"""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import write_files

CELL = "struct<kind:string,text:string>"
_CELLS = pa.map_(pa.string(), pa.struct([("kind", pa.string()), ("text", pa.string())]))
# Name spaces of the format, and its numbers of date formats.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}

# What XML cannot hold is written as the format writes it, by code.
_BARE = re.compile("[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")
_CODED = re.compile("_x([0-9A-Fa-f]{4})_")


def _date_code(code: str) -> bool:
    """Whether a number format shows a date or time: a letter of one outside quotes, brackets and escapes."""
    return re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.', "", code), re.IGNORECASE) is not None


def _moment(serial: float, from_1904: bool) -> str:
    """A day number as text: the day before 1 March 1900 counts one more than there was."""
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30) if serial >= 60 else datetime(1899, 12, 31)
    return (start + timedelta(seconds=round(serial * 86400))).strftime("%Y-%m-%d %H:%M:%S")


def _text(element) -> str:
    """The text of a string item: its own and its runs', without readings."""
    parts = (t.text or "" for part in element if part.tag != f"{_MAIN}rPh" for t in ([part] if part.tag == f"{_MAIN}t" else part.findall(f"{_MAIN}t")))
    return _CODED.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


class Book:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        book = ET.fromstring(self.zip.read("xl/workbook.xml"))
        made = book.find(f"{_MAIN}workbookPr")
        self.from_1904 = made is not None and made.get("date1904") in ("1", "true")
        links = {x.get("Id"): x.get("Target") for x in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = [(s.get("name"), place(links[s.get(f"{_RELATED}id")])) for s in book.iter(f"{_MAIN}sheet")]
        self.shared = []
        if "xl/sharedStrings.xml" in names:
            for _, x in ET.iterparse(self.zip.open("xl/sharedStrings.xml")):
                if x.tag == f"{_MAIN}si":
                    self.shared.append(_text(x))
                    x.clear()
        self.dates = set()
        if "xl/styles.xml" in names:
            styles = ET.fromstring(self.zip.read("xl/styles.xml"))
            own = {int(x.get("numFmtId")) for x in styles.iter(f"{_MAIN}numFmt") if _date_code(x.get("formatCode", ""))}
            cells = styles.find(f"{_MAIN}cellXfs")
            self.dates = {k for k, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}

    def cell(self, c) -> tuple[str, str] | None:
        kind, value = c.get("t", "n"), c.findtext(f"{_MAIN}v")
        if kind == "inlineStr":
            inside = c.find(f"{_MAIN}is")
            return None if inside is None else ("text", _text(inside))
        if value is None:
            return None
        if kind == "s":
            return "text", self.shared[int(value)]
        if kind == "str":
            return "text", value
        if kind == "b":
            return "bool", "true" if value == "1" else "false"
        if kind == "e":
            return "error", value
        if kind == "d":
            return "date", value.replace("T", " ")[:19]
        if int(c.get("s", 0)) in self.dates:
            return "date", _moment(float(value), self.from_1904)
        number = float(value)
        return "number", str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)

    def rows(self, part: str):
        """(row number from 1, {column letters: cell}) of the rows that hold anything."""
        n = 0
        for _, row in ET.iterparse(self.zip.open(part)):
            if row.tag != f"{_MAIN}row":
                continue
            n = int(row.get("r", n + 1))
            cells, at = {}, 0
            for c in row.findall(f"{_MAIN}c"):
                letters = re.match("[A-Z]*", c.get("r", ""))[0]
                at = _number(letters) if letters else at + 1
                found = self.cell(c)
                if found is not None:
                    cells[_letters(at)] = found
            row.clear()
            if cells:
                yield n, cells


def _number(letters: str) -> int:
    n = 0
    for x in letters:
        n = n * 26 + ord(x) - 64
    return n


def _letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


_ROWS = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", _CELLS)])


def _read(with_names: bool, most: int = 2000):
    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                book = Book(content.as_py())
                for sheet, part in book.sheets:
                    names, held = None, []
                    for n, cells in book.rows(part):
                        if with_names and names is None:
                            names = {at: text for at, (_, text) in cells.items()}
                            continue
                        named = [(names[at] if names else at, {"kind": k, "text": t}) for at, (k, t) in cells.items() if not names or at in names]
                        held.append({"path": path, "sheet": sheet, "row": n, "cells": named})
                        if len(held) == most:
                            yield pa.RecordBatch.from_pylist(held, _ROWS)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist(held, _ROWS)

    return run


def read_sheets(spark: SparkSession, paths: list[str] | str, header: bool = True) -> DataFrame:
    """path, sheet, row (from 1), cells: a map of the column's name (its letters without a header) to kind and text; a task a file, rows streamed. Lock files (~$) are left out."""
    files = spark.read.format("binaryFile").load(paths).where(~F.element_at(F.split("path", "/"), -1).startswith("~$"))
    return files.select("path", "content").mapInArrow(_read(header), f"path string, sheet string, row int, cells map<string,{CELL}>")


def cell(name: str, kind: str | None = None) -> Column:
    """The text of a named cell, or null; with a kind, only of cells of it."""
    found = F.col("cells")[name]
    return found["text"] if kind is None else F.when(found["kind"] == kind, found["text"])


def sheet_columns(rows: DataFrame, schema: str) -> DataFrame:
    """path, sheet, row and the named cells, cast to the types of a schema."""
    kinds = rows.sparkSession.createDataFrame([], schema).schema
    return rows.select("path", "sheet", "row", *(cell(f.name).try_cast(f.dataType).alias(f.name) for f in kinds))


_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{target}"/>{more}</Relationships>'
_STYLES = f'<styleSheet xmlns="{_MAIN[1:-1]}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>'


def _sheet_file(name: str, columns: list[str], rows: list[list[tuple[str, str] | None]]) -> bytes:
    def put(at: str, found) -> str:
        if found is None:
            return ""
        kind, value = found
        if kind == "text":
            inside = escape(_BARE.sub(lambda m: f"_x{ord(m[0]):04X}_", value))
            return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{inside}</t></is></c>'
        if kind == "date":
            days = (datetime.strptime(value, "%Y-%m-%d %H:%M:%S") - datetime(1899, 12, 30)).total_seconds() / 86400
            return f'<c r="{at}" s="1"><v>{days!r}</v></c>'
        return f'<c r="{at}" t="b"><v>{int(value == "true")}</v></c>' if kind == "bool" else f'<c r="{at}"><v>{value}</v></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS.format(kind="officeDocument", target="xl/workbook.xml", more=""))
        more = '<Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/>'
        z.writestr("xl/_rels/workbook.xml.rels", _RELS.format(kind="worksheet", target="worksheets/sheet1.xml", more=more))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_RELATED[1:-1]}"><sheets><sheet name="{escape(name, {chr(34): '&quot;'})}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/styles.xml", _STYLES)
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
            for n, row in enumerate([[("text", c) for c in columns], *rows], 1):
                f.write(f'<row r="{n}">{"".join(put(f"{_letters(k)}{n}", x) for k, x in enumerate(row, 1))}</row>'.encode("utf-8", "replace"))
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def write_sheets(rows: DataFrame, root: str, file: str, order: list[str], columns: list[str], sheet: str = "Sheet1") -> None:
    """A spreadsheet for each value of `file` (a path below root), made by the task that has its rows: numbers, dates (timestamps), bools and texts keep their types. A sheet has at most some million rows by its format, so a group is bounded."""
    kinds = dict(rows.dtypes)
    kind = lambda c: "date" if kinds[c].startswith("timestamp") else "bool" if kinds[c] == "boolean" else "text" if kinds[c] == "string" else "number"
    as_text = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kind(c) == "date" else F.col(c).cast("string") for c in columns}
    texts = rows.select(F.col(file).alias("path"), F.struct(*order).alias("_order"), F.struct(*(as_text[c].alias(c) for c in columns)).alias("_cells"))
    own = {c: kind(c) for c in columns}
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def make(key, table: pa.Table) -> pa.Table:
        cells = table["_cells"].to_pylist()
        made = [[None if r[c] is None else (own[c], r[c]) for c in columns] for r in cells]
        return pa.table([[key[0].as_py()], [_sheet_file(sheet, columns, made)]], schema=schema)

    def grouped(table: pa.Table) -> pa.Table:
        rows_in_order = table.take(pa.array(sorted(range(table.num_rows), key=lambda i: tuple(table["_order"][i].as_py().values()))))
        return make((table["path"][0],), rows_in_order)

    write_files(texts.groupBy("path").applyInArrow(grouped, "path string, content binary"), root)
