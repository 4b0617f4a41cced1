"""Files that executors write in two phases, NumPy arrays by ranges of rows, spreadsheets with the types of their cells."""

import io
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import arrays, files, sheets


def test_files_appear_at_the_commit(spark, tmp_path):
    rows = spark.range(20).select(F.concat(F.lit("a/b"), F.col("id").cast("string")).alias("path"), F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "UTF-8").alias("content"))
    files.write_files(rows.repartition(4), str(tmp_path))
    assert {p.name: p.stat().st_size for p in (tmp_path / "a").iterdir()} == {f"b{i}": i for i in range(20)}
    stop = rows.withColumn("content", F.when(F.col("path") == "a/b13", F.raise_error(F.lit("stop")).cast("binary")).otherwise(F.lit(b"new").cast("binary")))
    with pytest.raises(Exception, match="stop"):
        files.write_files(stop.repartition(4), str(tmp_path))
    assert (tmp_path / "a" / "b3").read_bytes() == b"xxx" and [p.name for p in tmp_path.iterdir()] == ["a"]
    with pytest.raises(Exception, match="twice"):
        files.write_files(rows.unionByName(rows), str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["a"]


@pytest.mark.parametrize("dtype", ["<f4", ">f8", "<i2", ">i4", "u1", "?", "<U3", "S4", "<f2"])
@pytest.mark.parametrize("shape, order", [((37,), "C"), ((37, 3), "C"), ((37, 3), "F")])
def test_arrays(spark, tmp_path, dtype, shape, order):
    r = np.random.default_rng(1)
    x = np.array(r.integers(0, 100, shape).astype(dtype), order=order)
    np.save(tmp_path / "x.npy", x)
    got = [row["values"] for row in arrays.read_arrays(spark, str(tmp_path / "x.npy"), part_bytes=40).orderBy("row").collect()]
    assert got == [v.decode() if isinstance(v, bytes) else v for v in x.tolist()] if x.ndim == 1 else got == [[v.decode() if isinstance(v, bytes) else v for v in row] for row in x.tolist()]


def test_structured_arrays_and_refusals(spark, tmp_path):
    x = np.zeros(10, [("id", "<i8"), ("v", ">f4", (2, 2)), ("name", "<U5")])
    x["id"], x["v"], x["name"] = np.arange(10), np.arange(40).reshape(10, 2, 2), [f"n{i}" for i in range(10)]
    np.save(tmp_path / "a.npy", x[:6])
    np.save(tmp_path / "b.npy", x[6:])
    got = arrays.read_arrays(spark, str(tmp_path), part_bytes=100).orderBy("id").collect()
    assert [(r.id, list(r.v), r.name) for r in got] == [(i, x["v"][i].reshape(-1).tolist(), f"n{i}") for i in range(10)]
    assert [(r.file, r.row) for r in got] == [("a.npy", i) for i in range(6)] + [("b.npy", i) for i in range(4)]
    np.save(tmp_path / "o.npy", np.array([{"a": 1}], dtype=object), allow_pickle=True)
    (tmp_path / "t.npy").write_bytes(b"no array at all")
    for bad in ("o.npy", "t.npy", "none.npy"):
        with pytest.raises(Exception, match="pickle|not a .npy|FileNotFound"):
            arrays.read_arrays(spark, str(tmp_path / bad)).collect()
    np.save(tmp_path / "e.npy", np.zeros((0, 3)))
    assert arrays.read_arrays(spark, str(tmp_path / "e.npy")).count() == 0


def workbook(path, sheet, shared=(), styles="", date1904=False):
    main, rel = sheets._MAIN[1:-1], sheets._RELATED[1:-1]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><workbookPr {"date1904=\"1\"" if date1904 else ""}/><sheets><sheet name="A &amp; B" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(shared)}</sst>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}">{styles}</styleSheet>')


STYLES = '<numFmts><numFmt numFmtId="170" formatCode="[Red]&quot;day&quot; 0.0"/><numFmt numFmtId="171" formatCode="d\\.m"/></numFmts><cellXfs><xf/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'


def test_sheets_of_other_programs(spark, tmp_path):
    cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3" s="1"><v>43893</v></c><c r="B3"><v>9</v></c><c r="C3" s="2"><v>2.50</v></c></row>'
    cells += '<row r="4"><c r="A4" t="inlineStr"><is><t>2020</t></is></c><c r="C4" s="3"><v>59.5</v></c></row><row r="5"><c r="A5" t="e"><v>#N/A</v></c><c r="C5" t="b"><v>1</v></c></row><row r="6"><c r="A6"/></row><row><c t="str"><v>x</v></c><c/><c><v>1E3</v></c></row>'
    workbook(tmp_path / "w.xlsx", cells, ["<si><t>first</t></si>", "<si><r><t>th</t></r><r><t xml:space='preserve'>ird </t></r><rPh><t>no</t></rPh></si>"], STYLES)
    (tmp_path / "~$w.xlsx").write_bytes(b"lock")
    got = {r.row: {k: (c.kind, c.text) for k, c in r.cells.items()} for r in sheets.read_sheets(spark, str(tmp_path)).collect()}
    assert got == {3: {"first": ("date", "2020-03-03 00:00:00"), "third ": ("number", "2.5")}, 4: {"first": ("text", "2020"), "third ": ("date", "1900-02-28 12:00:00")}, 5: {"first": ("error", "#N/A"), "third ": ("bool", "true")}, 7: {"first": ("text", "x"), "third ": ("number", "1000")}}
    bare = sheets.read_sheets(spark, str(tmp_path), header=False).orderBy("row").first()
    assert bare.sheet == "A & B" and bare.cells["C"].text == "third "
    workbook(tmp_path / "w.xlsx", '<row r="1"><c r="A1" s="1"><v>0.5</v></c></row>', styles=STYLES, date1904=True)
    assert sheets.read_sheets(spark, str(tmp_path), header=False).first().cells["A"].text == "1904-01-01 12:00:00"


def test_sheets_round_trip(spark, tmp_path):
    odd = ["", " a ", "_x0041_", "\x01\r\n\t", "<&>", "é日\U0001f600", "2020-01-01", "12"]
    rows = spark.createDataFrame([(i, f"f{i % 2}.xlsx", t, datetime(2021, 2, 3, 4, 5, i), i / 3, i % 3 == 0 if i else None) for i, t in enumerate(odd)], "n int, file string, t string, d timestamp, x double, b boolean").repartition(3)
    sheets.write_sheets(rows, str(tmp_path), "file", ["n"], ["n", "t", "d", "x", "b"], sheet='S "1"')
    got = sheets.read_sheets(spark, str(tmp_path))
    kinds = {(k, c.kind) for r in got.collect() for k, c in r.cells.items()}
    assert kinds == {("n", "number"), ("t", "text"), ("d", "date"), ("x", "number"), ("b", "bool")} and {r.sheet for r in got.collect()} == {'S "1"'}
    back = sheets.sheet_columns(got, "n int, t string, d timestamp, x double, b boolean").orderBy("n").collect()
    assert [(r.n, r.t, r.d, r.x, r.b) for r in back] == [(r.n, r.t, r.d, r.x, r.b) for r in rows.orderBy("n").collect()]
    assert zipfile.ZipFile(io.BytesIO((tmp_path / "f0.xlsx").read_bytes())).testzip() is None
