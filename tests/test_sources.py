import datetime as dt
import random
import zlib

import pytest

from quadrille.functions import csv_text, dates
from quadrille.sources import fragments, xlsx


def test_serials():
    for serial, want in [(1, "1900-01-01"), (59, "1900-02-28"), (61, "1900-03-01"), (44319.75, "2021-05-03T18:00:00.000Z")]:
        assert dates.iso(dates.serial_to_datetime(serial)).startswith(want)
    for when in (dt.datetime(1900, 1, 1), dt.datetime(1900, 2, 28), dt.datetime(1900, 3, 1), dt.datetime(2024, 2, 29, 12)):
        assert dates.serial_to_datetime(dates.datetime_to_serial(when)) == when


def test_serial_column(spark):
    df = spark.createDataFrame([(s,) for s in (1.0, 59.0, 61.0, 44319.75)], "s double").select("s", dates.date_column(df_col()).alias("d"))
    for r in df.collect():
        assert r.d == dates.serial_to_datetime(r.s)


def df_col():
    from pyspark.sql import functions as F

    return F.col("s")


@pytest.mark.parametrize("code,want", [("General", False), ("0.00", False), ("yyyy-mm-dd", True), ('0 "days"', False), ("[h]:mm", True), ("[Red]0", False), ("h:mm AM/PM", True), (r"0\d", False)])
def test_date_codes(code, want):
    assert dates.is_date_format(code) is want


def test_csv():
    text = '﻿a,"b ""q"",\nx",0042\r\n\r\n-2.5e3,True,,""\rend'
    assert list(csv_text.parse_csv(text, convert=True)) == [["a", 'b "q",\nx', "0042"], [], [-2500.0, True, None, ""], ["end"]]
    assert list(csv_text.parse_csv("9e999,9e99\n", convert=True)) == [["9e999", 9e99]]
    assert list(csv_text.parse_csv("a,\n")) == [["a", ""]] and list(csv_text.parse_csv("a,")) == [["a", ""]]
    with pytest.raises(ValueError):
        list(csv_text.parse_csv('a,"b'))
    assert csv_text.promote_header(["Qty", None, "Qty", "Qty_2", "Qty"]) == ["Qty", "Column2", "Qty_2", "Qty_2_2", "Qty_3"]
    assert csv_text.sniff_delimiter('"a,b,c";1;2') == ";"


def test_csv_round_trip(spark):
    rows = [(1, 'x,"y"\nz', None), (2, "", "é")]
    df = spark.createDataFrame(rows, "a int, b string, c string")
    lines = [r[0] for r in df.orderBy("a").select(csv_text.csv_line([df.a, df.b, df.c])).collect()]
    assert list(csv_text.parse_csv("\n".join(lines))) == [["1", 'x,"y"\nz', ""], ["2", "", "é"]]


def test_crc_combine():
    r = random.Random(0)
    for _ in range(20):
        a, b = r.randbytes(r.randint(0, 99)), r.randbytes(r.randint(0, 99))
        assert fragments.crc_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_xlsx_round_trip(spark, tmp_path):
    import zipfile

    xlsx.register(spark)
    r = random.Random(42)
    rows = [(k, r.choice([None, "text", " <&> ", "_x0041_", "line\nend", "é😀"]), r.choice([None, r.random(), 1e20, -0.5]), r.choice([None, True, False]), dt.datetime(2020, 1, 1) + dt.timedelta(hours=k)) for k in range(1, 200)]
    path = f"{tmp_path}/book.xlsx"
    df = spark.createDataFrame(rows, "row_number int, s string, n double, b boolean, d timestamp_ntz").repartitionByRange(4, "row_number").sortWithinPartitions("row_number")
    df.write.format("xlsx").option("sheetName", 'A&B "q"').mode("overwrite").save(path)
    assert zipfile.ZipFile(path).testzip() is None
    cells = {(c.row, c.col): c for c in spark.read.format("xlsx").load(path).collect()}
    assert [cells[1, k].str for k in range(4)] == ["s", "n", "b", "d"] and cells[1, 0].sheet == 'A&B "q"'
    for k, s, n, b, d in rows:
        got = [cells.get((k + 1, c)) for c in range(4)]
        assert (got[0] and got[0].str, got[1] and got[1].num, got[2] and got[2].bool, got[3].str) == (s, n, b, dates.iso(d))


def test_xlsx_shared_formulas(tmp_path):
    import zipfile

    path = f"{tmp_path}/shared.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        for name, xml in xlsx._fixed_parts("S").items():
            z.writestr(name, xml)
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{xlsx._MAIN}"><sheetData><row r="1"><c r="C1"><f t="shared" ref="C1:D3" si="0">A1*$B$1</f><v>1</v></c><c r="D1"><f t="shared" si="0"/><v>2</v></c></row><row r="3"><c r="C3"><f t="shared" si="0"/></c><c r="D3"><f>A1</f></c><c r="E3"><f t="shared" si="9"/></c></row></sheetData></worksheet>')
    cells = {(row, c[0]): c[-1] for row, found in xlsx.Workbook(path).rows("xl/worksheets/sheet1.xml") for c in found}
    assert cells == {(1, 2): "A1*$B$1", (1, 3): "B1*$B$1", (3, 2): "A3*$B$1", (3, 3): "A1", (3, 4): None}


def test_xlsx_sink_is_safe(spark, tmp_path):
    """Rows that interleave, an existing file and a failed task leave what was there, and no fragments."""
    import os

    from pyspark.errors import PySparkException

    xlsx.register(spark)
    path = f"{tmp_path}/book.xlsx"
    good = spark.range(1, 40, numPartitions=3).selectExpr("cast(id as int) row_number", "id")
    good.write.format("xlsx").mode("append").save(path)
    before = open(path, "rb").read()
    mixed = spark.createDataFrame([(1, 1), (3, 3)], "row_number int, id long").coalesce(1).union(spark.createDataFrame([(2, 2)], "row_number int, id long").coalesce(1))
    bad = [mixed, good.selectExpr("row_number", "repeat('x', 40000) id"), good.repartition(1).orderBy(good.row_number.desc())]
    for df in bad:
        with pytest.raises(PySparkException):
            df.write.format("xlsx").mode("overwrite").save(path)
    with pytest.raises(PySparkException):
        good.write.format("xlsx").mode("overwrite").option("merges", '["A1:B2", "B2:C3"]').save(path)
    assert open(path, "rb").read() == before and os.listdir(tmp_path) == ["book.xlsx"]


def test_xlsx_odd_cells(tmp_path):
    """Dates as text, row and string numbers that are none, and the byte limit."""
    import zipfile

    path = f"{tmp_path}/odd.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        for name, xml in xlsx._fixed_parts("S").items():
            z.writestr(name, xml)
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{xlsx._MAIN}"><sheetData><row r="x"><c t="d"><v>2021-05-03T06:00:00+06:00</v></c><c t="d"><v>soon</v></c></row><row><c r="C2" t="s"><v>what</v></c><c s="no"><v>5</v></c></row></sheetData></worksheet>')
    book = xlsx.Workbook(path)
    cells = [(row, *c[:4]) for row, found in book.rows("xl/worksheets/sheet1.xml") for c in found]
    assert cells == [(1, 0, "d", 44319.0, "2021-05-03T00:00:00.000Z"), (1, 1, "s", None, "soon"), (2, 2, "z", None, None), (2, 3, "n", 5.0, None)]
    with pytest.raises(ValueError):
        list(book.rows("xl/worksheets/sheet1.xml", most=10))


def test_csv_blocks():
    import io

    from quadrille.sources.csv import records

    text = 'a,"x\ny"\r\nb,"""q""\n"\n\nlast'
    for size in range(1, len(text) + 2):
        pieces = list(records(io.StringIO(text, newline=""), size))
        assert "".join(pieces) == text and [r for p in pieces for r in csv_text.parse_csv(p)] == [["a", "x\ny"], ["b", '"q"\n'], [], ["last"]]
