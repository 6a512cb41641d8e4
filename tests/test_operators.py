"""Operators on small sheets: nulls, ties, repeats, gaps, no rows."""

import pytest
from pyspark.sql import functions as F

from quadrille.functions import text
from quadrille.operators import edits, ranges, rules, shaping
from quadrille.operators.formulas import fill_down


@pytest.fixture(scope="module")
def sheet(spark):
    return spark.createDataFrame([(2, 4.0, "b"), (3, None, "B"), (4, 1.0, None), (6, 4.0, "c"), (7, 9.0, "b")], "row int, x double, s string")


def test_fill_down_with_gaps(sheet):
    """Row 5 is missing, so it is blank to its neighbours; errors are the first in the order of cells."""
    out = fill_down(sheet, {"before": "A2+A1", "three": "SUM(A1:A3)", "run": "COUNT(A$2:A2)", "fixed": "A$4*2", "bad": "1/A2", "worst": "MAX(E$2:G2)"}).orderBy("row").collect()
    assert [r.before for r in out] == [4.0, 4.0, 1.0, 4.0, 13.0] and [r.three for r in out] == [4.0, 5.0, 1.0, 13.0, 13.0]
    assert [r.run for r in out] == [1.0, 1.0, 2.0, 3.0, 4.0] and {r.fixed for r in out} == {2.0}
    assert [r.bad_err for r in out] == [None, "#DIV/0!", None, None, None] and [r.worst_err for r in out] == [None] + ["#DIV/0!"] * 4
    assert fill_down(sheet.limit(0), {"y": "SUM(A1:A3)"}).count() == 0


def test_rules_with_nulls_and_ties(sheet):
    flag = lambda df, c: [r[c] for r in df.orderBy("row").collect()]
    assert flag(rules.top(sheet, "x", 2, "t"), "t") == [True, False, False, True, True]
    assert flag(rules.top(sheet, "x", 50, "t", percent=True), "t") == [True, False, False, True, True]
    assert flag(rules.top(sheet, "x", 1, "t", bottom=True), "t") == [False, False, True, False, False]
    assert flag(rules.repeated(sheet, "s", "d"), "d") == [True, True, False, False, True]
    assert flag(rules.average(sheet, "x", "a"), "a") == [False, False, False, False, True]
    assert flag(rules.data_bar(sheet, "x", "b"), "b") == [0.375, None, 0.0, 0.375, 1.0]
    assert flag(rules.icon_set(sheet, "x", "i", 4, reverse=True), "i") == [2, None, 3, 2, 0]
    assert flag(rules.color_scale(sheet, "x", "c", ["000000", "0000FF"]), "c") == ["000060", None, "000000", "000060", "0000FF"]
    valid = rules.valid(F.col("s"), "list", items=["b", "c"], allow_blank=False)
    assert flag(sheet.withColumn("v", valid), "v") == [True, False, False, True, True]
    assert rules.top(sheet.limit(0), "x", 2, "t").count() == rules.repeated(sheet.limit(0), "s", "d").count() == 0


def test_edits(spark):
    cells = spark.createDataFrame([("S", 1, 0, "a", "B2*2"), ("S", 5, 1, "b", None), ("T", 5, 1, "c", "S!B5+B5")], "sheet string, row int, col int, value string, formula string")
    moved = {(r.sheet, r.row, r.col): r.formula for r in edits.delete_rows(cells, 2, 2, sheet="S").collect()}
    assert moved == {("S", 1, 0): "#REF!*2", ("S", 3, 1): None, ("T", 5, 1): "S!B3+B5"}
    changes = spark.createDataFrame([("S", 5, 1, None, None), ("S", 9, 9, "new", None)], cells.schema)
    assert {(r.row, r.value) for r in edits.set_cells(cells, changes).collect()} == {(1, "a"), (9, "new"), (5, "c")}
    assert {(r.row, r.value) for r in edits.append_rows(cells, changes.withColumn("row", F.lit(1)).filter("value is not null")).collect()} == {(1, "a"), (5, "b"), (5, "c"), (6, "new")}
    with pytest.raises(ValueError):
        tabs = spark.createDataFrame([("Only", 0, "visible"), ("Dark", 1, "hidden")], "sheet string, position int, state string")
        edits.delete_sheet(tabs, cells, cells.selectExpr("value name", "sheet scope", "formula"), "Only")
    with pytest.raises(ValueError):
        edits.add_sheet(tabs, cells, "only", cells)


def test_shapes(spark):
    heads = spark.createDataFrame([(["Qty", None, "Qty", "Qty_2", ""],), ([],)], "h array<string>").select(shaping.name_headers(F.col("h")).alias("n")).collect()
    assert [r.n for r in heads] == [["Qty", "Column2", "Qty_2", "Qty_2_2", "Column5"], []]
    rows = spark.createDataFrame([(3,), (4,), (9,), (250_001,)], "row int")
    assert shaping.gap_rows(rows).filter("row < 10").count() == 5 - 1 and shaping.gap_rows(rows).count() == 250_001 - 3 - 3
    assert shaping.gap_rows(rows.limit(0)).count() == 0
    boxes = spark.createDataFrame([("A1:C3",), ("c9",), ("B2:A1",), ("XFE1",), (None,), ("A1:B",)], "t string").select(ranges.parse_box(F.col("t")).alias("b")).collect()
    assert [r.b and tuple(r.b) for r in boxes] == [(1, 1, 3, 3), (9, 3, 9, 3), (1, 1, 2, 2), None, None, None]


def test_text(spark):
    row = spark.range(1).select(
        text.unescape_xml(F.lit("a&#x1F600;&#233;&lt;&amp;lt;&#10;")).alias("a"), text.encode_escapes(F.lit("\x01_x0041_\r")).alias("b"), text.decode_escapes(F.lit("_x0041_x_x00e9_")).alias("c"),
        text.odf_spaces(F.lit("a   b\tc\nd<")).alias("d"), text.tinted(F.lit("4472C4"), F.lit(-0.5)).alias("e"), text.tinted(F.lit("808080"), F.lit(0.0)).alias("f"), text.argb(F.lit("xyz")).alias("g"),
    ).first()
    assert tuple(row)[:4] == ("a😀é<&lt;\n", "_x0001__x005F_x0041__x000D_", "Ax_x00e9_".replace("_x00e9_", "é"), '<text:p>a <text:s text:c="2"/>b<text:tab/>c</text:p><text:p>d&lt;</text:p>')
    assert (row.e, row.f, row.g) == ("203864", "808080", None)
