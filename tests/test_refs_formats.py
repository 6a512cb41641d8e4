import pytest
from pyspark.sql import functions as F

from quadrille.functions.number_format import format_column
from quadrille.functions.refs import Axis, absolute, forget_sheet, from_open_formula, letters_of, number_of, rewrite_formula, shift_formula, to_open_formula


@pytest.mark.parametrize("formula,rows,cols,want", [
    ("$C7+C$7*$C$7", 3, 2, "$C10+E$7*$C$7"), ("XFD9", 0, 1, "#REF!"), ("B2", -2, 0, "#REF!"), ('SUM(D4:E9)&"D4"&LOG10(E2)', 1, 1, 'SUM(E5:F10)&"D4"&LOG10(F3)'),
    ("SUM(C:D)-MAX(4:9)", 2, 3, "SUM(F:G)-MAX(6:11)"), ("'My D4'!D4+Data!E5", 1, 0, "'My D4'!D5+Data!E6"), ("SUM(A1048570:A1048575)", 5, 0, "SUM(A1048575:A1048576)"),
    ("FALSE+2E3+H8", 1, 0, "FALSE+2E3+H9"), ("SUM(XFC1:XFD1)", 0, 1, "SUM(XFD1:XFD1)"), ("D$4:D9", -7, 0, "#REF!"), ("ATAN2(B2,3)", 0, 0, "ATAN2(B2,3)"),
])
def test_shift(formula, rows, cols, want):
    assert shift_formula(formula, rows, cols) == want


def test_axis():
    add, cut = Axis(((5, 3, True),)), Axis(((5, 3, False),))
    assert [add.point(n) for n in (4, 5, 9)] == [4, 8, 12]
    assert [cut.point(n) for n in (4, 5, 7, 8)] == [4, None, None, 5]
    assert cut.span(2, 9) == (2, 6) and cut.span(5, 7) is None and cut.span(6, 10) == (5, 7)
    assert rewrite_formula("SUM(C2:C9)*C8-C6", cut) == "SUM(C2:C6)*C5-#REF!"
    assert rewrite_formula("SUM(3:7)+A9", cut) == "SUM(3:4)+A6"
    assert rewrite_formula("Other!A9+A9+'My Sheet'!A9", add) == "Other!A9+A12+'My Sheet'!A9"
    assert rewrite_formula("Other!A9+A9+'My Sheet'!A9:B10", add, sheet="My Sheet", own=False) == "Other!A9+A9+'My Sheet'!A12:B13"
    assert rewrite_formula("A:A+B2", cols=Axis(((1, 1, True),))) == "B:B+C2"


def test_other_rewritings():
    assert absolute("C3:D9+E$2") == "$C$3:$D$9+$E$2"
    assert forget_sheet("Gone!A1+Kept!B2&\"Gone!A1\"+SUM(Gone!C3:D4)", "gone") == "#REF!+Kept!B2&\"Gone!A1\"+SUM(#REF!)"
    for f in ("SUM(C3:D9,E2)", "Data!B2*2", "IF(A1>2,\"a;b\",'My Sheet'!C4)", "MAX(Data!B2:C3)"):
        assert from_open_formula(to_open_formula(f)) == f
    assert to_open_formula("SUM(C3:D9,E2)") == "of:=SUM([.C3:.D9];[.E2])"


def test_columns(spark):
    cut = Axis(((3, 2, False), (2, 1, True)))
    low, high = cut.span_columns(F.col("id"), F.col("id") + 2)
    for r in spark.range(1, 9).select("id", cut.column(F.col("id")).alias("n"), low.alias("a"), high.alias("b")).collect():
        assert r.n == cut.point(r.id) and (None if r.a is None else (r.a, r.b)) == cut.span(r.id, r.id + 2)
    names = spark.createDataFrame([(n,) for n in (1, 26, 27, 702, 703, 16384)], "n int").select("n", letters_of(F.col("n")).alias("s"))
    assert [(r.s, r.back) for r in names.select("n", "s", number_of(F.col("s")).alias("back")).collect()] == [("A", 1), ("Z", 26), ("AA", 27), ("ZZ", 702), ("AAA", 703), ("XFD", 16384)]


NUMBERS = [
    (7, "General", "7"), (0.1 + 0.7, "General", "0.8"), (5 / 7, "General", "0.714285714"), (98765432109, "General", "98765432109"), (987654321098, "General", "9.87654E+11"), (3e-7, "General", "3E-07"),
    (0.00021, "", "0.00021"), (-250, "General", "-250"), (8765.432, "0", "8765"), (1.5, "0", "2"), (-3.5, "0", "-4"), (2.675, "0.00", "2.68"), (-0.001, "0.00", "-0.00"), (7654321.987, "#,##0.00", "7,654,321.99"),
    (0, "#", ""), (0.25, "#.00", ".25"), (2.5, "0.0#", "2.5"), (2, "0.##", "2."), (9, "0000", "0009"), (7.5, "??0.0?", "  7.5 "), (4321, "$#,##0", "$4,321"), (9, "0_)", "9 "), (9, "0*x", "9"), (2, "[Blue]0.0", "2.0"),
    (1e16, "#,##0.00", "10,000,000,000,000,000.00"), (12, "0,000", "0,012"), (0.3, "0%", "30%"), (0.4567, "0.0%", "45.7%"), (7654321, "0,", "7654"), (7654321, "0.0,,", "7.7"), (54321, '#,##0.0,"k"', "54.3k"),
    (-7, "0.0;(0.0)", "(7.0)"), (0, '0;(0);"none"', "none"), (-7, "0;;0", ""), (7, ";;;", ""), (250, '[>=200]"many";"few"', "many"), (20, '[>=200]"many";"few"', "few"), (3125550100, "[<=9999999]###-####;(###) ###-####", "(312) 555-0100"),
    (5550100, "[<=9999999]###-####;(###) ###-####", "555-0100"), (54321, "0.00E+00", "5.43E+04"), (0.00034, "0.0E+00", "3.4E-04"), (9999, "0.0E+0", "1.0E+4"), (54321, "##0.0E+0", "54.3E+3"), (0, "0.0E+0", "0.0E+0"), (54321, "0.0E-0", "5.4E4"),
    (2.75, "# ?/?", "2 3/4"), (0.2, "# ?/?", " 1/5"), (6, "# ?/?", "6    "), (2.71828, "# ??/??", "2 51/71"), (2.5, "?/?", "5/2"), (1.7, "# ?/8", "1 6/8"), (-2.75, "# ?/?", "-2 3/4"),
    (43831, "yyyy-mm-dd", "2020-01-01"), (43831, "d-mmm-yy", "1-Jan-20"), (43831, "dddd", "Wednesday"), (43831.3125, "m/d/yyyy h:mm AM/PM", "1/1/2020 7:30 AM"), (60, "d mmm", "29 Feb"), (0, "yyyy-mm-dd", "1900-01-00"), (61, "d/m", "1/3"),
    (1.25, "[h]:mm", "30:00"), (0.5, "[mm]", "720"), (0.00001, "mm:ss.0", "00:00.9"), (0.53, "hh:mm:ss", "12:43:12"), (43831.5, "h A/P", "12 P"), (9.5, "[$€-407]0.0", "€9.5"), (6, "@", "6"), (6, "0.0;@", "6.0"), (43831, "mmmmm", "J"),
]


def test_format(spark):
    """One projection of all codes, so that each is compiled and run as a column."""
    row = spark.range(1).select(*[format_column(F.lit(float(v)), code).alias(f"c{k}") for k, (v, code, _) in enumerate(NUMBERS)]).first()
    assert [(v, c, row[k]) for k, (v, c, _) in enumerate(NUMBERS)] == NUMBERS


def test_format_other_kinds(spark):
    shown = [(F.lit("Ann"), '"Name: "@', "s", "Name: Ann"), (F.lit("x"), '0;0;0;"<"@', "s", "<x"), (F.lit("x"), "0.0", "s", "x"), (F.lit(True), "0", "b", "TRUE"), (F.lit(None).cast("double"), "0", "n", ""), (F.lit(None).cast("string"), "@", "s", "")]
    row = spark.range(1).select(*[format_column(c, code, kind).alias(f"c{k}") for k, (c, code, kind, _) in enumerate(shown)]).first()
    assert list(row) == [w for *_, w in shown]
    assert spark.range(1).select(format_column(F.lit(0.0), "yyyy-mm-dd", date1904=True)).first()[0] == "1904-01-01"
