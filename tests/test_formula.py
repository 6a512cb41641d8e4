import pytest

from quadrille.functions.formula import bind, column_letters, column_number, compile_formula

CASES = [
    ("1+2", 3), ("10-5*2", 0), ("2^3", 8), ("5<>5", False), ("-2^2", 4), ("2^3^2", 64), ("50%", 0.5), ("1E3", 1000),
    ('"a"="A"', True), ('D1=""', True), ('"1"=1', False), ('"a">5', True), ("TRUE>9", True), ('SUM("3",1)', 4), ("SUM(TRUE,1)", 2),
    ("SUM(A1:C1)", 60), ("AVERAGE(A1:C1)", 20), ("MAX(A1:C1, 100)", 100), ("COUNT(A1:C1)", 3), ("IF(C1 > 15, SUM(A1:C1), 0)", 60),
    ("IF(0,1)=FALSE", True), ('"x"&1&TRUE', "x1TRUE"), ('CONCATENATE("x",0.1+0.2)', "x0.3"), ("Z1+1", 1), ("IF(D1>0,1,E1)&B1", "text20"), ("SUM(E1,2)", 2), ("COUNT(E1,\"x\",3)", 1), ("MIN(F1:G1)", 0),
]


@pytest.fixture(scope="module")
def sheet(spark):
    return spark.createDataFrame([(10, 20.0, 30, None, "text")], "a int, b double, c int, d string, e string")


@pytest.mark.parametrize("formula,want", CASES)
def test_value(sheet, formula, want):
    v = compile_formula("=" + formula, bind(sheet), row=1)
    r = sheet.select(v.col.alias("v"), v.err.alias("e")).first()
    assert r.e is None and r.v == want


@pytest.mark.parametrize("formula,err", [("1/0+1", "#DIV/0!"), ("E1+1", "#VALUE!"), ("(-1)^0.5", "#NUM!"), ("AVERAGE(F1:G1)", "#DIV/0!")])
def test_error(sheet, formula, err):
    v = compile_formula(formula, bind(sheet), row=1)
    assert sheet.select(v.col.alias("v"), v.err.alias("e")).first() == (None, err)


@pytest.mark.parametrize("formula", ["Other!A1", "NOPE(1)", "1+", "C:C", "SUM(1 2)", "A7", "A$1", "SUM(A1:A3)"])
def test_unsupported(sheet, formula):
    assert compile_formula(formula, bind(sheet), row=1) is None


def test_letters():
    assert [column_letters(n) for n in (1, 26, 27, 702, 703, 16384)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert all(column_number(column_letters(n)) == n for n in range(1, 3000))


@pytest.mark.parametrize("formula,want", [("CONCATENATE(1/3)", "0.333333333333333"), ('1E-10&""', "1E-10"), ('-2.5E-7&""', "-2.5E-7"), ('0.000001&""', "0.000001"), ('1.5E21&""', "1.5E+21"), ('1E20&""', "100000000000000000000"), ('1234567890123456&""', "1234567890123460"), ('-12.5&""', "-12.5"), ('IF(TRUE,200/3,"x")&""', "66.6666666666667")])
def test_number_text(sheet, formula, want):
    test_value(sheet, formula, want)
