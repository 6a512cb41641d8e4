"""Tables with more rows than a sheet has."""

import duckdb
import pytest

from quadrille.plans import registry

KEYS = [1, 49, 50, 99, 100, 104, 105, 279, 280, 299, 300, 1_048_575, 1_048_576, 1_048_581, 9_000_000]


def same_as_sql(spark, folder, name: str) -> bool:
    spark.createDataFrame([(k, k % 7) for k in KEYS], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet/*.parquet'")
    df, want = registry.QUERIES[name](spark, str(folder)), con.sql(registry.ORACLES[name])
    assert df.columns == want.columns
    return sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_delete_rows(spark, tmp_path):
    from pyspark.errors import PySparkException

    from quadrille.operators import edits

    assert same_as_sql(spark, tmp_path, "delete_rows")
    off = spark.createDataFrame([(1_048_582, 0)], "row long, col int")
    assert edits.delete_rows(off, 100, 5, edge=False).first().row == 1_048_577
    with pytest.raises(PySparkException):
        edits.delete_rows(off, 100, 5).collect()


def test_edit_sequence(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "edit_sequence")


def test_insert_rows(spark, tmp_path):
    from pyspark.errors import PySparkException

    from quadrille.operators import edits

    assert same_as_sql(spark, tmp_path, "insert_rows")
    last = spark.createDataFrame([(1_048_576, 0)], "row long, col int")
    assert edits.insert_rows(last, 100, 5, edge=False).first().row == 1_048_581
    with pytest.raises(PySparkException):
        edits.insert_rows(last, 100, 5).collect()


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A folder of 23 parts, and the rows that the queries on parts have."""
    folder = tmp_path_factory.mktemp("parts")
    spark.range(23, numPartitions=2).selectExpr("id p_partkey", "concat('part ', id) p_name", "cast(id % 50 as int) p_size", "id / 4 p_retailprice").write.parquet(f"{folder}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    return str(folder), sorted(con.sql(registry.ORACLES["xlsx_roundtrip"]).fetchall())


def short_sheets(monkeypatch, sheets: int = 10) -> None:
    from quadrille.plans import books

    monkeypatch.setattr(books, "MAX_ROWS", sheets)


def test_ods_roundtrip(spark, parts, monkeypatch):
    """Rows go on in further sheets, whose first rows are headers."""
    short_sheets(monkeypatch)
    assert sorted(map(tuple, registry.QUERIES["ods_roundtrip"](spark, parts[0]).collect())) == parts[1]


def test_ods_sheets(spark, tmp_path):
    from pyspark.errors import PySparkException

    from quadrille.sources import ods

    ods.register(spark)
    df = spark.range(1, 8, numPartitions=1).selectExpr("cast(id as int) row_number", "id")
    df.write.format("ods").option("sheetRows", 4).mode("append").save(f"{tmp_path}/book.ods")
    cells = spark.read.format("ods").option("sheets", "all").load(f"{tmp_path}/book.ods").filter("row > 1")
    assert sorted((c.sheet, c.row, c.num) for c in cells.collect()) == [*(("Sheet1", k + 1, k) for k in (1, 2, 3)), *(("Sheet1 (2)", k - 2, k) for k in (4, 5, 6)), ("Sheet1 (3)", 2, 7)]
    assert {c.sheet for c in spark.read.format("ods").load(f"{tmp_path}/book.ods").collect()} == {"Sheet1"}
    with pytest.raises(PySparkException):
        df.selectExpr("row_number + 1048575 row_number", "id").write.format("ods").mode("append").save(f"{tmp_path}/long.ods")


def test_stream_workbooks(spark, parts, monkeypatch):
    short_sheets(monkeypatch)
    assert sorted(map(tuple, registry.QUERIES["stream_workbooks"](spark, parts[0]).collect())) == parts[1]


def test_workbook_roundtrip(spark, parts, monkeypatch):
    short_sheets(monkeypatch)
    assert sorted(map(tuple, registry.QUERIES["workbook_roundtrip"](spark, parts[0]).collect())) == parts[1]


def test_xlsx_roundtrip(spark, parts, monkeypatch):
    short_sheets(monkeypatch)
    assert sorted(map(tuple, registry.QUERIES["xlsx_roundtrip"](spark, parts[0]).collect())) == parts[1]


def test_xlsx_sheets(spark, tmp_path):
    """Further sheets have widths and formats; merges, links and the filter are the first one's."""
    import zipfile

    from pyspark.errors import PySparkException

    from quadrille.sources import workbook, xlsx

    xlsx.register(spark)
    workbook.register(spark)
    name = "A sheet's name of 31 characters"
    df = spark.range(1, 8, numPartitions=2).selectExpr("cast(id as int) row_number", "id")
    w = df.write.format("xlsx").option("sheetName", name).option("sheetRows", 4).option("widths", "[9]").option("merges", '["A1:B1"]').option("links", '{"A2": "https://example.org/"}')
    w.mode("append").save(f"{tmp_path}/book.xlsx")
    assert zipfile.ZipFile(f"{tmp_path}/book.xlsx").testzip() is None
    sheets = [name, "A sheet's name of 31 charac (2)", "A sheet's name of 31 charac (3)"]
    cells = spark.read.format("xlsx").option("sheets", "all").load(f"{tmp_path}/book.xlsx").filter("row > 1").collect()
    assert sorted((c.num, c.sheet, c.row) for c in cells) == [(k, sheets[(k - 1) // 3], (k - 1) % 3 + 2) for k in range(1, 8)]
    part = lambda p: [r[1] for r in spark.read.format("workbook").option("part", p).load(f"{tmp_path}/book.xlsx").collect()]
    assert sorted(part("widths")) == sorted(sheets) and part("merges") == part("links") == [name]
    for bad in ({"sheetRows": 1}, {"sheetRows": 4, "sheetName": "A sheet's name of 31 charac (2)"}):
        with pytest.raises(PySparkException):
            df.write.format("xlsx").options(**bad).mode("append").save(f"{tmp_path}/bad.xlsx")
    with pytest.raises(PySparkException):
        df.selectExpr("row_number + 1048575 row_number", "id").write.format("xlsx").mode("append").save(f"{tmp_path}/bad.xlsx")
