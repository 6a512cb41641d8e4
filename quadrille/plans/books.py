"""Queries that write a table as a workbook or CSV in the shared folder and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.plans.registry import query, table
from quadrille.sources import csv, ods, workbook, xlsx
from quadrille.sources.xlsx import MAX_ROWS


def _place(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="quadrille-")
    base = base.removeprefix("file:").rstrip("/")
    import os

    os.makedirs(f"{base}/books", exist_ok=True)
    return f"{base}/books/{uuid.uuid4().hex}-{name}"


def _numbered(df: DataFrame, key: str, first: int = 0) -> DataFrame:
    """Rows numbered by a key that runs without gaps from first."""
    return df.withColumn("row_number", (F.col(key) - first + 1).cast("int")).repartitionByRange(4, "row_number").sortWithinPartitions("row_number")


def _typed(cells: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row a sheet row below the header, in each sheet: columns by place and kind of value."""
    body = cells.filter("row > 1").groupBy("sheet", "row")
    return body.agg(*[F.max(F.when(F.col("col") == k, F.col(kind))).alias(name) for k, (name, kind) in enumerate(columns.items())])


_PART_SQL = """SELECT p_partkey, p_name, p_retailprice, p_size > 20 AS large, strftime(DATE '2020-01-01' + p_size, '%Y-%m-%dT00:00:00.000Z') AS day FROM part"""
_PART = {"p_partkey": "num", "p_name": "str", "p_retailprice": "num", "large": "bool", "day": "str"}


def _parts(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "part")
    t = t.select("p_partkey", "p_name", "p_retailprice", (F.col("p_size") > 20).alias("large"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")).alias("day"))
    return _numbered(t, "p_partkey", t.agg(F.min("p_partkey")).first()[0])


def _part_rows(cells: DataFrame) -> DataFrame:
    return _typed(cells, _PART).select(F.col("p_partkey").cast("long").alias("p_partkey"), *[c for c in _PART if c != "p_partkey"])


@query(_PART_SQL)
def xlsx_roundtrip(spark, sf_dir):
    xlsx.register(spark)
    path = _place(spark, "parts.xlsx")
    _parts(spark, sf_dir).write.format("xlsx").option("sheetName", "Parts").option("widths", "[10, 40]").option("freeze", "B2").option("title", "Parts").option("sheetRows", MAX_ROWS).mode("append").save(path)
    return _part_rows(spark.read.format("xlsx").option("sheets", "all").load(path))


@query(_PART_SQL)
def ods_roundtrip(spark, sf_dir):
    ods.register(spark)
    path = _place(spark, "parts.ods")
    _parts(spark, sf_dir).write.format("ods").option("sheetName", "Parts").option("widths", "[10, 40]").option("sheetRows", MAX_ROWS).mode("append").save(path)
    return _part_rows(spark.read.format("ods").option("sheets", "all").load(path))


@query(_PART_SQL)
def workbook_roundtrip(spark, sf_dir):
    """The format is found by content, whatever the name says."""
    xlsx.register(spark)
    workbook.register(spark)
    path = _place(spark, "parts.bin")
    _parts(spark, sf_dir).write.format("xlsx").option("sheetRows", MAX_ROWS).mode("append").save(path)
    return _part_rows(spark.read.format("workbook").option("sheets", "all").load(path))


@query("""SELECT c_custkey, c_name, c_acctbal, c_acctbal > 0 AS plus FROM customer""")
def csv_roundtrip(spark, sf_dir):
    """Numbers, booleans and text keep their kinds."""
    csv.register(spark)
    path = _place(spark, "customers.csv")
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), F.col("c_custkey").alias("k"), "c_name", "c_acctbal", (F.col("c_acctbal") > 0).alias("plus"))
    csv.write_csv(t, ["k", "c_name", "c_acctbal", "plus"], path)
    rows = spark.read.format("sheet-csv").load(path)
    f = lambda k: F.col("fields")[k]
    return rows.select(f(0).cast("double").cast("long").alias("c_custkey"), f(1).alias("c_name"), f(2).cast("double").alias("c_acctbal"), (f(3) == "TRUE").alias("plus"))


@query("""SELECT doc_id, text FROM documents""")
def csv_text_roundtrip(spark, sf_dir):
    """Texts with delimiters, quotes and line ends."""
    csv.register(spark)
    path = _place(spark, "documents.csv")
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), F.col("doc_id").alias("k"), F.concat(F.lit('"'), "text").alias("text"))
    csv.write_csv(t, ["k", "text"], path, delimiter=";")
    rows = spark.read.format("sheet-csv").option("delimiter", ";").load(path).filter(F.size("fields") > 0)
    return rows.select(F.col("fields")[0].cast("double").cast("long").alias("doc_id"), F.substring(F.col("fields")[1], 2, 2_000_000_000).alias("text"))


_FURNITURE = {"merges": '["A2:B2", "C4:C9"]', "links": '{"A3": "https://example.org/", "A4": "#Parts!A1"}', "widths": "[12, null, 30]", "validations": '[{"range": "B2:B9", "type": "whole", "operator": "between", "formula1": 1, "formula2": 9}]', "names": '{"Rate": "0.25"}'}


def _furnished(spark, sf_dir) -> str:
    xlsx.register(spark)
    workbook.register(spark)
    path = _place(spark, "furniture.xlsx")
    t = _numbered(table(spark, sf_dir, "region"), "r_regionkey")
    w = t.write.format("xlsx").option("sheetName", "Parts").option("freeze", "A2").option("protect", "secret").option("autoFilter", "A1:B6").option("creator", "me")
    w = w.option("conditionalFormats", '[{"range": "A2:A9", "type": "iconSet", "icons": "3Arrows"}, {"range": "A2:A9", "type": "containsText", "text": "x"}]')
    for k, v in _FURNITURE.items():
        w = w.option(k, v)
    w.mode("append").save(path)
    return path


def _part(spark, sf_dir, name: str) -> DataFrame:
    return spark.read.format("workbook").option("part", name).load(_furnished(spark, sf_dir)).drop("file")


@query("""SELECT * FROM (VALUES ('Parts', 'A2:B2'), ('Parts', 'C4:C9')) AS t(sheet, range)""")
def xlsx_merges(spark, sf_dir):
    return _part(spark, sf_dir, "merges").toDF("sheet", "range")


@query("""SELECT * FROM (VALUES ('Parts', 1, 1, 12.0::DOUBLE), ('Parts', 3, 3, 30.0::DOUBLE)) AS t(sheet, first, last, width)""")
def xlsx_widths(spark, sf_dir):
    return _part(spark, sf_dir, "widths").toDF("sheet", "first", "last", "width")


@query("""SELECT * FROM (VALUES ('Parts', 'A3', 'https://example.org/'), ('Parts', 'A4', '#Parts!A1')) AS t(sheet, cell, target)""")
def xlsx_links(spark, sf_dir):
    return _part(spark, sf_dir, "links").toDF("sheet", "cell", "target", "tooltip").drop("tooltip")


@query("""SELECT * FROM (VALUES ('Parts', 'B2:B9', 'whole', 'between', '1', '9')) AS t(sheet, range, type, operator, formula1, formula2)""")
def xlsx_validations(spark, sf_dir):
    return _part(spark, sf_dir, "validations").toDF("sheet", "range", "type", "operator", "formula1", "formula2", "blank").drop("blank")


@query("""SELECT * FROM (VALUES ('Rate', '0.25'), ('_xlnm._FilterDatabase', 'Parts!$A$1:$B$6')) AS t(name, formula)""")
def xlsx_names(spark, sf_dir):
    return _part(spark, sf_dir, "names").toDF("name", "scope", "formula").drop("scope")


@query("""SELECT 0 AS position, 'Parts' AS sheet, 'visible' AS state""")
def xlsx_sheets(spark, sf_dir):
    return _part(spark, sf_dir, "sheets").toDF("position", "sheet", "state")


@query(_PART_SQL)
def stream_workbooks(spark, sf_dir):
    """Two workbooks in a folder, read as a stream until all of them are in, in files."""
    from quadrille.streaming import stream_cells

    xlsx.register(spark)
    folder = _place(spark, "inbox")
    parts = _parts(spark, sf_dir)
    for k in range(2):
        some = parts.filter(F.col("p_partkey") % 2 == k)
        some.write.format("xlsx").option("sheetRows", MAX_ROWS).mode("append").save(_made(folder, f"half{k}.xlsx"))
    out = f"{folder}-cells"
    query_ = stream_cells(spark, f"file:{folder}", every=True).writeStream.format("parquet").option("checkpointLocation", f"file:{folder}-log").trigger(availableNow=True).start(f"file:{out}")
    query_.awaitTermination()
    cells = spark.read.parquet(f"file:{out}").filter("row > 1").groupBy("file", "sheet", "row")
    wide = cells.agg(*[F.max(F.when(F.col("col") == k, F.col(kind))).alias(name) for k, (name, kind) in enumerate(_PART.items())])
    return wide.select(F.col("p_partkey").cast("long").alias("p_partkey"), *[c for c in _PART if c != "p_partkey"])


def _made(folder: str, name: str) -> str:
    import os

    os.makedirs(folder, exist_ok=True)
    return f"{folder}/{name}"


@query("""SELECT col + 1 AS "first", CAST(LEAST(255, GREATEST(10, round(MAX(length(value)) * 1.2, 2))) AS DOUBLE) AS width FROM
 (SELECT 0 AS col, CAST(c_custkey AS VARCHAR) AS value FROM customer WHERE c_custkey < 100 UNION ALL SELECT 1, c_name FROM customer WHERE c_custkey < 100 UNION ALL SELECT 2, c_mktsegment FROM customer WHERE c_custkey < 100) GROUP BY 1""")
def csv_to_workbook(spark, sf_dir):
    """CSV made a workbook: the first 100 rows give the widths of the columns."""
    import json

    from quadrille.operators.shaping import column_widths, preview, to_cells

    csv.register(spark)
    xlsx.register(spark)
    workbook.register(spark)
    path, book = _place(spark, "in.csv"), _place(spark, "out.xlsx")
    t = table(spark, sf_dir, "customer")
    first = t.agg(F.min("c_custkey")).first()[0]
    csv.write_csv(t.withColumn("row", F.col("c_custkey") - first + 1), ["c_custkey", "c_name", "c_mktsegment"], path)
    rows = spark.read.format("sheet-csv").load(path).select(F.col("fields")[0].cast("double").cast("long").alias("k"), F.col("fields")[1].alias("name"), F.col("fields")[2].alias("segment"))
    sample = preview(rows.filter(F.col("k") < 100), 100, "k")
    widths = {r["col"]: r["width"] for r in column_widths(to_cells(sample, "k", ["k", "name", "segment"])).collect()}  # one row a column
    _numbered(rows, "k", first).write.format("xlsx").option("widths", json.dumps([widths.get(k) for k in range(3)])).mode("append").save(book)
    return spark.read.format("workbook").option("part", "widths").load(book).drop("file").toDF("sheet", "first", "last", "width").select("first", "width")
