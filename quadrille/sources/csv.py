"""CSV as spreadsheets write it, as a Spark data source: one partition a file, read in blocks.

Spark's own CSV reader drops blank lines, cells beyond the first row's width and records with an open quote; here a
blank line is an empty row, rows may be ragged, quoted fields are text, and an open quote is an error. Rows come as
row (from 1) and an array of fields, kinds telling numbers, booleans and text apart.

    register(spark)
    spark.read.format("sheet-csv").option("delimiter", ";").load("/data/*.csv")
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quadrille.functions.csv_text import parse_csv

ROWS = "file string, row int, fields array<string>, kinds array<string>"
BLOCK = 1 << 20


def records(stream, block: int = BLOCK) -> Iterator[str]:
    """Stretches of whole records: text is held only up to a line end outside quotes."""
    held, begun = "", False
    while text := stream.read(block):
        if not begun:
            text, begun = text.removeprefix("﻿"), True
        held += text
        at = len(held) if not held.endswith("\r") else len(held) - 1
        at = held.rfind("\n", 0, at)
        while at >= 0 and held.count('"', 0, at) % 2:
            at = held.rfind("\n", 0, at)
        if at >= 0:
            yield held[: at + 1]
            held = held[at + 1 :]
    if held:
        yield held


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.delimiter = options["path"].removeprefix("file:"), options.get("delimiter", ",")

    def partitions(self):
        found = sorted(glob.glob(self.path))
        files = [g for f in found for g in (sorted(glob.glob(f"{f}/part-*")) if os.path.isdir(f) else [f])]
        return [_File(f) for f in files]

    def read(self, partition):
        kinds = {str: "s", float: "n", bool: "b", type(None): "z"}
        row = 0
        with open(partition.path, encoding="utf-8", newline="") as f:
            for text in records(f):
                for fields in parse_csv(text, self.delimiter, convert=True):
                    row += 1
                    yield partition.path, row, [None if x is None else str(x).upper() if isinstance(x, bool) else repr(x) if isinstance(x, float) else x for x in fields], [kinds[type(x)] for x in fields]


class CsvSource(DataSource):
    @classmethod
    def name(cls):
        return "sheet-csv"

    def schema(self):
        return ROWS

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CsvSource)


def write_csv(rows: DataFrame, columns: list[str], path: str, delimiter: str = ",", row: str = "row", end: str = "\n", mode: str = "error") -> None:
    """Rows as lines of CSV, in order of their numbers, a part file each task; gaps between rows are blank lines."""
    from quadrille.operators.shaping import csv_lines

    lines = csv_lines(rows, columns, row, delimiter).repartitionByRange(row).sortWithinPartitions(row)
    lines.select("line").write.mode(mode).option("lineSep", end).text(path)
